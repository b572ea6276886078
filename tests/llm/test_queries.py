"""Whole queries: those with SQL against DuckDB, the others and the pipeline against plain versions."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pagelore.llm import quality
from pagelore.llm.queries import QUERIES, SQL
from test_brute import plain_spans


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    got, want = QUERIES[name](spark, data), con.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def plain_statistics(text):
    """The eleven statistics, character by character and word by word."""
    size, words, lines = len(text.encode()), text.split(), text.split("\n")
    count = lambda chars: sum(text.count(c) for c in chars)
    again = lambda ws: sum(ws[i] == ws[i - 1] for i in range(1, len(ws)))
    long = [line for line in lines if len(line.split()) >= 3]
    upper, digits = (sum(a <= c <= z for c in text) for a, z in (("A", "Z"), ("0", "9")))
    return [
        np.log(1 + len(words)), np.log(1 + (len(text) + 60) / (len(words) + 10)),
        np.sqrt((upper + 1.0) / (size + 50)), np.sqrt((digits + 0.2) / (size + 50)), np.sqrt((count(quality.SYMBOLS.decode()) + 0.1) / (size + 50)),
        np.sqrt(min(4.0, max([sum(line.count(c) for c in "#$%&*|!") / (len(line.split()) + 2) for line in long], default=0.0))),
        np.sqrt(again(words) / (len(words) + 10)), np.sqrt(max([again(line.split()) / (len(line.split()) + 2) for line in long], default=0.0)),
        np.sqrt((len(lines) - len(set(lines))) / (len(lines) + 5)), np.log(1 + len(set(words))) / np.log(2 + len(words)) if words else 1.0,
        np.sqrt((count("!.?") + 1) / (len(words) + 10)),
    ]


def test_quality_query(spark, data):
    docs = pq.read_table(f"{data}/documents.parquet").to_pydict()
    labels = [(i, q) for i, q in zip(*pq.read_table(f"{data}/labels.parquet").select(["doc_id", "quality"]).to_pydict().values(), strict=True) if q in (0, 1)]
    x = {i: np.array(plain_statistics(t or "")) for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    own = {c: np.array([x[i] for i, q in labels if q == c and i in x and not held(i)]) for c in (0, 1)}
    covers = {c: np.cov(rows.T, bias=True) for c, rows in own.items()}
    n = {c: len(rows) for c, rows in own.items()}
    pooled = (n[0] * covers[0] + n[1] * covers[1]) / (n[0] + n[1])

    def density(row, c):
        shrunk = 0.8 * covers[c] + 0.2 * pooled
        shrunk = 0.8 * shrunk + 0.2 * np.diag(np.diag(shrunk)) + 1e-3 * np.eye(11)
        away = row - own[c].mean(0)
        return np.log(n[c]) - 0.5 * (away @ np.linalg.solve(shrunk, away) + np.linalg.slogdet(shrunk)[1])

    got = {r["doc_id"]: r for r in QUERIES["op2_quality_discriminant"](spark, data).collect()}
    assert got.keys() == x.keys()
    for i, row in x.items():
        want = 1 / (1 + np.exp(np.clip(density(row, 0) - density(row, 1), -500, 500)))
        assert got[i]["held_out"] == held(i) and abs(got[i]["score"] - want) < 1e-6 and got[i]["predicted"] == (got[i]["score"] >= 0.5)


def plain_stream(media):
    """Payload bytes of a stream, packet by packet: length of the adaptation field, then the PES packets of the one elementary PID."""
    pes, counters, tables = [], {}, []
    for k in range(0, len(media), 188):
        packet = media[k : k + 188]
        assert packet[0] == 0x47
        pid, start, extra = (packet[1] & 31) << 8 | packet[2], packet[1] & 64, packet[3] & 32
        assert pid not in counters or packet[3] & 15 == (counters[pid] + 1) % 16
        counters[pid] = packet[3] & 15
        body = packet[5 + packet[4] :] if extra else packet[4:]
        if pid == 0x100:
            if start:
                pes.append(b"")
            pes[-1] += body
        else:
            tables.append(pid)
    assert set(tables) == {0, 0x1000}
    return b"".join(p[9 + p[8] :] for p in pes)


def test_media_query(spark, data):
    from pagelore.llm import mpegts
    from pagelore.llm.common import table

    texts = dict(zip(*pq.read_table(f"{data}/documents.parquet").select(["doc_id", "text"]).to_pydict().values(), strict=True))
    media = {r["doc_id"]: bytes(r["media"]) for r in mpegts.store(table(spark, data, "documents")).collect()}
    for r in QUERIES["op10_transport_stream"](spark, data).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        own = media[r["doc_id"]]
        assert plain_stream(own) == payload
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        units = -(-len(payload) // mpegts.UNIT)
        said = f"packets={len(own) // 188};units={units};access={-(-units // mpegts.GOP)};last_pts={(units - 1) * mpegts.TICKS}"
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(own), hashlib.sha256(own).hexdigest(), said)


def test_pipeline_against_a_plain_one(spark, data, tmp_path):
    docs = pq.read_table(f"{data}/documents.parquet").select(["doc_id", "text", "lang", "source", "n_chars"]).to_pylist()[:120]
    passage = " ".join(f"gemeinsam{k}" for k in range(70))
    base = next(d["text"] for d in docs if d["text"] and 200 < len(d["text"].split()) < 2000)
    near = base.split()
    near[len(near) // 2] = "anders"
    extra = ["12 34 ½ ² !!", None, "", " ".join(near), f"one head {passage} one tail", f"two head {passage} two tail", "write to jo@example.org or call +49 30 1234567 now", "write to jo@example.org or call +49 30 1234567 now"]
    docs += [{"doc_id": 10_000 + k, "text": t, "lang": None, "source": "x", "n_chars": len(t or "")} for k, t in enumerate(extra)]
    pq.write_table(pa.Table.from_pylist(docs, schema=pq.read_schema(f"{data}/documents.parquet").empty_table().select(["doc_id", "text", "lang", "source", "n_chars"]).schema), tmp_path / "documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = {d["doc_id"]: d["text"] for d in docs if any(c.isalpha() for c in d["text"] or "")}  # 1: all that has a letter is some language's
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    sets = {}
    for i, t in kept.items():
        w = words(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    group = {i: i for i in kept}
    for a in sorted(kept):  # 2: near copies
        for b in sorted(kept):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    kept = {i: t for i, t in kept.items() if group[i] == i}
    first = {}
    for i in sorted(kept):  # 3: repeated passages
        w = words(kept[i])
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    cut = {}
    for i, t in kept.items():
        w = words(t)
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(50)}
        cut[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t
    tokenizer, ids = Tokenizer.from_file(P.path("word_bpe_49k.json")), {}
    for i, t in cut.items():  # 4: personal data; 5: ids
        spans = sorted((int(a), int(z), k) for k, a, z in (s.split(":") for s in plain_spans(t)))
        out, at = "", 0
        for a, z, k in spans:
            if a >= at:
                out += t[at:a] + f"[{k.upper()}]"
            at = max(at, z)
        ids[i] = np.array([*tokenizer.encode(out + t[at:], add_special_tokens=False).ids, 1], "<u4")
    assert {10_000, 10_001, 10_002, 10_003, 10_007}.isdisjoint(ids) and "email" in tokenizer.decode(ids[10_006].tolist())
    seen = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == seen.get(r["doc_id"], 0) and zlib.crc32(own.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]] = r["start"] + r["length"]
    assert seen == {i: len(x) for i, x in ids.items()}

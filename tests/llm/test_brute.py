"""The queries that SQL can't express, against plain versions on the small tables."""

import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagelore.llm import bpe, langid, mpegts, packing, pii, simhash, substrings, topk
from pagelore.llm.common import Scratch
from pagelore.llm.queries import QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(data):
    t = pq.read_table(f"{data}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True))


def test_simhash(spark, data, documents):
    prints = {}
    for i, text in documents.items():
        w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = QUERIES["op3_simhash_bk_trees"](spark, data).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{prints[i]:016x}", find(i)) for i in ids}


def test_trees_skip_leaves_where_vectors_lie_in_groups():
    rng = np.random.default_rng(6)
    centres = rng.integers(-900, 900, (40, 16))
    rows = np.concatenate([c + rng.integers(-20, 21, (200, 16)) for c in centres])
    tree = topk.Tree(np.arange(len(rows)), rows)
    found = tree.search(np.arange(0, len(rows), 100), rows[::100], 10)
    leaves = sum(child < 0 for child in tree.left)
    assert tree.leaves_seen < 0.5 * leaves * len(found)
    for i, hits in zip(range(0, len(rows), 100), found, strict=True):
        scores = rows @ rows[i]
        want = sorted(((-int(s), j) for j, s in enumerate(scores.tolist()) if j != i))[:10]
        assert hits == [(-s, j) for s, j in want]


def test_top_k_over_regions(spark, monkeypatch):
    """Many small regions, shards and blocks; groups of vectors, equal vectors under many ids, two lengths."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 8))
    vectors = [(i, (centres[i % 12] + 0.05 * rng.normal(size=8)).tolist()) for i in range(1200)]
    vectors += [(2000 + i, [0.5] * 8) for i in range(300)] + [(3000 + i, rng.normal(size=3).tolist()) for i in range(40)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in topk.exact_top_k(df, F.col("vec_id") % 10 == 0, k=7, shard_rows=50).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: np.floor(np.array(v) * 1024).astype(int) for i, v in vectors}
    assert set(got) == {i for i in whole if i % 10 == 0}
    for i, hits in got.items():
        want = sorted((-int(whole[i] @ w), j) for j, w in whole.items() if j != i and len(w) == len(whole[i]))[:7]
        assert sorted(hits) == [(k + 1, j, -s) for k, (s, j) in enumerate(want)]


def test_bk_forest_finds_what_brute_force_finds():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = np.array([int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False)) for b in np.repeat(base, 20)], np.uint64)
    fps = np.unique(np.concatenate([base, near]))
    for radius in (0, 3, 4, 20):
        forest = simhash.Forest(fps, np.zeros(len(fps), int))
        pairs = {(int(q), int(n)) for qs, ns in forest.within(fps, np.zeros(len(fps), int), radius) for q, n in zip(qs, ns, strict=True)}
        d = np.bitwise_count(fps[:, None] ^ fps[None, :])
        assert pairs == {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= radius), strict=True)}


def test_chunked_cells_lose_no_link(spark):
    rng = random.Random(3)
    rows = []
    for g in range(5):
        centre = rng.getrandbits(64)
        for _ in range(40):
            v = centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
            rows.append((len(rows), v - (1 << 64) if v >> 63 else v))
    rows = list({fp: (i, fp) for i, fp in rows}.values())
    df = spark.createDataFrame(rows, "node long, fp long")
    keyed = df.selectExpr("1 as key", "node", "fp")
    for most in (1000, 7):
        with Scratch(spark) as scratch:
            got = simhash.components(simhash.links_in(simhash.cells_of(keyed, most, scratch), 4), scratch)
            group = {r["node"]: r["component"] for r in got.collect()}
        for i, a in rows:
            for j, b in rows:
                if i < j and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                    assert group[i] == group[j]


def test_packing(spark, data, documents):
    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in documents.items()}
    seen = {i: 0 for i in ids}
    rows = sorted(QUERIES["op4_sum_of_squares_packing"](spark, data).collect(), key=lambda r: (r["doc_id"], r["start"]))
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == seen[r["doc_id"]] and r["ids_crc32"] == zlib.crc32(own.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]] += r["length"]
    assert all(seen[i] == len(x) for i, x in ids.items())
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
    fills = [sum(n for _, n in pieces) for pieces in sequences.values()]
    assert all(n == 2048 or n & (n - 1) == 0 for n in fills) and sum(n < 2048 for n in fills) <= 11  # one task


def test_packing_keeps_what_the_levels_chose():
    rng = random.Random(7)
    out: dict[int, list] = {}
    packer = packing.SumOfSquares(128, lambda which, pieces: out.setdefault(which, []).append(pieces))
    sizes = [min(700, int(rng.lognormvariate(3.5, 1.2)) + 1) for _ in range(20_000)]
    for k, n in enumerate(sizes):
        packer.add(k, k.to_bytes(4, "little") * n)
    held_at_the_end = len(packer.open)
    packer.finish()
    assert all(len(x) == 1 for x in out.values())
    windows = [x[0] for x in out.values()]
    fills = [sum(len(p.ids) // 4 for p in w) for w in windows]
    assert sum(fills) == sum(sizes) and all(n == 128 or n & (n - 1) == 0 for n in fills)
    assert all(p.ids == p.doc_id.to_bytes(4, "little") * (len(p.ids) // 4) for w in windows for p in w)
    whole = sum(len(p.ids) // 4 for w in windows for p in w if p.placed) / sum(sizes)
    assert held_at_the_end < 200 and whole > 0.98


def test_parts_of_text_have_the_tokenizers_ids():
    own, plain = packing.ChunkIds(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(1)
    odd = ["<|endoftext|>a", "ΑΣ.Α ΑΣ", "it's I'LL 'S", "a\x0bb\x1cc\x85d e　f", "İ, Ⅷ², ª."]
    odd += ["".join(rng.choice("aZéÀäÖß²Ⅷª€!?#ΣσİsS .,́\n \x1c1٣<|>endoftext'") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    for text in odd:
        assert np.frombuffer(own.of(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_sum_of_squares_choice():
    placed = packing.SumOfSquares(10, lambda *_: None)
    rng = random.Random(2)
    for k in range(300):
        size = rng.randint(1, 9)
        before = placed.levels.copy()
        costs = {}
        for level in [0, *(h for h in range(1, 10) if before[h])]:
            if level + size <= 10:
                after = before.copy()
                after[level] -= level > 0
                after[level + size] += level + size < 10
                costs[level] = int((after[1:10] ** 2).sum())
        assert costs[placed.level_for(size)] == min(costs.values())
        placed.place(packing.Piece(k, 0, bytes(4 * size), size))


def test_bpe_is_the_librarys():
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Codec(ranks, P.PATTERN)
    rng = random.Random(4)
    texts = ["", "x" * 20_000, " " * 9_000 + "y", "é" * 5_000] + ["".join(rng.choice("abcdeé ñ\n  12…ßthein'st😀") for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    for text in texts:
        ids = own.encode(text)
        assert ids == plain.encode_ordinary(text)
        assert own.decode(ids, chunk=3) == text


def test_tokens_of_documents(spark, data, documents):
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    import hashlib

    for r in QUERIES["op9_transducer_bpe"](spark, data).collect():
        ids = plain.encode_ordinary(documents[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(documents[r["doc_id"]].encode()).hexdigest()


def test_language_held_out(spark, data):
    truth = dict(zip(*pq.read_table(f"{data}/documents.parquet").select(["doc_id", "lang"]).to_pydict().values(), strict=True))
    got = [r for r in QUERIES["op7_unigram_language"](spark, data).collect() if r["held_out"]]
    assert len(got) > 20 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) >= 0.95 * len(got)


def test_words_sum_over_all_segmentations():
    pieces = langid.Pieces(P.path("piece_bpe_32k.model"))
    logs = np.log(np.random.default_rng(0).dirichlet(np.ones(pieces.size), 3).T)
    model = langid.Model(pieces, ["a", "b", "c"], logs, np.zeros(3))
    words = ["ab", "there", "ünß", "你好", "𐍈" * 20, "x" * 64, "therefore"]
    for word, got in zip(words, model.word_logs(words), strict=True):
        text = langid.MARK + word
        sums = np.full((len(text) + 1, 3), -np.inf)
        sums[0] = 0
        for j in range(1, len(text) + 1):
            for i in range(j):
                if (row := pieces.rows.get(text[i:j])) is not None:
                    sums[j] = np.logaddexp(sums[j], sums[i] + logs[row])
                elif i == j - 1:
                    sums[j] = np.logaddexp(sums[j], sums[i] + sum(logs[pieces.bytes[b]] for b in text[i].encode()))
        assert np.allclose(got, sums[-1])


def segmentations(pieces, text):
    """All ways to write a marked word as rows of pieces, by trying each piece at each place."""
    if not text:
        yield []
        return
    for n in range(1, len(text) + 1):
        if (row := pieces.rows.get(text[:n])) is not None:
            for rest in segmentations(pieces, text[n:]):
                yield [row, *rest]
    if text[0] not in pieces.rows:
        for rest in segmentations(pieces, text[1:]):
            yield [*(pieces.bytes[b] for b in text[0].encode()), *rest]


def test_expected_counts_over_all_segmentations():
    pieces = langid.Pieces(P.path("piece_bpe_32k.model"))
    p = np.random.default_rng(1).dirichlet(np.ones(pieces.size), 2).T
    words, lang, n = ["ab", "there", "ünß", "你好", "ab", "therefore"], np.array([0, 1, 0, 1, 1, 0]), np.array([3.0, 1, 2, 5, 1, 4])
    want = np.zeros_like(p)
    for word, k, m in zip(words, lang, n, strict=True):
        ways = list(segmentations(pieces, langid.MARK + word))
        weights = np.array([np.prod(p[rows, k]) for rows in ways])
        for rows, w in zip(ways, weights / weights.sum(), strict=True):
            for row in rows:
                want[row, k] += m * w
    assert np.allclose(langid.expected_counts(pieces, p, lang, words, n), want, atol=1e-12)
    # long words and such as are too small for plain numbers go another road to the same sums
    longs, one = ["therefore" * 8, "你好吗" * 20, "x" * 70], np.zeros_like(p)
    pieces.long_counts("therefore", np.log(p[:, 0]), 4.0, one[:, 0])
    alone = langid.expected_counts(pieces, p, np.array([0]), ["therefore"], np.array([4.0]))
    assert np.allclose(one, alone)
    letters = np.zeros(pieces.size)  # of each piece: what it spells of a word of letters that are pieces themselves
    for piece, row in pieces.rows.items():
        letters[row] = len(piece)
    got = langid.expected_counts(pieces, p, np.array([0, 1, 0]), longs, np.ones(3))
    assert np.isclose(letters @ got[:, 0], len(longs[0]) + len(longs[2]) + 2) and (got >= 0).all()


def plain_words(text):
    import unicodedata

    out = [""]
    for c in (text or "").lower():
        out = [*out[:-1], out[-1] + c] if unicodedata.category(c)[0] == "L" else [*out, ""]
    return [w for w in out if w]


def test_language_query_against_brute_force(spark, tmp_path):
    rng = random.Random(10)
    letters = {"aa": "etaoin shr", "bb": "äöüßen ich", "cc": "你好吗我们 ab"}
    docs = []
    for i in range(60):
        lang = rng.choice(list(letters))
        docs.append((i, " ".join("".join(rng.choice(letters[lang].replace(" ", "")) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))), lang))
    docs += [(60, None, "aa"), (61, "", "aa"), (62, "½ ² ① Ⅷ 123", "bb"), (63, "x²y ⅷab", None), (64, "ether" * 40, "aa"), (65, "你" * 100, None), (66, "Nein", None)]
    import pyarrow as pa

    pq.write_table(pa.table({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": [d[1] for d in docs], "lang": [d[2] for d in docs]}), tmp_path / "documents.parquet")
    pieces = langid.Pieces(P.path("piece_bpe_32k.model"))
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learn = [(t, k) for i, t, k in docs if not held(i) and k and t is not None]
    langs = sorted({k for _, k in learn})

    def sums(word, logs):
        """Forward and backward sums in logarithms, trying each start for each end."""
        text = langid.MARK + word
        edges = []
        for j in range(1, len(text) + 1):
            edges += [(i, j, [pieces.rows[text[i:j]]]) for i in range(max(0, j - 16), j) if text[i:j] in pieces.rows]
            if text[j - 1] not in pieces.rows:
                edges.append((j - 1, j, [pieces.bytes[b] for b in text[j - 1].encode()]))
        ahead, back = np.full(len(text) + 1, -np.inf), np.full(len(text) + 1, -np.inf)
        ahead[0] = back[-1] = 0.0
        for i, j, rows in edges:
            ahead[j] = np.logaddexp(ahead[j], ahead[i] + logs[rows].sum())
        for i, j, rows in reversed(edges):
            back[i] = np.logaddexp(back[i], back[j] + logs[rows].sum())
        return edges, ahead, back

    p = np.full((pieces.size, len(langs)), 1 / pieces.size)
    for _ in range(3):
        counts = np.zeros_like(p)
        for text, lang in learn:
            k = langs.index(lang)
            for word in plain_words(text):
                edges, ahead, back = sums(word, np.log(p[:, k]))
                for i, j, rows in edges:
                    np.add.at(counts[:, k], rows, np.exp(ahead[i] + np.log(p[rows, k]).sum() + back[j] - ahead[-1]))
        counts += 0.01
        p = counts / counts.sum(0)
    share = np.log([sum(k == lang for _, k in learn) / len(learn) for lang in langs])
    got = {r["doc_id"]: r for r in QUERIES["op7_unigram_language"](spark, str(tmp_path)).collect()}
    assert len(got) == len(docs) and max(map(len, pieces.rows)) <= 16
    for i, text, _ in docs:
        assert got[i]["held_out"] == held(i)
        words = plain_words(text)
        if not words:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        logs = share + [sum(sums(w, np.log(p[:, k]))[1][-1] for w in words) for k in range(len(langs))]
        best = int(np.argmax(logs))
        assert got[i]["lang_pred"] == langs[best] and abs(got[i]["score"] - 1 / np.exp(logs - logs[best]).sum()) < 1e-3


def test_too_many_languages_are_refused(spark):
    docs = spark.createDataFrame([(i, "word", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs, P.path("piece_bpe_32k.model"), most_languages=4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(langid.train(docs, P.path("piece_bpe_32k.model"), rounds=1)[0]) == 5 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_quality_held_out(spark, data):
    labels = dict(zip(*pq.read_table(f"{data}/labels.parquet").select(["doc_id", "quality"]).to_pydict().values(), strict=True))
    got = [r for r in QUERIES["op2_quality_discriminant"](spark, data).collect() if r["held_out"] and r["doc_id"] in labels]
    assert got and sum(r["predicted"] == labels[r["doc_id"]] for r in got) >= 0.9 * len(got)


def plain_spans(text):
    out = []
    for kind in ("email", "ip", "card", "phone"):
        for m in re.finditer(pii.BASE_PATTERNS[kind].replace("[0-9]", "[0-9]"), text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card":
                odd = sum(sum(divmod(int(d) * 2, 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits)))
                if not 16 <= len(digits) <= 19 or odd % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_patterns(spark, documents):
    rng = random.Random(6)
    texts = list(documents.values()) + ["".join(rng.choice("ab@.-_+%1234 ()😀9") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["1.2.3.4.5.6.7.8", "a@b.c.d_e@f.g@h.i", "4111 1111 1111 1111 1", "+1 (234) 567-8901 +", "00010.1.1.1 256.1.1.1 1.1.1.0255", "5" * 30_000, "a" * 30_000, "1." * 20_000, "+1" + "(" * 20_000, "1 " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.digest(pii.find_spans(df)).collect():
        base = [s for s in r["spans"].split(",") if s and s.split(":")[0] in pii.BASE_KINDS]
        assert base == plain_spans(texts[r["doc_id"]]), texts[r["doc_id"]][:200]


def test_pii_many_matches(spark):
    """Texts with very many matches: the cost grows with them, not with their square, and every place is right."""
    phones = " x ".join(f"+49{i:09d}" for i in range(20_000))
    texts = [" ".join(f"{i:07d}" for i in range(200_000)), phones, "😀é" * 700 + " a@b.co " + "ß" * 1500 + " +4912345678 "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.digest(pii.find_spans(df)).collect()}
    assert got[0] == [""] and got[1] == plain_spans(phones) and got[2] == plain_spans(texts[2])
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[0] == texts[0] and clean[1] == " x ".join(["[PHONE]"] * 20_000) and clean[2] == "😀é" * 700 + " [EMAIL] " + "ß" * 1500 + " [PHONE] "


def test_checksums_and_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 ok", "IBAN DE89 3704 0044 0532 0130 01 no", "my ssn 123-45-6789", "order 123-45-6789"]
    got = [r["spans"] for r in pii.digest(pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).orderBy("doc_id").collect()]
    assert got[0] == "iban:5:32" and got[1] == "" and got[2] == "ssn:7:18" and got[3] == ""


def test_transport_stream_is_checked():
    data = bytes(range(256)) * 700
    media = mpegts.mux(data)
    back, units = mpegts.demux(media)
    assert back == data and [u[0] for u in units] == [k * mpegts.TICKS for k in range(len(units))] and units[0][2] and not units[1][2] and units[8][2]
    assert mpegts.crc32_mpeg(mpegts.PAT) == 0
    lost = media[: 188 * 5] + media[188 * 6 :]
    spoiled = bytearray(media)
    spoiled[188 + 20] ^= 1
    for bad in (lost, bytes(spoiled), media[:-1], b"x" + media[1:]):
        with pytest.raises(mpegts.Damaged):
            mpegts.demux(bad)
    for n in range(0, 800):
        assert mpegts.demux(mpegts.mux(b"y" * n))[0] == b"y" * n


@pytest.mark.parametrize("fan", [8192, 3])
def test_repeats_in_small_windows(spark, monkeypatch, fan):
    """fan 3: so few buckets that they are cut again, from spans of two chunks."""
    if fan < 100:
        monkeypatch.setattr(substrings, "MOST_FAN", fan)
        monkeypatch.setattr(substrings, "FAN_CHUNKS", 2)
        monkeypatch.setattr(substrings, "BUCKET_HASHES", 30)
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    for window in (4, 5, 9):
        got = {r["doc_id"]: r["text"].split() for r in substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), window=window, chunk_bytes=400).collect()}
        first = {}
        for i, t in docs:
            w = t.split()
            for k in range(len(w) - window + 1):
                first.setdefault(tuple(w[k : k + window]), i)
        for i, t in docs:
            w = t.split()
            gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(window)}
            assert got[i] == [x for k, x in enumerate(w) if k not in gone]


def test_similar_documents(spark):
    rng = random.Random(9)
    docs = []
    for g in range(30):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
        docs.append((len(docs), " ".join(words)))
        for edits in (2, 4, 60):
            other = list(words)
            for k in rng.sample(range(300), edits):
                other[k] = f"e{rng.randint(0, 10**6)}"
            docs.append((len(docs), " ".join(other)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(296)} for _, t in docs]
    for g in range(0, len(docs), 4):
        assert got[g] == got[g + 1] == got[g + 2] == g and len(sets[g] & sets[g + 3]) / len(sets[g] | sets[g + 3]) < 0.7 and got[g + 3] == g + 3


def test_similar_pairs_close_to_the_limit(spark):
    """One word in twelve places or so changed: similarities between 0.77 and 0.85, which an estimate would mix up."""
    rng = random.Random(11)
    texts, truth = [], []
    while len(truth) < 300:
        words = [f"w{rng.randint(0, 50_000)}" for _ in range(300)]
        other = list(words)
        for k in rng.sample(range(300), rng.randint(5, 8)):
            other[k] = f"e{rng.randint(0, 10**6)}"
        a, b = ({tuple(x[k : k + 5]) for k in range(296)} for x in (words, other))
        if 0.77 <= len(a & b) / len(a | b) <= 0.85:
            texts += [" ".join(words), " ".join(other)]
            truth.append(len(a & b) / len(a | b) >= 0.8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert 50 < sum(truth) < 250 and [got[2 * i + 1] == got[2 * i] for i in range(300)] == truth


def test_sets_in_chunks_link_as_by_brute_force(spark):
    rng = random.Random(12)
    base = [rng.getrandbits(63) for _ in range(60)]
    sets = [sorted(rng.sample(base, 52) + [rng.getrandbits(63) for _ in range(rng.randint(0, 4))]) for _ in range(80)]
    rows = [(7, i, len(x), np.array(x, "<u8").tobytes()) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "key long, node long, size long, shingles binary")
    label = np.arange(80)
    for i in range(80):
        for j in range(i):
            if len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= 0.8:
                simhash.join_labels(label, np.array([i]), np.array([j]))
    for most in (1000, 9):
        with Scratch(spark) as scratch:
            found = simhash.components(simhash.set_links(simhash.cells_of(df, most, scratch), 0.8), scratch)
            group = {r["node"]: r["component"] for r in found.collect()}
        assert [group.get(i, i) for i in range(80)] == label.tolist() and 2 < len(set(label.tolist())) < 79


def test_large_loose_groups_link_as_by_brute_force(spark, monkeypatch):
    """Groups of many chunks: all near one member, near several, chained, and with strays."""
    rng = random.Random(21)
    rows, sets = [], {}
    for key, centres in enumerate((1, 2, 4, 12)):
        bases = [[rng.getrandbits(63) for _ in range(40)]]
        for _ in range(centres - 1):  # a chain: each next to the one before
            bases.append(bases[-1][rng.randint(3, 9) :] + [rng.getrandbits(63) for _ in range(rng.randint(3, 9))])
        for _ in range(70):
            own = set(rng.choice(bases))
            for _ in range(rng.randint(0, 3)):
                own.discard(rng.choice(sorted(own)))
                own.add(rng.getrandbits(63))
            node = rng.getrandbits(62)
            sets[node] = (key, own)
            rows.append((key, node, len(rows), len(own)))
    loose = spark.createDataFrame(rows, "key long, node long, least long, size long")
    shingles = spark.createDataFrame([(n, np.array(sorted(x), "<u8").tobytes()) for n, (_, x) in sets.items()], "of long, shingles binary")
    nodes = sorted(sets)
    label = np.arange(len(nodes))
    for i, a in enumerate(nodes):
        for j in range(i):
            (ka, x), (kb, y) = sets[a], sets[nodes[j]]
            if ka == kb and len(x & y) / len(x | y) >= 0.8:
                simhash.join_labels(label, np.array([i]), np.array([j]))
    want = {n: nodes[label[i]] for i, n in enumerate(nodes)}
    assert 4 < len(set(want.values())) < len(nodes)
    for most, shingles_most in ((1000, 1 << 18), (9, 1 << 18), (1000, 600)):
        monkeypatch.setattr(simhash, "MOST_SHINGLES", shingles_most)
        with Scratch(spark) as scratch:
            found = simhash.components(simhash.verified_links(loose, shingles, 0.8, most, scratch), scratch)
            group = {r["node"]: r["component"] for r in found.collect()}
        assert {n: group.get(n, n) for n in nodes} == want


def test_repeated_lines_do_not_hide_near_copies(spark):
    rng = random.Random(13)
    texts = []
    for _ in range(50):
        text, line = (" ".join(f"w{rng.randint(0, 50_000)}" for _ in range(n)) for n in (300, 10))
        texts += [text, text + f" {line}" * 30]
        a, b = ({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts[-2:])
        assert len(a & b) / len(a | b) > 0.94
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(50)) == 50

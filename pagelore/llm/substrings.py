"""Exact repeats of long passages, by fixed-block anchors.

Every document is cut into blocks of b words that don't overlap, b being half a window. A window of w >= 2b - 1 words
holds a whole block of each document that it lies in, wherever it begins; so all that two documents share shows
as a block of one met by some run of b words of the other. The blocks are the index; every run of b words probes
it. Around the hits, the windows themselves are compared and overlapping ones join to maximal repeats.

Texts are shuffled once, into chunks of a few MB. Both exchanges carry sorted hashes, packed in arrays: a chunk says
each hash once, however often it occurs, and gets one bit back for it. So a passage that a third of all documents share is
one entry a chunk. A probe is 32 bits and its bucket's number (a false hit only makes a window be compared); windows are
compared by 128 bits, two hashes of 64 bits with bases of their own, over words of 64 bits each.

Rows that repeat an id and its text stand as one row, whose outcome all of them take: however often a row comes, no
chunk holds it twice.

Defined results: a null text has no words; a row whose id is null loses nothing and is no reference; rows with one id
are one document for "smaller"; a repeat within one document stays; an empty table gives an empty table. The
columns of the documents are carried through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelore.llm.common import held, tune, written

#: Text bytes of a chunk and hashes of a bucket: each is what one call holds. Larger executors take larger ones: fewer, longer rows.
CHUNK_BYTES, BUCKET_HASHES = 2 << 20, 1 << 20
#: Buckets that a chunk deals its hashes to, at most. Where more are needed, buckets are cut again, from the hashes of FAN_CHUNKS chunks at once.
MOST_FAN, FAN_CHUNKS = 8192, 1 << 14
_U = np.uint64
BYTE_BASE, WORD_BASES = 0x9E3779B97F4A7C15, (0xD1342543DE82EF95, 0xC6BC279692B5C323)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), mod 2 ** 64."""
    known = held(("powers",), dict)
    found = known.get(base)
    if found is None or len(found) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        found = np.ones(1, _U)
        while len(found) < size:
            found = np.concatenate([found, found * _U(pow(base, len(found), 1 << 64))])
        if size <= 1 << 22:
            known[base] = found
    return found[:n]


class Chunk:
    """The words of some documents, as hashes."""

    def __init__(self, texts: list[bytes], takes_part: np.ndarray):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        outside = SEPARATOR[data]
        begin = ~outside
        begin[1:] &= outside[:-1]
        self.starts = np.flatnonzero(begin)
        last = ~outside
        last[:-1] &= outside[1:]
        self.ends = np.flatnonzero(last) + 1
        n = len(self.starts)
        if n:
            wide = np.diff(np.append(self.starts, len(data)))
            base = powers(BYTE_BASE, int(wide.max()))
            local = np.arange(self.starts[0], len(data), dtype=np.int32) - np.repeat(self.starts.astype(np.int32), wide)
            terms = base[local]
            del local
            terms *= data[self.starts[0] :].astype(_U) + _U(1)
            terms[outside[self.starts[0] :]] = 0
            self.hashes = mixed(np.add.reduceat(terms, self.starts - self.starts[0]) + (self.ends - self.starts).astype(_U) * _U(0xA24BAED4963EE407))
        else:
            self.hashes = np.zeros(0, _U)
        edges = np.concatenate([[0], np.cumsum(lengths)])
        self.first = np.searchsorted(self.starts, edges)  # of each document's words; one more at the end
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.place = np.arange(n) - self.first[self.doc]
        self.takes_part = takes_part

    def runs(self, size: int) -> np.ndarray:
        """The first words of all runs of `size` words within one document that takes part."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        inside = self.doc[:n] == self.doc[size - 1 :]
        return np.flatnonzero(inside & self.takes_part[self.doc[:n]])

    def run_hashes(self, at: np.ndarray, size: int, base: int) -> np.ndarray:
        """Hash of the run at each place: a polynomial, by differences of running sums."""
        n = len(self.hashes)
        sums = np.concatenate([[_U(0)], np.cumsum(self.hashes * powers(base, n), dtype=_U)])
        back = powers(pow(base, -1, 1 << 64), n)
        return mixed((sums[at + size] - sums[at]) * back[at])


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, byte planes first, compressed."""
    parts = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unsqueeze(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize * n
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(-1, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size
    return out


def steps(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


class Probes:
    """The different runs of b words of a chunk, in order of bucket and value (of so many bits)."""

    def __init__(self, chunk: Chunk, size: int, buckets: int, bits: int):
        self.at = chunk.runs(size)
        hashes = chunk.run_hashes(self.at, size, WORD_BASES[0])
        self.mask, self.kind = _U((1 << bits) - 1), np.uint32 if bits == 32 else _U
        keys = (hashes >> _U(bits)) % _U(buckets) << _U(bits) | hashes & self.mask
        self.keys, self.which = np.unique(keys, return_inverse=True)
        indexed = np.zeros(len(self.keys), np.uint8)
        indexed[self.which[chunk.place[self.at] % size == 0]] = 1
        low, high = np.full(len(self.keys), len(chunk.first)), np.full(len(self.keys), -1)
        np.minimum.at(low, self.which, chunk.doc[self.at])
        np.maximum.at(high, self.which, chunk.doc[self.at])
        self.flags = indexed | (low < high).astype(np.uint8) << 1
        self.bounds = np.searchsorted(self.keys, np.arange(buckets + 1, dtype=_U) << _U(bits))

    def rows(self) -> Iterator[tuple[int, int, bytes]]:
        for b in np.flatnonzero(np.diff(self.bounds)).tolist():
            own = slice(self.bounds[b], self.bounds[b + 1])
            yield b, own.stop - own.start, squeeze(steps((self.keys[own] & self.mask).astype(self.kind)), self.flags[own])


def settle_probes(rows: list[tuple[int, bytes]], bits: int) -> list[np.ndarray]:
    """Of each entry of each chunk: is its run a block of some document, and in two documents or more?"""
    values, flags = gathered(rows, *columns_of(0, bits))
    order = np.argsort(values, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], np.diff(values[order]) != 0]))
    count = np.diff(np.append(heads, len(order)))
    any_flag = np.bitwise_or.reduceat(flags[order], heads)
    hit = (any_flag & 1 > 0) & ((count > 1) | (any_flag & 2 > 0))
    out = np.empty(len(order), bool)
    out[order] = np.repeat(hit, count)
    return np.split(out, np.cumsum([n for n, _ in rows])[:-1])


class Windows:
    """The different windows around hits of a chunk, in order of bucket and hash, each with its least document."""

    def __init__(self, chunk: Chunk, ids: np.ndarray, hit: np.ndarray, probes: Probes, size: int, block: int, buckets: int):
        marked = np.zeros(len(chunk.hashes) + 1, np.int64)
        marked[1:][probes.at[hit[probes.which]]] = 1
        seen = np.cumsum(marked)
        at = chunk.runs(size)
        self.at = at[seen[at + size - block + 1] > seen[at]]
        one, two = (chunk.run_hashes(self.at, size, base) for base in WORD_BASES)
        bucket = two % _U(buckets)
        order = np.lexsort((two, one, bucket))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(fresh) - 1
        self.hashes, self.seconds, self.buckets = one[order][fresh], two[order][fresh], bucket[order][fresh]
        self.least = np.full(len(self.hashes), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.which, ids[chunk.doc[self.at]])
        self.bounds = np.searchsorted(self.buckets, np.arange(buckets + 1, dtype=_U))

    def rows(self) -> Iterator[tuple[int, int, bytes]]:
        for b in np.flatnonzero(np.diff(self.bounds)).tolist():
            own = slice(self.bounds[b], self.bounds[b + 1])
            yield b, own.stop - own.start, squeeze(steps(self.hashes[own]), self.seconds[own], self.least[own])


def settle_windows(rows: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """Of each entry of each chunk: is there a smaller document elsewhere that has the window?"""
    values, seconds, least = gathered(rows, *columns_of(1, 0))
    order = np.lexsort((seconds, values))
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(values[order]) != 0) | (np.diff(seconds[order]) != 0)]))
    count = np.diff(np.append(heads, len(order)))
    smallest = np.empty(len(order), np.int64)
    smallest[order] = np.repeat(np.minimum.reduceat(least[order], heads), count)
    return np.split(smallest < least, np.cumsum([n for n, _ in rows])[:-1])


def columns_of(kind: int, bits: int) -> tuple[str, ...]:
    """What an entry is packed as; the first is sorted and written in steps."""
    return ("<u8", "<u8", "<i8") if kind else ("<u4" if bits == 32 else "<u8", "u1")


def gathered(rows: list[tuple[int, bytes]], *columns: str) -> list[np.ndarray]:
    """The entries of packed rows, one row after the other."""
    parts = []
    for n, data in rows:
        first, *rest = unsqueeze(data, n, *columns)
        parts.append([np.cumsum(first, dtype=first.dtype), *rest])
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def recut(rows: list[tuple[int, bytes]], kind: int, bits: int, parts: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The entries of many chunks in order, the order, and where each of `parts` equal ranges of values begins."""
    columns = gathered(rows, *columns_of(kind, bits))
    order = np.lexsort(columns[1::-1]) if kind else np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    wide = 64 if kind else bits
    edges = np.array([(j << wide) // parts for j in range(parts)], _U).astype(columns[0].dtype)
    return columns, order, np.append(np.searchsorted(columns[0], edges), len(order))


def said_back(table: pa.Table, kind: int, bounds: np.ndarray, n: int) -> np.ndarray:
    """The bits that came back for a chunk's entries; a bucket that sent none has none set."""
    out = np.zeros(n, bool)
    for k, b, data in zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["data"].to_pylist(), strict=True):
        if k == kind:
            a, z = int(bounds[b]), int(bounds[b + 1])
            raw = zstandard.ZstdDecompressor().decompress(data)
            out[a:z] = np.unpackbits(np.frombuffer(raw, np.uint8), count=z - a)
    return out


PACKED = "chunk int, kind int, bucket int, n int, data binary"
_PACKED = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])


def packed(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED) if rows else _PACKED.empty_table()


def documents_of(table: pa.Table) -> tuple[pa.StructArray, np.ndarray, np.ndarray, list[bytes]]:
    """The rows of a chunk in order of id, ids, who takes part, texts."""
    rows = table["row"].combine_chunks()
    ids = rows.field("doc_id")
    rows = rows.take(pc.sort_indices(ids))
    ids = rows.field("doc_id")
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in rows.field("text").to_pylist()]
    return rows, ids.fill_null(0).to_numpy(zero_copy_only=False), np.array(ids.is_valid()), texts


def remove_repeats(docs: DataFrame, *, window: int = 50, with_text: bool = True, digests: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The documents' columns, `text` without the words of windows that a smaller document has too; n_words, n_removed.

    A text that loses nothing stays as it is; in others, runs of kept words are joined by one space. `digests` adds
    kept_sha256, of all kept words joined by one space. With with_text=False only doc_id and the figures are returned.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    tune(docs.sparkSession)
    rows = docs.groupBy(F.xxhash64("doc_id", "text").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("size"))
    total, again = rows.agg(F.sum(F.col("size").cast("double")), F.count_if(F.col("n") > 1)).first()
    cut = lambda df, **more: _remove_repeats(df, window, digests=digests, chunk_bytes=chunk_bytes, total=total or 0.0, **more)
    if not again:
        return cut(docs, with_text=with_text)
    # repeated rows: one of each stands for all
    own, others, first = (_unused(docs.columns, name) for name in ("repeat key", "its repeat key", "stands for"))
    text = F.coalesce(F.concat(F.lit("="), F.col("text")), F.lit("none"))
    keyed = docs.withColumn(own, F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.sha2(text.cast("binary"), 256)))
    many = written(keyed.groupBy(own).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(own).alias(others)), "repeated-rows")
    single = keyed.join(many, F.col(own) == F.col(others), "left_anti").withColumn(first, F.lit(None).cast("string")).drop(own)
    several = keyed.join(many, F.col(own) == F.col(others), "left_semi")
    firsts = several.groupBy(own).agg(F.first(F.struct("doc_id", "text")).alias("r")).select("r.doc_id", "r.text", F.col(own).alias(first))
    outcome = cut(single.unionByName(firsts, allowMissingColumns=True), with_text=True)
    figures = outcome.columns[len(docs.columns) + 1 :]
    plain = [_unused(docs.columns, f"of the text: {c}") for c in figures]  # the documents may have columns of such names
    done = written(outcome.toDF(*docs.columns, first, *plain), "repeats-cut")
    new = _unused(docs.columns, "new text")
    told = done.where(F.col(first).isNotNull()).select(F.col(first).alias(others), F.col("text").alias(new), *[F.col(f"`{c}`") for c in plain])
    spread = several.join(told, F.col(own) == F.col(others)).withColumn("text", F.col(new))
    columns = docs.columns if with_text else ["doc_id"]
    shown = [F.col(f"`{c}`") for c in (*columns, *plain)]
    return done.where(F.col(first).isNull()).select(*shown).unionByName(spread.select(*shown)).toDF(*columns, *figures)


def _unused(columns: list[str], name: str) -> str:
    """The name, or with marks behind it until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def _remove_repeats(docs: DataFrame, window: int, *, with_text: bool, digests: bool, chunk_bytes: int, total: float) -> DataFrame:
    """As remove_repeats, of rows that don't repeat; total: bytes of their texts."""
    block = (window + 1) // 2
    chunks, needed = max(1, int(total // chunk_bytes) + 1), max(1, int(total / 6 // BUCKET_HASHES) + 1)
    buckets, parts = min(needed, MOST_FAN), -(-needed // MOST_FAN)
    bits = 32 if parts == 1 else 44
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), row.alias("row"))

    def probe(table: pa.Table) -> pa.Table:
        _, _, part, texts = documents_of(table)
        chunk = table["chunk"][0].as_py()
        return packed([(chunk, 0, *r) for r in Probes(Chunk(texts, part), block, buckets, bits).rows()])

    def settled(entries: list[tuple[int, bytes]], kind: int) -> list[np.ndarray]:
        return settle_windows(entries) if kind else settle_probes(entries, bits)

    def said(bits_of: np.ndarray) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(np.packbits(bits_of).tobytes())

    def entries_of(table: pa.Table) -> list[tuple[int, bytes]]:
        return list(zip(table["n"].to_pylist(), table["data"].to_pylist(), strict=True))

    def settle(table: pa.Table) -> pa.Table:
        kind, entries = table["kind"][0].as_py(), entries_of(table)
        return packed([(c, kind, b, n, said(x)) for c, b, (n, _), x in zip(table["chunk"].to_pylist(), table["bucket"].to_pylist(), entries, settled(entries, kind), strict=True) if x.any()])

    # buckets too large for one call: cut again by ranges of values, from the hashes of many chunks at once

    def in_order(table: pa.Table) -> pa.Table:
        return table.sort_by("chunk")

    def cut_again(table: pa.Table) -> pa.Table:
        table = in_order(table)
        kind, bucket, span = (table[c][0].as_py() for c in ("kind", "bucket", "span"))
        columns, _, edges = recut(entries_of(table), kind, bits, parts)
        rows = [(span, kind, bucket, z - a, squeeze(steps(columns[0][a:z]), *[c[a:z] for c in columns[1:]]), j) for j, (a, z) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if z > a]
        arrays = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), [*_PACKED.types, pa.int32()], strict=True)]
        return pa.Table.from_arrays(arrays, [*("span" if c == "chunk" else c for c in _PACKED.names), "part"])

    def settle_part(table: pa.Table) -> pa.Table:
        kind, entries = table["kind"][0].as_py(), entries_of(table)
        out = [(s, kind, b, n, said(x), j) for s, b, (n, _), x, j in zip(table["span"].to_pylist(), table["bucket"].to_pylist(), entries, settled(entries, kind), table["part"].to_pylist(), strict=True) if x.any()]
        kinds = [*_PACKED.types, pa.int32()]
        arrays = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
        return pa.Table.from_arrays(arrays, [*("span" if c == "chunk" else c for c in _PACKED.names), "part"])

    def put_back(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _PACKED.empty_table()
        left = in_order(left)
        kind, bucket = (left[c][0].as_py() for c in ("kind", "bucket"))
        _, order, edges = recut(entries_of(left), kind, bits, parts)
        found = np.zeros(len(order), bool)
        for j, data in zip(right["part"].to_pylist(), right["data"].to_pylist(), strict=True):
            a, z = int(edges[j]), int(edges[j + 1])
            found[a:z] = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), count=z - a)
        back = np.empty(len(order), bool)
        back[order] = found
        n = left["n"].to_numpy()
        pieces = np.split(back, np.cumsum(n)[:-1])
        return packed([(c, kind, bucket, int(k), said(x)) for c, k, x in zip(left["chunk"].to_pylist(), n, pieces, strict=True) if x.any()])

    def exchanged(asked: DataFrame) -> DataFrame:
        """What the buckets say to each chunk's entries."""
        if parts == 1:
            return asked.groupBy("bucket").applyInArrow(settle, PACKED)
        asked = asked.withColumn("span", F.floor(F.col("chunk") / FAN_CHUNKS).cast("int"))
        shape = PACKED.replace("chunk int", "span int") + ", part int"
        again = asked.groupBy("bucket", "span").applyInArrow(cut_again, shape)
        answers = again.groupBy("bucket", "part").applyInArrow(settle_part, shape)
        return asked.groupBy("bucket", "span").cogroup(answers.groupBy("bucket", "span")).applyInArrow(put_back, PACKED)

    def windows_of(left: pa.Table, right: pa.Table) -> tuple[pa.StructArray, np.ndarray, list[bytes], Chunk, Windows]:
        rows, ids, part, texts = documents_of(left)
        chunk = Chunk(texts, part)
        probes = Probes(chunk, block, buckets, bits)
        hit = said_back(right, 0, probes.bounds, len(probes.keys))
        return rows, ids, texts, chunk, Windows(chunk, ids, hit, probes, window, block, buckets)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _PACKED.empty_table()
        chunk = left["chunk"][0].as_py()
        return packed([(chunk, 1, *r) for r in windows_of(left, right)[-1].rows()])

    columns = docs.schema.fields if with_text else [docs.schema["doc_id"]]
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), *([T.StructField("kept_sha256", T.StringType())] if digests else [])]
    shape = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(columns)], *added])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, ids, texts, chunk, found = windows_of(left, right)
        smaller = said_back(right, 1, found.bounds, len(found.hashes))
        gone = smaller[found.which] | (ids[chunk.doc[found.at]] > found.least[found.which])
        edge = np.zeros(len(chunk.hashes) + 1, np.int64)
        np.add.at(edge, found.at[gone], 1)
        np.add.at(edge, found.at[gone] + window, -1)
        keep = np.cumsum(edge)[:-1] == 0
        first = chunk.first.tolist()
        kept = np.concatenate([[0], np.cumsum(keep)])[chunk.first]
        n_words, n_kept = np.diff(chunk.first), np.diff(kept)
        texts_out, hashes = [], []
        for k, text in enumerate(texts):
            touched = n_kept[k] != n_words[k]
            if digests or touched:
                words = text.split()
                left_words = b" ".join(compress(words, keep[first[k] : first[k + 1]])) if touched else b" ".join(words) if digests else b""
                if digests:
                    hashes.append(hashlib.sha256(left_words).hexdigest())
                if touched:
                    texts_out.append((k, left_words.decode("utf-8", "surrogatepass")))
        arrays = []
        for f in columns:
            array = rows.field(f.name)
            if f.name == "text" and texts_out:
                new = array.to_pylist()
                for k, t in texts_out:
                    new[k] = t
                array = pa.array(new, pa.string())
            arrays.append(array)
        arrays += [pa.array(n_words, pa.int64()), pa.array(n_words - n_kept, pa.int64()), *([pa.array(hashes, pa.string())] if digests else [])]
        return pa.Table.from_arrays(arrays, [f.name for f in shape])

    asked = dealt.groupBy("chunk").applyInArrow(probe, PACKED)
    answers = exchanged(asked)
    compared = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(compare, PACKED)
    both = answers.unionByName(exchanged(compared))
    out = dealt.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(cut, shape)
    return out.toDF(*[f.name for f in columns], *[f.name for f in added])

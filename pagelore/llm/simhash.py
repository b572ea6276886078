"""SimHash near-duplicates with BK-trees.

A text's fingerprint is the majority of the bits of its shingles' hashes. Different fingerprints are routed to cells
such that any two that may link meet in a cell; each cell becomes one BK-tree, whose children are keyed by their Hamming
distance to the parent, and a search follows only the edges within the radius. Trees of many cells are grown and
searched together, level by level, as arrays. A cell sends back one link for each member to the least
member of its group, never pairs; a cell of more than `most` members is cut into chunks, and each pair of chunks is
a cell of its own. Links are joined by connected components over the whole table.

Two ways of routing. `bands`: the 64 bits are cut into radius + r blocks; fingerprints within the radius agree in r
blocks at least, so a cell for each choice of r blocks loses nothing; r is chosen by the number of fingerprints.
`sketches` (for shingle similarity): cells by groups of min-hashes; the share of equal min-hashes, with a wide margin, only
says which documents may link, and the sets of shingles of these are then compared themselves.

Defined results: a null text is the empty text; a text without words has fingerprint zero and links like any other;
a text with fewer words than a shingle is one shingle; a row whose id is null gets a fingerprint, links with nothing,
and has no component; rows with one fingerprint (`sketches`: one set of shingles) are one node, a component has the least
id of its rows; an empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelore.llm.common import Scratch, held, tune, written
from pagelore.llm.components import components

SEED, MIN_HASHES, BAND_WIDTH, BANDS = 42, 256, 3, 16
#: Shingles in a chunk of a cell whose sets are compared: 2 MB.
MOST_SHINGLES = 1 << 18
#: Rounds in which a large loose group is compared with one member of it, before what is left is compared among itself.
PIVOTS = 2
_RANDOM = np.random.default_rng(20240501)
_A = _RANDOM.integers(1, 1 << 63, MIN_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, MIN_HASHES, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words, joined by one space; A-Z lower-cased. bytes.split() cuts at 0x20 and 0x09-0x0D."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    whole = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[: len(parts) - words]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65536):
        block = hashes[a : a + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    out = np.full(MIN_HASHES, np.iinfo(np.uint64).max, np.uint64)
    hashes = np.unique(hashes)
    for a in range(0, len(hashes), 1024):
        out = np.minimum(out, (hashes[a : a + 1024, None] * _A + _B).min(0))
    return out


def set_key(hashes: np.ndarray) -> int:
    """The key of a set of shingles, from its sorted hashes."""
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED)


def signed(values: np.ndarray | list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, *, words: int = 4) -> DataFrame:
    """doc_id, fp: the 64 bits as a long."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(shingle_hashes(t or "", words)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), signed(prints)], ["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def sketches(docs: DataFrame, *, words: int = 5) -> DataFrame:
    """doc_id, fp, key and size (all of the set of shingles), sketch (16 bits a min-hash), bands (keys of the groups of min-hashes)."""
    tune(docs.sparkSession)

    def one(text: str) -> tuple[int, int, int, bytes, list[int]]:
        own = np.unique(shingle_hashes(text, words))  # of the set: repeats would hide a near copy from the fingerprint
        low, fp = min_hashes(own), fingerprint(own)
        sketch = ((low * _MIX) >> np.uint64(48)).astype("<u2").tobytes()
        bands = [xxhash.xxh64_intdigest(low[BAND_WIDTH * t : BAND_WIDTH * (t + 1)].tobytes(), t) for t in range(BANDS)]
        return fp, set_key(own), len(own), sketch, bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("sketches",), dict)  # what another operator kept in this worker goes
        for batch in batches:
            got = [one(t or "") for t in batch.column("text").to_pylist()]
            fp, key, size, sketch, bands = zip(*got, strict=True) if got else ((), (), (), (), ())
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * BANDS), signed([b for x in bands for b in x]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), signed(list(fp)), signed(list(key)), pa.array(size, pa.int64()), pa.array(sketch, pa.binary()), flat], ["doc_id", "fp", "key", "size", "sketch", "bands"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, fp long, key long, size long, sketch binary, bands array<long>")


def shingle_sets(docs: DataFrame, *, words: int = 5) -> DataFrame:
    """key, shingles (the sorted hashes, 8 bytes each)."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t or "", words)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([signed([set_key(x) for x in sets]), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())], ["key", "shingles"])

    return docs.select("text").mapInArrow(run, "key long, shingles binary")


def block_choices(radius: int, n: int, load: int = 64) -> list[tuple[int, ...]]:
    """Bits of each choice of r of radius + r blocks, r such that n fingerprints make cells of about `load` or fewer."""
    r = 1
    while radius + r < 64 and (n >> (64 * r // (radius + r))) > load and r < 5:
        r += 1
    edges = np.linspace(0, 64, radius + r + 1).astype(int)
    blocks = [tuple(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [tuple(bit for b in chosen for bit in blocks[b]) for chosen in combinations(range(len(blocks)), r)]


def band_keys(fp: Column, choices: list[tuple[int, ...]]) -> Column:
    """array<long>: for each choice a hash of its number and of those bits."""
    masks = [sum(1 << b for b in bits) for bits in choices]
    return F.array(*[F.xxhash64(F.lit(t), fp.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for t, m in enumerate(masks)])


class Forest:
    """BK-trees of many cells at once, grown level by level: the first of those at one distance of a node is its child there."""

    def __init__(self, fp: np.ndarray, cell: np.ndarray):
        """fp: different ones in each cell; cell: sorted numbers of the cells."""
        self.fp = fp
        n = len(fp)
        first = np.concatenate([[True], cell[1:] != cell[:-1]]) if n else np.zeros(0, bool)
        self.root = np.flatnonzero(first)
        parent = np.repeat(self.root, np.diff(np.append(self.root, n))) if n else np.zeros(0, np.int64)
        keys, nodes = [], []
        left = np.flatnonzero(~first)
        while left.size:
            key = parent[left] * 65 + np.bitwise_count(fp[left] ^ fp[parent[left]])
            order = np.argsort(key, kind="stable")
            left, key = left[order], key[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            heads = left[new]
            keys.append(key[new])
            nodes.append(heads)
            parent[left] = heads[np.cumsum(new) - 1]
            left = left[~new]
        keys, nodes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, nodes))
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], nodes[order]

    def within(self, query_fp: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) of each pair within the radius, level by level; each query searches the tree with its root."""
        query, node = np.arange(len(query_fp)), root
        while query.size:
            d = np.bitwise_count(query_fp[query] ^ self.fp[node]).astype(np.int64)
            near = d <= radius
            yield query[near], node[near]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right")
            wide = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(wide)[:-1]]), wide) + np.arange(wide.sum()) if wide.size else low
            query, node = np.repeat(query, wide), self.nodes[at]


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make the labels of each pair (a, b) equal to the least of their groups, in place."""
    while a.size:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def link_cells(nodes: list[np.ndarray], prints: list[np.ndarray], sides: list[np.ndarray], marks: list[np.ndarray] | None, radius: int, agree: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its group) in each cell. sides: 0 and 1 where two chunks meet; marks: sketches to check."""
    cell = np.repeat(np.arange(len(nodes)), [len(x) for x in nodes])
    node, fp, side = (np.concatenate(x) for x in (nodes, prints, sides))
    order = np.lexsort((side, node, cell))  # node order: labels then are the least node of a group
    cell, node, fp, side = cell[order], node[order], fp[order], side[order]
    mark = np.concatenate(marks)[order] if marks else None
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    mixed = np.add.reduceat(side, starts) > 0
    in_tree = side == 0
    at = np.flatnonzero(in_tree)
    # equal fingerprints (of different sketches) hang on one tree node
    keyed = np.lexsort((fp[at], cell[at]))
    fresh = np.concatenate([[True], (np.diff(cell[at][keyed]) != 0) | (fp[at][keyed][1:] != fp[at][keyed][:-1])]) if at.size else np.zeros(0, bool)
    members = at[keyed]
    bounds = np.append(np.flatnonzero(fresh), len(members))
    heads = members[fresh]
    tree = Forest(fp[heads], cell[heads])
    rooted = np.full(len(nodes), -1)
    rooted[cell[heads[tree.root]]] = tree.root
    asks = np.flatnonzero((side == 1) | ~mixed[cell])
    asks = asks[rooted[cell[asks]] >= 0]
    label = np.arange(len(node))
    sizes = np.bincount(cell, minlength=len(nodes))
    cost = np.cumsum(sizes[cell[asks]])
    for part in np.split(asks, np.flatnonzero(np.diff(cost // 1_000_000)) + 1) if asks.size else []:
        for query, found in tree.within(fp[part], rooted[cell[part]], radius):
            wide = bounds[found + 1] - bounds[found]
            q = part[np.repeat(query, wide)]
            spots = np.repeat(bounds[found] - np.concatenate([[0], np.cumsum(wide)[:-1]]), wide) + np.arange(wide.sum()) if wide.size else wide
            m = members[spots]
            if mark is not None:
                for a in range(0, len(q), 100_000):
                    qa, ma = q[a : a + 100_000], m[a : a + 100_000]
                    open_ = label[qa] != label[ma]  # what is one group already needs no check
                    qa, ma = qa[open_], ma[open_]
                    for b in range(0, len(qa), 8192):
                        good = (mark[qa[b : b + 8192]] == mark[ma[b : b + 8192]]).mean(1) >= agree
                        join_labels(label, qa[b : b + 8192][good], ma[b : b + 8192][good])
            else:
                join_labels(label, q, m)
    moved = label != np.arange(len(node))
    return node[moved], node[label[moved]]


def cells_of(keyed: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """cell, side, node[, ...] from (key, node[, size, ...]): cells of two or more, the large ones cut into pairs of chunks.

    Who shares a key is settled by counts first, so that only members of real cells carry on. A chunk has about `most` members,
    and where there are sizes, about MOST_SHINGLES or less in all.
    """
    rest = [c for c in keyed.columns if c not in ("key", "size")]
    load = F.sum("size") / MOST_SHINGLES if "size" in keyed.columns else F.lit(0.0)
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), load.alias("load")).where("n > 1")
    sizes = scratch.written(sizes, "cell-sizes")
    rows = keyed.join(sizes, "key")
    chunks = F.ceil(F.greatest(F.col("n") / most, F.col("load"))).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    cut = rows.withColumn("chunks", chunks).withColumn("own", own).withColumn("other", other)
    return cut.select(
        F.struct("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("cell"),
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).cast("int").alias("side"),
        *rest,
    )


def links_in(cells: DataFrame, radius: int, agree: float | None = None) -> DataFrame:
    """a, b: each member of each cell with the least of its group. A cell is an array of bounded length."""
    spark = cells.sparkSession
    tune(spark)
    fields = ["node", "fp", "side", *["sketch"] * (agree is not None)]
    gathered = cells.groupBy("cell").agg(F.collect_list(F.struct(*fields)).alias("rows")).select(*[F.col(f"rows.{c}").alias(c) for c in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            columns = {c: batch.column(c) for c in names}
            # cells by the batch, but no more than some members at once
            lengths = np.array([len(x) for x in columns["node"]], np.int64)
            for part in np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(np.cumsum(lengths) // 20_000)) + 1):
                if not part.size:
                    continue
                pick = lambda c: [columns[c][int(i)].values for i in part]
                node = [x.to_numpy() for x in pick("node")]
                fp = [x.to_numpy().view(np.uint64) for x in pick("fp")]
                side = [x.to_numpy().astype(np.int64) for x in pick("side")]
                mark = [np.frombuffer(b"".join(x.to_pylist()), "<u2").reshape(len(x), -1) for x in pick("sketch")] if "sketch" in names else None
                a, b = link_cells(node, fp, side, mark, radius, agree or 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return gathered.mapInArrow(run, "a long, b long")


def link_sets(node: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similarity: float, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its group) in one cell: sets whose common part is `similarity` or more of both together.

    Nodes that have one `group` are known to be linked already; what is said again then is only how such groups join.
    """
    order = np.argsort(node, kind="stable")
    node, side, sets = node[order], side[order], [sets[i] for i in order]
    size = np.array([len(x) for x in sets], np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    seen = np.zeros(len(flat) + 1, bool)
    label = np.arange(len(node))
    if group is not None:
        _, same = np.unique(group[order], return_inverse=True)
        heads = np.full(len(node), len(node))
        np.minimum.at(heads, same, label)
        label = heads[same]
    before = label.copy()
    mixed = side.any()
    for q in np.flatnonzero(side == 1) if mixed else range(len(node)):
        others = np.flatnonzero(side == 0) if mixed else np.arange(q + 1, len(node))
        others = others[np.minimum(size[others], size[q]) >= similarity * np.maximum(size[others], size[q]) - 1e-6]
        own = flat[ends[q] - size[q] : ends[q]]
        seen[own] = True
        for heads in (True, False):  # the first of each group, then the rest of the groups that are still apart
            m = others[label[others] != label[q]]
            if heads and m.size:
                m = m[np.unique(label[m], return_index=True)[1]]
            for part in np.split(m, np.flatnonzero(np.diff(np.cumsum(size[m]) // MOST_SHINGLES)) + 1) if m.size else []:
                wide = size[part]
                at = np.repeat(ends[part] - np.cumsum(wide), wide) + np.arange(wide.sum())
                common = np.bincount(np.repeat(np.arange(len(part)), wide), seen[flat[at]], len(part))
                both = wide + size[q] - common
                good = part[(both == 0) | (common / np.maximum(both, 1) >= similarity)]
                join_labels(label, np.full(len(good), q), good)
        seen[own] = False
    moved = (label != before) & (before == np.arange(len(node)))
    return node[moved], node[label[moved]]


def set_links(cells: DataFrame, similarity: float) -> DataFrame:
    """a, b: as links_in, of cells with the sets of shingles."""
    tune(cells.sparkSession)
    fields = ["node", "side", "shingles", *["group"] * ("group" in cells.columns)]
    gathered = cells.groupBy("cell").agg(F.collect_list(F.struct(*fields)).alias("rows")).select(*[F.col(f"rows.{c}").alias(c) for c in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, side, sets, *group in zip(*[batch.column(c) for c in fields], strict=True):
                sets = [np.frombuffer(x, "<u8") for x in sets.values.to_pylist()]
                a, b = link_sets(node.values.to_numpy(), side.values.to_numpy(), sets, similarity, *[g.values.to_numpy() for g in group])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return gathered.mapInArrow(run, "a long, b long")


def verified_links(loose: DataFrame, sets: DataFrame, similarity: float, most: int, scratch: Scratch) -> DataFrame:
    """a, b: links between sets similar by `similarity` or more, enough of them to join all that are linked in a loose group.

    loose: key, node, least, size; sets: of, shingles. A group of one chunk is one cell. A large one is first compared with one
    member, that with the least id: most of a group of copies is settled by that, each set moving once. Twice so; then
    what is left over is compared among itself and with the largest part that is settled. Only pairs
    that are known to be linked through others are never compared.
    """
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / most, F.sum("size") / MOST_SHINGLES)).cast("int")
    chunk = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = lambda kind, i, j, side, group: [F.struct("key", F.lit(kind).alias("kind"), i.alias("i"), j.alias("j")).alias("cell"), side.cast("int").alias("side"), "node", F.col(group).alias("group")]
    zero, one = F.lit(0), F.lit(1)

    def links(cells: DataFrame, what: str) -> DataFrame:
        return scratch.written(set_links(cells.join(sets, cells["node"] == sets["of"]).drop("of"), similarity), what)

    def keyed(rows: DataFrame, by: DataFrame) -> DataFrame:
        """Both by key; by has one row a key, and has been written, so that the join may split a hot key."""
        return rows.join(by.withColumnRenamed("key", "its key"), rows["key"] == F.col("its key")).drop("its key")

    rows = keyed(loose, scratch.written(loose.groupBy("key").agg(parts.alias("chunks")), "loose-sizes"))
    found = links(rows.where("chunks = 1").select(*cell("whole", zero, zero, zero, "node")), "set-links")
    left = scratch.written(rows.where("chunks > 1"), "large-groups")
    if not left.limit(1).count():
        return found
    settled = left.limit(0).withColumn("group", F.col("node"))
    for _ in range(PIVOTS):
        pivots = scratch.written(left.groupBy("key").agg(F.min(F.struct("least", "node"))["node"].alias("pivot")), "pivots")
        now = keyed(left, pivots)
        members = now.where("node <> pivot").select(*cell("pivot", zero, chunk("chunks"), zero, "node"))
        asking = now.where("node = pivot").withColumn("each", every("chunks")).select(*cell("pivot", zero, F.col("each"), one, "node"))
        star = links(members.unionByName(asking), "pivot-links")
        found = found.unionByName(star)
        done = star.select(F.col("a").alias("done")).union(star.select("b")).union(pivots.select("pivot")).distinct()
        done = scratch.written(done, "settled")
        settled = settled.unionByName(now.join(done, now["node"] == done["done"], "left_semi").withColumnRenamed("pivot", "group"))
        left = scratch.written(left.join(done, left["node"] == done["done"], "left_anti"), "left-over")
        if not left.limit(1).count():
            break
    known = scratch.written(settled.unionByName(left.withColumn("group", F.col("node"))).drop("chunks"), "known-groups")
    main = known.groupBy("key", "group").agg(F.sum("size").alias("size")).groupBy("key").agg(F.max(F.struct("size", "group"))["group"].alias("main"))
    known = keyed(known, scratch.written(main, "main-groups"))
    rest = known.where("group <> main")
    counts = scratch.written(rest.groupBy("key").agg(parts.alias("rests")), "rests")
    mains = scratch.written(known.where("group = main").groupBy("key").agg(parts.alias("mains")), "mains")
    rest = keyed(keyed(rest, counts), mains).withColumn("own", chunk("rests"))
    body = keyed(keyed(known.where("group = main"), counts), mains).withColumn("own", chunk("mains"))
    among = rest.withColumn("each", every("rests")).select(*cell("among", F.least("own", "each"), F.greatest("own", "each"), F.when(F.col("own") > F.col("each"), 1).otherwise(0), "group"))
    asks = rest.withColumn("each", every("mains")).select(*cell("main", F.col("own"), F.col("each"), one, "group"))
    asked = body.withColumn("each", every("rests")).select(*cell("main", F.col("each"), F.col("own"), zero, "group"))
    return found.unionByName(links(among.unionByName(asks).unionByName(asked), "rest-links"))


def near_duplicates(docs: DataFrame, *, words: int = 4, radius: int = 4, most: int = 1024) -> DataFrame:
    """doc_id, fp, component_id: fingerprints that differ in `radius` bits or fewer link; a component has its least id."""
    with Scratch(docs.sparkSession) as scratch:
        prints = written(fingerprints(docs, words=words), "fingerprints")
        nodes = scratch.written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "fingerprint-nodes")
        choices = block_choices(radius, nodes.count())
        keyed = nodes.select(F.explode(band_keys(F.col("fp"), choices)).alias("key"), "node", "fp")
        found = scratch.written(links_in(cells_of(keyed, most, scratch), radius), "fingerprint-links")
        return assigned(prints, nodes, found, "fp", scratch).select("doc_id", "fp", "component_id")


def similar_documents(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, radius: int = 28, slack: float = 0.15, most: int = 2048) -> DataFrame:
    """doc_id, fp, key, group, component_id: documents whose sets of shingles are similar by `similarity` or more link.

    key is of the set of shingles, group that of one set of the component; component_id is the component's least id. Rows
    with one id but other sets need not be in one component.

    The radius is wide enough for that similarity: the fingerprint is of the set of shingles too, and differs in 10 bits in
    the mean, with a spread of 3, at 0.8. Documents
    whose share of equal min-hashes is less by `slack` at most (six times the spread of that measure) make loose groups; in
    each of them the sets themselves decide. One in 100,000 pairs just at 0.8 shares none of the groups of min-hashes.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.written(sketches(docs, words=words), "sketches")
        nodes = rows.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.min(F.struct("fp", "size", "sketch", "bands")).alias("x"))
        nodes = scratch.written(nodes.select(F.col("key").alias("node"), "least", "x.fp", "x.size", "x.sketch", "x.bands"), "sketch-nodes")
        slim = written(rows.select("doc_id", "fp", "key"), "sketch-keys")
        scratch.drop(rows)
        thin = cells_of(nodes.select(F.explode("bands").alias("key"), "node", "fp"), most, scratch)
        marked = thin.join(nodes.select(F.col("node").alias("of"), "sketch"), thin["node"] == F.col("of")).drop("of")
        loose = components(scratch.written(links_in(marked, radius, similarity - slack), "sketch-links"), scratch)
        loose = loose.join(nodes.select(F.col("node").alias("of"), "least", "size"), loose["node"] == F.col("of"))
        loose = scratch.written(loose.select(F.col("component").alias("key"), "node", "least", "size"), "loose-groups")
        wanted = loose.select(F.col("least").alias("wanted")).distinct()
        held_by = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(wanted, F.col("doc_id") == F.col("wanted"), "left_semi")
        sets = shingle_sets(held_by, words=words).groupBy("key").agg(F.first("shingles").alias("shingles"))
        sets = scratch.written(sets.withColumnRenamed("key", "of"), "shingle-sets")
        found = verified_links(loose, sets, similarity, most, scratch)
        return grouped(slim, nodes.select("node", "least"), found, scratch)


def grouped(rows: DataFrame, nodes: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, fp, key, group, component_id of rows, whose nodes are keys: a component has the least id of all its nodes."""
    groups = components(found, scratch).withColumnRenamed("node", "of")
    linked = nodes.join(groups, nodes["node"] == groups["of"], "left").select("node", "least", F.coalesce("component", "node").alias("group"))
    linked = scratch.written(linked, "set-groups")
    first = linked.groupBy("group").agg(F.min("least").alias("component_id")).withColumnRenamed("group", "its group")
    named = written(linked.join(first, linked["group"] == first["its group"]).select("node", "group", "component_id"), "components")
    out = rows.join(named, rows["key"] == named["node"], "left")
    own = F.col("doc_id").isNotNull()
    return out.select("doc_id", "fp", "key", F.when(own, F.col("group")).alias("group"), F.when(own, F.col("component_id")).alias("component_id"))


def set_keys(rows: DataFrame, *, words: int = 5) -> DataFrame:
    """rows (row, text) with the key of the text's set of shingles in place of the text."""
    tune(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [set_key(np.unique(shingle_hashes(t or "", words))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), signed(keys)], ["row", "key"])

    return rows.select("row", "text").mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("key", T.LongType())]))


def one_of_each(docs: DataFrame, found: DataFrame, *, words: int = 5) -> DataFrame:
    """One row of each component of similar_documents: that with the least id, the first by text of those. A null id stays.

    Where an id occurs once, it says which row goes; rows of an id that repeats are told apart by their sets of shingles.
    """
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("least"))
    ids = written(ids.where("n > 1 or doc_id <> least").select(F.col("doc_id").alias("gone"), "n"), "copies")
    left = docs.join(ids, docs["doc_id"] == ids["gone"], "left_anti")
    again = ids.where("n > 1").select(F.col("gone").alias("again"))
    if not again.limit(1).count():
        return left
    many = docs.join(again, docs["doc_id"] == again["again"], "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("its id"), F.col("key").alias("its key"), "group").distinct()
    many = set_keys(many, words=words).join(kept, (F.col("row.doc_id") == F.col("its id")) & (F.col("key") == F.col("its key")))
    first = Window.partitionBy("group").orderBy("row.text")
    return left.unionByName(many.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("row.*"))


def assigned(rows: DataFrame, nodes: DataFrame, found: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """rows with component_id. The table of components is written first, so that the last join may split a hot fingerprint."""
    groups = components(found, scratch)
    known = nodes.select(F.col(key).alias("its key"), F.col("node").alias("its node"))
    by_key = known.join(groups, known["its node"] == groups["node"], "left").select("its key", F.coalesce("component", "its node").alias("component_id"))
    by_key = written(by_key, "components")
    out = rows.join(by_key, rows[key] == by_key["its key"], "left").drop("its key")
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def hex_of(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

"""Exact top-k inner products over KD-trees, one tree a shard.

Candidates are dealt into regions by median cuts of a bounded sample, and regions into shards of bounded size by a
hash. Each shard becomes one KD-tree: median splits along the widest side, a tight box around every node. Queries go in
blocks of bounded size, near ones together. A block first searches one shard of its own region; the kth score found
there goes with each query to all other shards as a bound. Only the queries whose bound the box of a region can reach
are sent to that region's shards. In a shard each query walks the tree best first by the largest inner product its box
allows, and stops when no box can reach the kth score. At most k rows a query and shard leave the search.

The sample only says where rows lie; results don't depend on it. How much the boxes exclude depends on the vectors: where
they lie in groups, most of the leaves; directions drawn evenly from 64 dimensions, none, by any exact method of this kind.

Defined results: rows with a null id, a null vector, or a null, NaN or infinite component take no part;
exactly repeated rows count once; an id that has several vectors searches with the smallest of them, stays a
candidate with each, and is never its own neighbour; vectors meet only those of their own length; a query with
fewer than k candidates gets all of them; equal scores go to the smaller id. Components are integers, and
scores are exact: Python integers are used where 64 bits would not do, and a score that a long can't hold is an error.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.llm.common import tune, written

#: What is moved for a pair of shard and block grows as their sum, what is computed as their product: larger ones move less.
SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS, SLICE_ROWS = 16_384, 64, 8192, 512
#: Rows (in expectation) and numbers of the sample that regions are cut by, and regions at most: 16 sampled rows each.
SAMPLE_ROWS, SAMPLE_NUMBERS, MOST_REGIONS = 16_384, 1 << 20, 1024
EXACT = 1 << 52


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: Column) -> Column:
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, odd)


class Tree:
    """A KD-tree over integer rows. Node j has rows first[j] to last[j]; its children are left[j] and left[j] + 1, or none (-1)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.arange(len(ids))
        spans, left, lows, highs = [(0, len(ids))], [], [], []
        at = 0
        while at < len(spans):
            a, b = spans[at]
            block = rows[order[a:b]]
            low, high = (block.min(0), block.max(0)) if b > a else (np.zeros(rows.shape[1], rows.dtype),) * 2
            lows.append(low)
            highs.append(high)
            wide = int(np.argmax(high.astype(float) - low)) if rows.shape[1] else 0
            if b - a > leaf_rows and rows.shape[1] and high[wide] > low[wide]:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(block[:, wide], half)]
                left.append(len(spans))
                spans += [(a, a + half), (a + half, b)]
            else:
                left.append(-1)
            at += 1
        self.ids, self.rows = ids[order], rows[order]
        self.spans, self.left, self.low, self.high = spans, left, np.array(lows), np.array(highs)
        self.leaves_seen = 0
        self.largest = max(abs(int(x)) for x in (rows.min(initial=0), rows.max(initial=0)))

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
        """For each query its k best (score, id), scores under its floor left out."""
        reach = self.largest * max(abs(int(x)) for x in (queries.min(initial=0), queries.max(initial=0))) * max(1, queries.shape[1])
        kind = np.float64 if reach < EXACT else object
        rows, q, low, high = (x.astype(kind) for x in (self.rows, queries, self.low, self.high))
        bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T if q.shape[1] else np.zeros((len(q), len(low)))
        out = []
        for i, own in enumerate(ids.tolist()):
            least = None if floors is None or floors[i] == NONE else int(floors[i])
            best: list[tuple[int, int]] = []  # (score, -id): the root is the worst
            heap = [(-bounds[i, 0], 0)]
            while heap:
                bound, node = heapq.heappop(heap)
                limit = best[0][0] if len(best) == k else least
                if limit is not None and -bound < limit:
                    break
                child = self.left[node]
                if child >= 0:
                    heapq.heappush(heap, (-bounds[i, child], child))
                    heapq.heappush(heap, (-bounds[i, child + 1], child + 1))
                    continue
                a, b = self.spans[node]
                self.leaves_seen += 1
                scores = rows[a:b] @ q[i] if q.shape[1] else np.zeros(b - a)
                hits = np.arange(b - a) if limit is None else np.flatnonzero(scores >= limit)
                for j in hits.tolist():
                    if (other := int(self.ids[a + j])) == own:
                        continue
                    one = (int(scores[j]), -other)
                    if len(best) < k:
                        heapq.heappush(best, one)
                    elif one > best[0]:
                        heapq.heapreplace(best, one)
            out.append([(s, -o) for s, o in sorted(best, reverse=True) if least is None or s >= least])
        return out


NONE = np.iinfo(np.int64).min


class Regions:
    """Median cuts of a sample along its widest sides, for vectors of one length. Regions are numbered so that neighbours follow each other."""

    def __init__(self, sample: np.ndarray, total: float, queries: float, shard_rows: int):
        """total and queries: rows and queries of this length; their shares of the sample's regions say how many shards and blocks these get."""
        wanted = min(MOST_REGIONS, max(1, int(total // shard_rows)), max(1, len(sample) // 16))
        self.axis, self.at, self.child = [0], [0], [0]  # child: that of the left side, the right one follows; negative: a region
        parts, sizes = {0: sample}, {}
        while len(parts) and len(parts) + len(sizes) < wanted:
            node = max(parts, key=lambda n: len(parts[n]))
            rows = parts.pop(node)
            spread = rows.max(0) - rows.min(0) if len(rows) else np.zeros(0)
            wide = int(np.argmax(spread)) if spread.size else 0
            if not spread.size or spread[wide] <= 0:
                sizes[node] = len(rows)
                continue
            values = np.sort(rows[:, wide])
            middle = int(min(values[(len(rows) - 1) // 2], values[values < values[-1]][-1]))  # some rows lie beyond it
            left = rows[:, wide] <= middle
            self.axis[node], self.at[node], self.child[node] = wide, middle, len(self.axis)
            for side in (rows[left], rows[~left]):
                parts[len(self.axis)] = side
                self.axis, self.at, self.child = [*self.axis, 0], [*self.at, 0], [*self.child, 0]
        sizes |= {n: len(rows) for n, rows in parts.items()}
        order, stack = [], [0]
        while stack:
            node = stack.pop()
            if self.child[node]:
                stack += [self.child[node] + 1, self.child[node]]
            else:
                self.child[node] = -1 - len(order)
                order.append(sizes[node])
        self.axis, self.at, self.child = (np.array(x, np.int64) for x in (self.axis, self.at, self.child))
        share = np.array(order, float) / max(1, len(sample))
        pieces = lambda rows, most: np.maximum(1, np.ceil(1.25 * rows / most)).astype(np.int64)
        self.shards = pieces(share * total, shard_rows)
        self.first = np.cumsum(self.shards) - self.shards
        joined = np.minimum(np.cumsum(share) * max(1, queries // BLOCK_ROWS), max(0, queries // BLOCK_ROWS - 1)).astype(np.int64)  # regions with few queries share blocks
        _, self.group = np.unique(joined, return_inverse=True)
        self.blocks = pieces(np.bincount(self.group, share) * queries, BLOCK_ROWS)
        self.first_block = np.cumsum(self.blocks) - self.blocks
        self.home = self.first[[np.flatnonzero(self.group == g)[-1] for g in range(len(self.blocks))]]  # a shard of each group

    def region(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64)
        going = np.arange(len(rows)) if self.child[0] >= 0 else np.zeros(0, np.int64)
        while going.size:
            now = node[going]
            node[going] = self.child[now] + (rows[going, self.axis[now]] > self.at[now])
            going = going[self.child[node[going]] >= 0]
        return -1 - self.child[node]


def reach(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product of each query with a point of each box. Exact, or so nearly that `reachable` makes up for it."""
    q = queries.astype(float)
    return np.maximum(q, 0) @ high.T.astype(float) + np.minimum(q, 0) @ low.T.astype(float)


def reachable(queries: np.ndarray, floors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which queries (rows) may find something at least as good as their floor in which boxes (columns)."""
    bound = reach(queries, low, high)
    slack = 1e-9 * (np.abs(queries).astype(float) @ np.maximum(np.abs(low), np.abs(high)).T.astype(float)) + 1
    return (floors == NONE)[:, None] | (bound + slack >= floors.astype(float)[:, None])


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = np.array(pdf["vec"].tolist(), dtype=np.int64).reshape(len(pdf), -1)
    small = rows.astype(np.int32)
    return pdf["vec_id"].to_numpy(np.int64), small if (small == rows).all() else rows


def _distinct(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows in order of id and vector, exact repeats left out."""
    pdf = pdf.assign(key=[tuple(v) for v in pdf["vec"]]).sort_values(["vec_id", "key"])
    return pdf.drop_duplicates(["vec_id", "key"])


def exact_top_k(vectors: DataFrame, is_query: Column, *, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for every row that is_query holds for."""
    spark = vectors.sparkSession
    tune(spark)
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    asked_rows = rows.where("asks").select("vec_id", "vec")
    if rows.groupBy("vec_id").count().where("count > 1").limit(1).count():  # an id that comes often must not meet in one task
        asked_rows = asked_rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))
        rows = rows.select("vec_id", "vec").distinct()
    rows, asked_rows = (df.withColumn("dim", F.size("vec")) for df in (rows, asked_rows))
    by_length = lambda df: {r["dim"]: r["n"] for r in df.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes, asks = by_length(rows), by_length(asked_rows)
    total = sum(sizes.values())
    if not asks:
        return rows.limit(0).selectExpr("vec_id as query_id", "0 as rank", "vec_id", "vec_id as score")
    place = F.xxhash64("vec_id", "vec")
    wanted = min(SAMPLE_ROWS, SAMPLE_NUMBERS // max(1, max(sizes)))
    drawn = rows.where(F.pmod(F.xxhash64(place), F.lit(1 << 30)) < -(-wanted * (1 << 30) // total)).select("dim", "vec").toPandas()
    cuts = {}
    for dim, n in sizes.items():
        own = np.array((picked := drawn.loc[drawn["dim"] == dim, "vec"].tolist()), np.int64).reshape(len(picked), dim)
        cuts[dim] = Regions(own, n, asks.get(dim, 0), shard_rows)
    sent = spark.sparkContext.broadcast(cuts)  # at most MOST_REGIONS cuts for each length

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for dim, own in pdf.groupby("dim"):
                plan = sent.value[dim]
                region = plan.region(np.array(own["vec"].tolist(), np.int64).reshape(len(own), dim))
                spot = own["place"].to_numpy(np.int64).view(np.uint64)
                group = plan.group[region]
                block = plan.first_block[group] + (spot % plan.blocks[group].astype(np.uint64)).astype(np.int64)
                shard = plan.first[region] + (spot % plan.shards[region].astype(np.uint64)).astype(np.int64)
                parts.append(own.assign(region=region, shard=shard, block=block, home=plan.home[group]))
            if parts:
                yield pd.concat(parts).drop(columns="place")

    shape = "vec_id long, vec array<long>, dim int, region long, shard long, block long, home long"
    dealt = lambda df: df.select("vec_id", "vec", "dim", place.alias("place")).mapInPandas(deal, shape)

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(*_matrix(_distinct(pdf)))
        head = pdf[["dim", "region", "shard"]].iloc[:1].reset_index(drop=True)
        return head.assign(low=[tree.low[0].astype(np.int64).tolist()], high=[tree.high[0].astype(np.int64).tolist()], tree=[pickle.dumps(tree, protocol=5)])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = _distinct(pdf).drop_duplicates("vec_id")
        return pdf[["dim", "block", "home"]].iloc[:1].reset_index(drop=True).assign(queries=[pickle.dumps(_matrix(kept), protocol=5)])

    trees = dealt(rows).groupBy("dim", "shard").applyInPandas(plant, "dim int, region long, shard long, low array<long>, high array<long>, tree binary")
    trees = written(trees, "kd-trees")
    asked = dealt(asked_rows).groupBy("dim", "block").applyInPandas(gather, "dim int, block long, home long, queries binary")

    def outer(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = (np.array(pdf[c].tolist(), np.int64).reshape(len(pdf), -1) for c in ("low", "high"))
        return pdf[["dim", "region"]].iloc[:1].reset_index(drop=True).assign(low=[low.min(0).tolist()], high=[high.max(0).tolist()])

    boxes = trees.select("dim", "region", "low", "high").groupBy("dim", "region").applyInPandas(outer, "dim int, region long, low array<long>, high array<long>").toPandas()
    boxes = spark.sparkContext.broadcast({dim: (own["region"].to_numpy(), *(np.array(own[c].tolist(), np.int64).reshape(len(own), -1) for c in ("low", "high"))) for dim, own in boxes.groupby("dim")})

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                ids, queries = pickle.loads(row.queries)
                floors = None if row.floors is None else np.frombuffer(row.floors, np.int64)
                tree, found = pickle.loads(row.tree), []
                for a in range(0, len(ids), SLICE_ROWS):
                    part = slice(a, a + SLICE_ROWS)
                    found += tree.search(ids[part], queries[part], k, None if floors is None else floors[part])
                kth = np.array([x[-1][0] if len(x) == k else NONE for x in found], np.int64)
                flat = [(int(q), o, s) for q, x in zip(ids, found, strict=True) for s, o in x]
                yield pd.DataFrame({"dim": [row.dim], "block": [row.block], "home": [row.home], "queries": [row.queries], "floors": [kth.tobytes()], "hits": [pickle.dumps(flat, protocol=5)]})

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each block to the shards of the regions that some of its queries may reach, with those queries alone."""
        for pdf in batches:
            for row in pdf.itertuples():
                ids, queries = pickle.loads(row.queries)
                floors = np.frombuffer(row.floors, np.int64)
                plan, (regions, low, high) = sent.value[row.dim], boxes.value[row.dim]
                needed = reachable(queries, floors, low, high)
                for at in np.flatnonzero(needed.any(0)).tolist():
                    own, first = needed[:, at], int(plan.first[regions[at]])
                    some = pickle.dumps((ids[own], queries[own]), protocol=5)
                    left = [shard for shard in range(first, first + int(plan.shards[regions[at]])) if shard != row.home]
                    if left:
                        yield pd.DataFrame({"dim": row.dim, "block": row.block, "home": row.home, "shard": left, "queries": [some] * len(left), "floors": [floors[own].tobytes()] * len(left)})

    found = "dim int, block long, home long, queries binary, floors binary, hits binary"
    at_home = asked.withColumn("floors", F.lit(None).cast("binary")).join(trees.select("dim", F.col("shard").alias("home"), "tree"), ["dim", "home"], "left")
    none = F.col("tree").isNull()  # a shard that the sample foresaw and no row came to
    home = at_home.where(~none).mapInPandas(visit, found)
    home = written(home, "kd-home")  # what a block found in its first shard: at most k rows a query
    lost = at_home.where(none).select("dim", "block", "home", "queries").mapInPandas(unseen, "dim int, block long, home long, queries binary, floors binary")
    going = home.select("dim", "block", "home", "queries", "floors").unionByName(lost)
    rest = going.mapInPandas(route, "dim int, block long, home long, shard long, queries binary, floors binary").join(trees.select("dim", "shard", "tree"), ["dim", "shard"]).mapInPandas(visit, found)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for hits in pdf["hits"]:
                yield pd.DataFrame(pickle.loads(hits), columns=["query_id", "vec_id", "score"], dtype="int64")

    hits = home.select("hits").unionByName(rest.select("hits")).mapInPandas(spread, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def unseen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks that have searched nowhere yet: no floor for any query."""
    for pdf in batches:
        yield pdf.assign(floors=[np.full(len(pickle.loads(q)[0]), NONE, np.int64).tobytes() for q in pdf["queries"]])

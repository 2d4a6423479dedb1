"""Exact top-k inner-product search: a ball tree per shard, branch and bound, one kth score for all shards.

Candidates are dealt to shards of bounded size by hash, each once.  A task builds its shard's ball
tree from the candidates, which its sorted input brings first, keeps it, and streams all queries of
its dimension past it.  Nodes are visited in
order of the upper bound  q . centre + |q| * radius  and the search ends when the
bound falls below the current kth score.

The kth score is shared in two passes.  The first lets every query visit only its
best leaf of each shard; Spark takes the kth best of all those scores, a lower bound of the
true kth.  The second searches every shard from that bound, so most shards are
left after their root.  Its top k per shard meet in one window over shards x k rows
a query.  Queries travel to every shard: that is the price of exactness, and why shards should be as large as
a task can hold.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part, nor do rows without id; a query never meets rows of its own
id; vectors of different length never meet; ties go to the smaller id; repeated
rows of an id and vector count once; different vectors under one id are queries of their own, ranked apart; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

LEAF = 64
SHARD_ROWS = 100_000  # at most, about
LEAST_ROWS = 2_000  # smaller tables are not split further


class BallTree:
    """Median splits along the direction of the two farthest points; nodes in flat arrays."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.nodes: list[tuple[int, int, int, int]] = []  # start, end, left, right
        centres, radii = [], []

        def build(a: int, b: int) -> int:
            at = len(self.nodes)
            mine = points[order[a:b]]
            centre = mine.mean(axis=0)
            far = np.sqrt(((mine - centre) ** 2).sum(axis=1))
            self.nodes.append((a, b, -1, -1))
            centres.append(centre)
            radii.append(far.max())
            if b - a > leaf and far.max() > 0:
                one = mine[far.argmax()]
                two = mine[((mine - one) ** 2).sum(axis=1).argmax()]
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(mine @ (two - one), mid)]
                left, right = build(a, a + mid), build(a + mid, b)
                self.nodes[at] = (a, b, left, right)
            return at

        if len(ids):
            build(0, len(ids))
        self.ids, self.points = ids[order], points[order]
        self.centres = np.array(centres).reshape(len(centres), points.shape[1])
        self.radii = np.array(radii) * (1 + 1e-9) + 1e-6
        self.leaves = np.array([k for k, n in enumerate(self.nodes) if n[2] < 0], np.int64)

    def search(self, qid: int, q: np.ndarray, k: int, floor: float, first_only: bool) -> list[tuple[float, int]]:
        """The k best (score, id) of at least ``floor``; only from the most promising leaf if first_only."""
        import heapq

        if not self.nodes:
            return []
        length = float(np.sqrt(q @ q))
        best: list[tuple[float, int]] = []
        bound = lambda n: float(q @ self.centres[n]) + length * self.radii[n]
        heap = [(-bound(0), 0)]
        while heap:
            up, node = heapq.heappop(heap)
            if -up < floor:
                break
            a, b, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if (top := bound(child)) >= floor:
                        heapq.heappush(heap, (-top, child))
                continue
            scores = self.points[a:b] @ q
            keep = (scores >= floor) & (self.ids[a:b] != qid)
            if keep.any():
                best += zip(scores[keep].tolist(), self.ids[a:b][keep].tolist())
                best.sort(key=lambda x: (-x[0], x[1]))
                del best[k:]
                if len(best) == k:
                    floor = max(floor, best[-1][0])
            if first_only:
                break
        return best


def vectors(df: DataFrame, id_col: str, vector: str, scale: Column | None = None) -> DataFrame:
    """(id, v ARRAY<DOUBLE>, dim) of the rows that take part, each once."""
    v = F.col(f"`{vector}`").cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return (df.where(sound & (F.size(v) > 0) & F.col(f"`{id_col}`").isNotNull())
            .select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
            .dropDuplicates(["id", "v"]).withColumn("dim", F.size("v")))


_SCHEMA = "query_id long, q long, score double, id long"


def _searched(rows: DataFrame, k: int, first_only: bool) -> DataFrame:
    """(query_id, q, score, id) of rows (dim, shard, asks, id, v, q, floor), sorted by the first three in every partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tree = None, None
        ids: list[np.ndarray] = []
        points: list[np.ndarray] = []
        for b in batches:
            out: list[tuple[int, int, float, int]] = []
            if not b.num_rows:
                continue
            dims, shards, asks = (b.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "shard", "asks"))
            edges = np.flatnonzero((np.diff(dims) != 0) | (np.diff(shards) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, z in zip([0, *edges], [*edges, b.num_rows]):
                part = b.slice(a, z - a)
                if here != (dims[a], shards[a]):
                    here, tree, ids, points = (dims[a], shards[a]), None, [], []
                own = part.column("id").to_numpy()
                v = part.column("v").flatten().to_numpy().reshape(-1, int(dims[a]))
                if not asks[a]:
                    ids.append(own)
                    points.append(v)
                    continue
                if not ids:
                    continue  # no candidate of this shard
                tree = tree or BallTree(np.concatenate(ids), np.concatenate(points))
                for qid, q, x, floor in zip(own.tolist(), part.column("q").to_pylist(), v, part.column("floor").to_pylist()):
                    out += [(qid, q, s, i) for s, i in tree.search(qid, x, k, -np.inf if floor is None else floor, first_only)]
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()),
                                              pa.array(cols[3], pa.int64())], ["query_id", "q", "score", "id"])

    return rows.mapInArrow(run, _SCHEMA)


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, id, score); both sides as made by ``vectors``."""
    candidates = written(candidates, "vectors")
    queries = written(queries.withColumn("q", F.xxhash64("id", "v")), "queries")
    n, cores = candidates.count(), candidates.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n // shard_rows), min(cores, n // LEAST_ROWS))
    none = lambda t: F.lit(None).cast(t)
    dealt = candidates.select("dim", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "id", "v",
                              none("long").alias("q"), none("double").alias("floor"))

    def passed(asking: DataFrame, first_only: bool) -> DataFrame:
        asked = asking.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "id", "v", "q", "floor")
        # more tasks than shards, so that few shards share one
        rows = dealt.unionByName(asked).repartition(2 * shards, F.xxhash64("dim", "shard")).sortWithinPartitions("dim", "shard", "asks")
        return _searched(rows, k, first_only)

    place = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "id"))
    seeds = passed(queries.withColumn("floor", none("double")), True)
    floors = written(seeds.withColumn("rank", place).where(F.col("rank") == k).select(F.col("query_id").alias("id"), "q", F.col("score").alias("floor")), "floors")
    found = passed(queries.join(floors, ["id", "q"], "left"), False)
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

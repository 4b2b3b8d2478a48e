"""Nearest neighbours by inner product, with a vantage-point tree per shard.

Inner products become distances by one more coordinate: with M the largest norm, a vector
x gets sqrt(M^2 - |x|^2) and a query 0, so the nearest point has the largest product. Vectors are
dealt to shards by a hash of their id. A shard's task builds a vantage-point tree in numpy
and streams all queries past it. A branch is skipped when the triangle bound times
`factor` exceeds the distance of the k-th best so far: factor 1 is exact search, a larger one
skips more. Scores are plain sums of products in double precision over the original
vectors, summed in one order, so equal vectors have equal scores.

The queries are a stated subset that meets every shard in blocks; a shard returns k rows
per query. Vectors that are null, empty, zero or not finite take no part, neither as query nor as
candidate, nor do rows without an id. Candidates are of the query's length. Rows with the
query's own id are no candidates for it. Ties go to the smaller id. Repeated rows are candidates
each; a repeated query row is one query. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftgate.llm.common import boundaries, longs
from siftgate.llm.vectors import doubles, matrix, usable
from siftgate.plans.scratch import written

SHARD_ROWS = 8_192
LEAF = 128
FACTOR = 1.0


class Tree:
    def __init__(self, x: np.ndarray, ids: np.ndarray, norm: float, seed: int = 1):
        self.x, self.ids, self.square = x, ids, norm * norm
        lift = np.sqrt(np.maximum(self.square - (x * x).sum(axis=1), 0))
        self.z = np.concatenate([x, lift[:, None]], axis=1)
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray):
        """A leaf is an array of rows, a node (vantage point, median distance, inner, outer)."""
        if len(rows) <= LEAF:
            return rows
        v = self.z[rows[self.rng.integers(len(rows))]]
        d = np.sqrt(((self.z[rows] - v) ** 2).sum(axis=1))
        mu = float(np.median(d))
        inner = d <= mu
        if inner.all():  # copies of one point, or as far from it as can be
            return rows
        return v, mu, self._build(rows[inner]), self._build(rows[~inner])

    def search(self, q: np.ndarray, own: np.ndarray, k: int, factor: float = FACTOR) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best for each query, -inf where there are fewer."""
        best = np.full((len(q), k), -np.inf)
        who = np.full((len(q), k), np.iinfo(np.int64).max)
        far = self.square + (q * q).sum(axis=1)
        point = np.concatenate([q, np.zeros((len(q), 1))], axis=1)

        def leaf(rows: np.ndarray, at: np.ndarray) -> None:
            for i in range(0, len(rows), 4 * LEAF):
                some = rows[i : i + 4 * LEAF]
                near = q[at] @ self.x[some].T >= best[at, -1][:, None] - 1e-9
                near &= own[at][:, None] != self.ids[some][None, :]
                r, c = np.nonzero(near)
                if not len(r):
                    continue
                touched, back = np.unique(at[r], return_inverse=True)
                score = np.concatenate([(q[at[r]] * self.x[some[c]]).sum(axis=1), best[touched].ravel()])
                name = np.concatenate([self.ids[some[c]], who[touched].ravel()])
                group = np.concatenate([back, np.repeat(np.arange(len(touched)), k)])
                order = np.lexsort((name, -score, group))
                group = group[order]
                place = np.arange(len(order)) - np.searchsorted(group, np.arange(len(touched)))[group]
                top = order[place < k]
                best[touched] = score[top].reshape(-1, k)
                who[touched] = name[top].reshape(-1, k)

        def visit(node, at: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(node, np.ndarray):
                leaf(node, at)
                return
            v, mu, inner, outer = node
            d = np.sqrt(((point[at] - v) ** 2).sum(axis=1))
            inside = d <= mu
            visit(inner, at[inside])
            visit(outer, at[~inside])
            reach = np.sqrt(np.maximum(far[at] - 2 * best[at, -1], 0)) + 1e-9
            crossing = np.abs(d - mu) * factor <= reach
            visit(outer, at[inside & crossing])
            visit(inner, at[~inside & crossing])

        visit(self.root, np.arange(len(q)))
        return who, best


def _search_shard(norms: dict[int, float], k: int, factor: float):
    def run(batches):
        current, held_ids, held, tree = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            at = boundaries(table, ["dim", "shard", "query"])
            for s, e in zip(at[:-1], at[1:]):
                part = table.slice(s, e - s)
                key = (int(longs(part, "dim")[0]), int(longs(part, "shard")[0]))
                if key != current:
                    current, held_ids, held, tree = key, [], [], None
                ids, x = longs(part, "id"), matrix(part.column("v"), key[0])
                if not longs(part, "query")[0]:
                    held_ids.append(ids)
                    held.append(x)
                    continue
                if not held:
                    continue
                if tree is None:
                    tree = Tree(np.concatenate(held), np.concatenate(held_ids), norms[key[0]])
                who, score = tree.search(x, ids, k, factor)
                r, c = np.nonzero(np.isfinite(score))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[r]), pa.array(longs(part, "q")[r]), pa.array(who[r, c]), pa.array(score[r, c])], ["query_id", "q", "vec_id", "score"]
                )

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for the rows of vectors that is_query holds for."""
    keep = usable(F.col(vector_col)) & F.col(id_col).isNotNull()
    rows = vectors.where(keep).select(F.col(id_col).cast("long").alias("id"), doubles(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = written(rows.withColumn("dim", F.size("v").cast("long")), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    seen = rows.groupBy("dim").agg(F.count("*").alias("n"), F.sqrt(F.max(square)).alias("norm")).collect()  # one row per length
    norms = {r["dim"]: r["norm"] * (1 + 1e-12) for r in seen}
    shards = max([-(-r["n"] // SHARD_ROWS) for r in seen], default=1)
    data = rows.select("id", "v", "dim", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).alias("shard"), F.lit(0).cast("long").alias("query"), F.lit(0).cast("long").alias("q"))
    asked = rows.where("asks").dropDuplicates(["id", "v"])
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    asked = asked.select("id", "v", "dim", every.alias("shard"), F.lit(1).cast("long").alias("query"), F.xxhash64("v").alias("q"))
    dealt = data.unionByName(asked).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "query")
    found = dealt.mapInArrow(_search_shard(norms, k, factor), "query_id long, q long, vec_id long, score double")
    order = W.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

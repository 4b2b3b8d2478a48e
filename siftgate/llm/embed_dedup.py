"""Near duplicates among embeddings of one label, exactly, by PCA-ordered tiled comparison.

Vectors are rotated onto the principal axes, the leading ones first, and scaled to length
one. The products of the leading coordinates are accumulated first; what the others can
add is at most the product of the two suffix norms, so a pair is dropped as soon as its
cosine cannot reach the threshold. The rotation is fitted on a bounded sample
(SAMPLE_ROWS); any rotation gives the same links, only not as soon.

Two unit vectors with cosine c are sqrt(2 - 2c) apart, hence no further in the first
coordinate: vectors are cut into slabs of that width along the first axis, and a slab
meets itself and the next one. Large slabs are cut into chunks that meet pair by pair.
Equal vectors are one vector with a multiplicity, so copies make no pairs. A tile
returns each vector's number of links and a spanning forest.

Rows take part when label and vector are not null and the vector is not zero and has
finite components only; others have no links and are their own component. Vectors of
different length are never linked. Null ids count as no id: a component's id is its smallest id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgate.llm.common import Forest, boundaries, components, dealt, hashed_sample, longs, tiled, whole_groups
from siftgate.llm.vectors import doubles, matrix, usable
from siftgate.plans.scratch import written

SAMPLE_ROWS = 10_000
CHUNK = 4_000
BLOCK = 512
STEP = 8
SLACK = 1e-9


def principal_axes(distinct: DataFrame) -> dict[int, np.ndarray]:
    """For each length in the sample, its axes as columns, the leading ones first."""
    rows = hashed_sample(distinct.select("node", "v"), ["node"], SAMPLE_ROWS).toArrow()["v"]
    by_dim: dict[int, list] = {}
    for row in rows:
        by_dim.setdefault(len(row), []).append(row.as_py())
    axes = {}
    for dim, some in by_dim.items():
        x = np.array(some)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        axes[dim] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    return axes


def _rotated(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x @ axes[x.shape[1]] if x.shape[1] in axes else x


def near_pairs(x: np.ndarray, unit: np.ndarray, suffix: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float):
    """Pairs (i, j) of a x b with cosine >= threshold, block by block."""
    for i in range(0, len(a), BLOCK):
        for j in range(0, len(b), BLOCK):
            p, q = a[i : i + BLOCK], b[j : j + BLOCK]
            head = unit[p, :STEP] @ unit[q, :STEP].T
            r, c = np.nonzero(head + suffix[p, 0][:, None] * suffix[q, 0][None, :] >= threshold - SLACK)
            p, q, total = p[r], q[c], head[r, c]
            for level, at in enumerate(range(STEP, unit.shape[1], STEP), 1):
                total = total + (unit[p, at : at + STEP] * unit[q, at : at + STEP]).sum(axis=1)
                keep = total + suffix[p, level] * suffix[q, level] >= threshold - SLACK
                p, q, total = p[keep], q[keep], total[keep]
            # Rotation costs some rounding: what remains is judged on the vectors themselves.
            u, v = x[p], x[q]
            cosine = (u * v).sum(axis=1) / (np.sqrt((u * u).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))
            keep = cosine >= threshold
            yield p[keep], q[keep]


def _tile_links(threshold: float, axes):
    def run(batches):
        keys = ["label", "dim", "slab", "lo", "hi"]
        for table in whole_groups(batches, keys, CHUNK):
            at = boundaries(table, keys)
            for s, e in zip(at[:-1], at[1:]):
                part = table.slice(s, e - s)
                node, times, home, chunk = (longs(part, c) for c in ("node", "times", "home", "chunk"))
                lo, hi = longs(part, "lo")[0], longs(part, "hi")[0]
                x = matrix(part.column("v"), int(longs(part, "dim")[0]))
                unit = _rotated(x, axes.value)
                square = np.cumsum((unit**2)[:, ::-1], axis=1)[:, ::-1]
                suffix = np.sqrt(np.concatenate([square[:, STEP::STEP], np.zeros((len(x), 1))], axis=1))
                homes, guests = (np.flatnonzero(home == h) for h in (1, 0))
                if lo == hi:
                    todo = [(homes, homes), (homes, guests)]
                else:
                    cut = lambda rows, c: rows[chunk[rows] == c]
                    todo = [(cut(homes, lo), cut(homes, hi)), (cut(homes, lo), cut(guests, hi)), (cut(guests, lo), cut(homes, hi))]
                links = np.zeros(len(x), np.int64)
                forest = Forest(len(x))
                for a, b in todo:
                    for i, j in near_pairs(x, unit, suffix, a, b, threshold):
                        if a is b:
                            i, j = i[i < j], j[i < j]
                        np.add.at(links, i, times[j])
                        np.add.at(links, j, times[i])
                        forest.join(i, j)
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[some]), pa.array(links[some]), pa.array(node[forest.root[some]])], ["node", "links", "root"]
                )

    return run


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row (id, n_links, component_id, kept) per row of vectors."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("e"))
    taking = usable(F.col("e")) & F.col("label").isNotNull()
    keyed = rows.withColumn("v", F.when(taking, doubles(F.col("e")))).drop("e")
    groups = keyed.where("v IS NOT NULL").groupBy("label", "v").agg(F.min("id").alias("first"), F.count("*").alias("times"))
    distinct = written(groups.withColumns({"node": F.monotonically_increasing_id(), "h": F.xxhash64("label", "v"), "dim": F.size("v").cast("long")}), "vectors")
    axes = vectors.sparkSession.sparkContext.broadcast(principal_axes(distinct))

    @F.arrow_udf("double")
    def lead(values: pa.Array) -> pa.Array:
        out = np.empty(len(values))
        for k, v in enumerate(values):
            x = np.array(v.as_py())
            first = axes.value[len(x)][:, 0] if len(x) in axes.value else np.eye(1, len(x))[0]
            out[k] = x @ first / np.linalg.norm(x)
        return pa.array(out)

    width = math.sqrt(max(2 - 2 * threshold, 1e-6)) + 1e-6
    placed = distinct.withColumn("at", F.floor(lead("v") / width).cast("long"))
    both = F.explode(F.array(*[F.struct((F.col("at") + (1 - h)).alias("slab"), F.lit(h).cast("long").alias("home")) for h in (1, 0)]))
    slabs = placed.select("label", "dim", "node", "times", "v", both.alias("p")).select("label", "dim", "node", "times", "v", "p.*")
    keys = ["label", "dim", "slab"]
    tiles = dealt(tiled(slabs, keys, ["node"], CHUNK), [*keys, "lo", "hi"])
    found = written(tiles.mapInArrow(_tile_links(threshold, axes), "node long, links long, root long"), "links")
    roots = written(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "components")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    member = distinct.select("node", "first").join(roots, "node")
    tops = member.groupBy("root").agg(F.min("first").alias("top"))
    top_of = member.join(tops, "root").select("node", "top")
    known = distinct.join(counts, "node", "left").join(top_of, "node", "left").select(
        F.col("label").alias("l"),
        F.col("v").alias("w"),
        "h",
        (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"),
        F.coalesce("top", "first").alias("component"),
    )
    hashed = keyed.withColumn("g", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")))
    joined = hashed.join(known, (F.col("g") == F.col("h")) & (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    component = F.when(F.col("h").isNull(), F.col("id")).otherwise(F.col("component"))
    return joined.select(
        "id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )

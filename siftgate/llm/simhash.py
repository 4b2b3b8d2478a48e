"""Near duplicates by SimHash fingerprints that meet in vantage-point trees.

A document's fingerprint has bit i set when over half of its shingles' hashes have it.
Fingerprints within `max_distance` bits are linked.

Search. The 64 bits are cut into `max_distance + 2` bands, and there is one vantage-point
tree for each pair of bands, with the Hamming distance on that pair's bits as its metric.
Of two fingerprints within `max_distance` bits at least two bands agree, so in one tree
their distance is 0. There the triangle bound |d(v, x) - d(v, y)| <= 0 puts both in the
same shell around every vantage point v, and a shell's own shard is the only one that its
boundary overlaps. The shells around all vantage points of a tree name the shard.
Within a shard a further tree over all 64 bits is split at the median distance to a
vantage point; a branch is skipped when the triangle bound puts it beyond `max_distance`,
and both sides are searched where a query lies that near to the boundary. What is found
is compared in full, so the links are exact.

Shards with more than `CHUNK` fingerprints are cut into chunks that meet pair by pair.
Each tile returns a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgate.llm.common import Forest, binary_parts, boundaries, components, dealt, longs, tiled, whole_groups
from siftgate.plans.scratch import written

SEED = 42
CHUNK = 20_000
LEAF = 64
VANTAGES = 16
_BLOCK = 1 << 16
# One byte's eight bits, each in a byte of its own.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").ravel()


def text_fingerprint(text: bytes, words: int = 4) -> int:
    """The unsigned fingerprint of one text; 0 when it has no word."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    starts, ends = starts[:n], ends[-n:]
    digest = xxhash.xxh64_intdigest
    sums = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        spans = zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist())
        hashes = np.array([digest(joined[i:j], SEED) for i, j in spans], "<u8")
        lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
        per = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        sums += per.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = 4) -> Column:
    """Fingerprint of whole texts as a signed long; null texts count as empty."""

    @F.arrow_udf("long")
    def of(values: pa.Array) -> pa.Array:
        found = [text_fingerprint(v.as_py() or b"", words) for v in values]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return of(F.coalesce(text, F.lit("")).cast("binary"))


def tree_links(x: np.ndarray, points: np.ndarray, queries: np.ndarray, max_distance: int, forest: Forest) -> None:
    """Join in `forest` all queries and points (positions in x) within max_distance bits."""
    todo = [(points, queries)]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > LEAF:
            v = x[p[len(p) // 2]]
            d = np.bitwise_count(x[p] ^ v).astype(np.int16)
            mu = int(np.median(d))
            inner = d <= mu
            if not inner.all():
                e = np.bitwise_count(x[q] ^ v).astype(np.int16)
                todo.append((p[inner], q[e - max_distance <= mu]))
                todo.append((p[~inner], q[e + max_distance > mu]))
                continue
        for i in range(0, len(p), LEAF):
            for j in range(0, len(q), 4096):
                pi, qj = p[i : i + LEAF], q[j : j + 4096]
                hit = np.bitwise_count(x[qj][:, None] ^ x[pi][None, :]) <= max_distance
                forest.join_block(qj, pi, hit & (qj[:, None] != pi[None, :]))


def _masks(max_distance: int) -> list[int]:
    """The bits of each tree: every pair of bands."""
    bands = [0] * (max_distance + 2)
    for bit in range(64):
        bands[bit % len(bands)] |= 1 << bit
    return [x | y for x, y in combinations(bands, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shards(fps: DataFrame, max_distance: int) -> DataFrame:
    """One row (shard, fp) for each fingerprint and tree."""
    vantages = np.random.default_rng(SEED).integers(-(2**63), 2**63, VANTAGES, dtype=np.int64).tolist()
    trees = []
    for tree, mask in enumerate(_masks(max_distance)):
        shells = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(v)).bitwiseAND(F.lit(_signed(mask)))) for v in vantages]
        trees.append(F.xxhash64(F.lit(tree), *shells))
    return fps.select("fp", F.explode(F.array(*trees)).alias("shard"))


def _tile_forest(max_distance: int):
    def run(batches):
        for table in whole_groups(batches, ["shard", "lo", "hi"]):
            at = boundaries(table, ["shard", "lo", "hi"])
            size = np.diff(at)
            x = longs(table, "fp").view(np.uint64)
            chunk, lo, hi = (longs(table, c) for c in ("chunk", "lo", "hi"))
            forest = Forest(len(x))
            # Small groups: each row against the next, the second next, ... of its group.
            group = np.repeat(np.arange(len(size)), size)
            small = (size <= LEAF)[group]
            for step in range(1, int(size[size <= LEAF].max(initial=1))):
                same = (group[step:] == group[:-step]) & small[step:] & ((chunk[step:] != chunk[:-step]) | (lo == hi)[step:])
                i = np.flatnonzero(same)
                i = i[np.bitwise_count(x[i] ^ x[i + step]) <= max_distance]
                if len(i):
                    forest.join(i, i + step)
            for g in np.flatnonzero(size > LEAF):
                rows = np.arange(at[g], at[g + 1])
                if lo[at[g]] == hi[at[g]]:
                    tree_links(x, rows, rows, max_distance, forest)
                else:
                    first = chunk[rows] == lo[at[g]]
                    tree_links(x, rows[first], rows[~first], max_distance, forest)
            node, root = forest.edges()
            yield pa.RecordBatch.from_arrays([pa.array(x[node].view(np.int64)), pa.array(x[root].view(np.int64))], ["a", "b"])

    return run


def linked_fingerprints(fps: DataFrame, max_distance: int = 4) -> DataFrame:
    """Distinct fingerprints (column fp) to (node, root) for those with a link to another one."""
    tiles = tiled(shards(fps, max_distance), ["shard"], ["fp"], CHUNK)
    near = dealt(tiles, ["shard", "lo", "hi"]).mapInArrow(_tile_forest(max_distance), "a long, b long")
    return components(near)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_distance: int = 4, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row (id, fp, component_id, *keep) per row of docs.

    component_id is the smallest id in the component, null when all its ids are null.
    Null and empty texts have fingerprint 0 and are linked like any other. Rows that
    repeat an id are kept, each with its own component. Other columns are ignored.
    """
    prints = written(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), words).alias("fp"), *keep), "prints")
    groups = prints.groupBy("fp").agg(F.min("id").alias("first"))
    linked = written(linked_fingerprints(groups.select("fp"), max_distance), "components")
    named = groups.join(linked, F.col("fp") == F.col("node")).select("fp", "root", "first")
    tops = named.groupBy("root").agg(F.min("first").alias("top"))
    of = named.join(tops, "root").select("fp", "top")
    every = groups.join(of, "fp", "left").select("fp", F.coalesce("top", "first").alias("component_id"))
    return prints.join(every, "fp").select("id", "fp", "component_id", *keep)


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_distance: int = 4
) -> DataFrame:
    """docs with one row of each component: that with the smallest id (nulls last; ties: any one).

    The rows are written once with a row number, so all that is decided about a row holds
    for the very row that stays.
    """
    numbered = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered, id_col, text_col, words, max_distance, keep=("__row",))
    group = F.struct(F.col("component_id").isNull().alias("n"), F.coalesce("component_id", "fp").alias("c"))
    best = found.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "__row")).alias("m"))
    return numbered.join(best.select("m.__row"), "__row", "left_semi").drop("__row")

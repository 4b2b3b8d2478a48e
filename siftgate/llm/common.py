"""Helpers shared by the operators: whole groups from sorted streams, chunk tiles, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgate.plans.joins import large_join
from siftgate.plans.scratch import forget, written

# Links that one task joins at once: with their sort some 50 MB.
FEW_LINKS = 500_000


def longs(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    column = table.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False)


def binary_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, with the start and length of each value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)


def boundaries(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Starts of the runs of equal keys (columns of non-null longs), with the row count at the end."""
    n = table.num_rows
    new = np.zeros(max(n - 1, 0), bool)
    for k in keys:
        v = longs(table, k)
        new |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [n]])


def whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of about `rows` rows that end where a group ends; the input is sorted by the keys.

    Memory holds `rows` rows or one group, whichever is more; callers bound their groups.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = int(boundaries(table, keys)[-2])
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        n = table.num_rows - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def each_group(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """One table per group of a stream in which equal keys follow each other; callers bound their groups."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        at = boundaries(table, keys)
        for s, e in zip(at[:-1], at[1:]):
            part = table.slice(s, e - s)
            if held and any(longs(held[0], k)[0] != longs(part, k)[0] for k in keys):
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def tiled(df: DataFrame, keys: Sequence[str], spread_by: Sequence[str], chunk_rows: int, weight: str | None = None) -> DataFrame:
    """Copies of the rows, such that any two rows of a group meet in a tile of bounded size.

    A group of at most `chunk_rows` rows (or that much in the column `weight`) is one tile. A larger one is cut into chunks by a
    hash of `spread_by`, and each pair of chunks is a tile; so no task ever holds a whole
    large group. Adds longs `chunk` (of the row), `lo` and `hi` (the tile's chunks).
    """
    keys = list(keys)
    large = (
        df.groupBy(*keys)
        .agg((F.sum(weight) if weight else F.count("*")).alias("count"))
        .where(F.col("count") > chunk_rows)
        .select(*keys, F.ceil(F.col("count") * 2 / chunk_rows).alias("chunks"))
    )
    counted = df.join(large, keys, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
    cut = counted.withColumn("chunk", F.pmod(F.xxhash64(*spread_by), "chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    return (
        cut.withColumn("other", other)
        .withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")})
        .drop("chunks", "other")
    )


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of equal keys side by side in one partition."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def hashed_sample(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """At most `rows` rows, those with the smallest hashes of the keys; the same for each run.

    A share of the hashes is cut off first by the table's count, so the sort that
    follows gets some `rows` rows in all, not `rows` rows from each partition.
    """
    n = df.count()
    mark = F.xxhash64(*keys)
    if n > rows:
        df = df.where(F.pmod(mark, F.lit(1 << 31)) < int(rows / n * (1 << 31)) + 1)
    return df.orderBy(mark, *keys).limit(rows)


class Forest:
    """Union-find over positions 0..n-1 on whole arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up

    def join_block(self, rows: np.ndarray, cols: np.ndarray, hit: np.ndarray) -> None:
        """Link rows[i] with cols[j] wherever hit[i, j], listing only pairs not yet connected."""
        if not hit.any():
            return
        some = hit.any(axis=1)
        self.join(rows[some], cols[hit[some].argmax(axis=1)])
        while True:
            i, j = np.nonzero(hit & (self.root[rows][:, None] != self.root[cols][None, :]))
            if not len(i):
                return
            self.join(rows[i], cols[j])

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        node = np.flatnonzero(self.root != np.arange(len(self.root)))
        return node, self.root[node]


def _roots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (a, b) that come, at once, to (node, root); callers bound their number."""
    links = pa.Table.from_batches(list(batches))
    node, at = np.unique(np.concatenate([longs(links, "a"), longs(links, "b")]), return_inverse=True)
    forest = Forest(len(node))
    forest.join(at[: links.num_rows], at[links.num_rows :])
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[forest.root])], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of longs to (node, root): the smallest node that each linked node reaches, roots included.

    Up to FEW_LINKS links are joined by one task. A round of joins would cost the driver a
    plan of many stages for them, with its broadcasts, metrics and threads, and most rounds
    have few links. More links take rounds: large stars and small stars in turn, until nothing
    moves or few links are left. Each round hangs nodes on their smallest neighbour with a
    partial minimum per node, so a node with very many links is no hot group, and no join
    sends a table through the driver. Rounds are written to the shared folder, so a lost
    executor costs no earlier round. Nulls and loops are ignored; no links give no rows.
    """
    a, b = F.col("a"), F.col("b")
    now = written(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    before = None
    while True:
        state = now.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head()
        if 0 < state[0] <= FEW_LINKS:
            out = written(now.coalesce(1).mapInArrow(_roots, "node long, root long"), "roots")
            forget(now)
            return out
        if state == before or not state[0]:
            return now.union(now.select("b", "b").distinct()).toDF("node", "root")
        before = state
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = large_join(both, low, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large_join(large, least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(b.alias("a"), F.col("m").alias("b")))).alias("e"))
        old, now = now, written(small.select("e.*").where(a != b).distinct(), "links")
        forget(old)

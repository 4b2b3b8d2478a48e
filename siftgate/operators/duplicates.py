"""Exact and near duplicates by fingerprint."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgate.functions.hashing import byte_grid_hash, hamming_bits, hash_bits
from siftgate.plans.components import components, few_links, spanning_forest
from siftgate.plans.joins import is_small, large_join, lookup_join
from siftgate.plans.scratch import written

BITS = 64
KEPT_BLOCKS = 3
HOT_BUCKET = 2_000
MAX_EXPANDED_DISTANCE = 4


def exact_duplicates(items: DataFrame, item: str = "item_id") -> DataFrame:
    """MD5 values shared by several items. Counted before the shuffle, so a value held by
    a large part of all items is one row per task."""
    return (
        items.groupBy("md5")
        .agg(F.count(F.lit(1)).alias("n"), F.min(item).alias("first_item"))
        .where(F.col("n") > 1)
    )


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _block_masks(max_distance: int) -> list[int]:
    """Masks of KEPT_BLOCKS out of max_distance + KEPT_BLOCKS bit blocks.

    At most max_distance blocks can differ, so two hashes within the distance agree on
    the bits of at least one mask.
    """
    n = max_distance + KEPT_BLOCKS
    edges = [BITS * i // n for i in range(n + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [_signed(sum(chosen)) for chosen in combinations(blocks, KEPT_BLOCKS)]


def _flips(radius: int) -> list[int]:
    return [
        _signed(sum(1 << bit for bit in chosen))
        for size in range(radius + 1)
        for chosen in combinations(range(BITS), size)
    ]


def _bucket_keys(hashes: DataFrame, masks: list[int]) -> DataFrame:
    keys = [
        F.struct(F.lit(no).alias("mask_no"), F.col("bits").bitwiseAND(F.lit(m)).alias("key"))
        for no, m in enumerate(masks)
    ]
    return hashes.select("bits", F.inline(F.array(*keys)))


def _pairs(left: DataFrame, right: DataFrame, on: list[str], max_distance: int) -> DataFrame:
    joined = large_join(left.withColumnRenamed("bits", "a"), right.withColumnRenamed("bits", "b"), on)
    near: Column = hamming_bits(F.col("a"), F.col("b")) <= max_distance
    return joined.where((F.col("a") < F.col("b")) & near).select("a", "b")


def _expanded_pairs(hashes: DataFrame, max_distance: int) -> DataFrame:
    """Pairs found by meeting in the middle: one side flips up to half the distance, the
    other side the rest. The flipped rows are linear in the hashes; the pairs that meet are
    not: hashes that all lie within the distance of each other give all their pairs."""
    near, far = max_distance // 2, max_distance - max_distance // 2

    def reach(radius: int) -> DataFrame:
        flips = F.array(*[F.lit(f).cast("bigint") for f in _flips(radius)])
        return hashes.select("bits", F.explode(F.transform(flips, lambda f: F.col("bits").bitwiseXOR(f))).alias("v"))

    return _pairs(reach(far), reach(near), ["v"], max_distance)


def near_hash_pairs(hashes: DataFrame, max_distance: int, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Pairs (a, b) of distinct 64-bit hashes (column `bits`) within the distance. Exact.

    Hashes meet in buckets that share some bit blocks. Members of overfull buckets are
    not paired with each other there; they go through `_expanded_pairs`.
    """
    keys = _bucket_keys(hashes, _block_masks(max_distance))
    on = ["mask_no", "key"]
    if max_distance > MAX_EXPANDED_DISTANCE:
        return _pairs(keys, keys, on, max_distance).distinct()
    hot = (
        keys.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_bucket).select(*on)
    )
    if hot.limit(1).count() == 0:
        return _pairs(keys, keys, on, max_distance).distinct()
    hot = written(hot, "hot-buckets")
    if is_small(hot):
        hot = F.broadcast(hot)
    cold = keys.join(hot, on, "left_anti")
    crowded = keys.join(hot, on, "left_semi").select("bits").distinct()
    return (
        _pairs(cold, cold, on, max_distance)
        .unionByName(_expanded_pairs(crowded, max_distance))
        .distinct()
    )


def near_duplicates(
    items: DataFrame,
    max_distance: int = 3,
    item: str = "item_id",
    content: str = "content",
    hot_bucket: int = HOT_BUCKET,
) -> DataFrame:
    """Near duplicates as pairs of hash groups: (hash_a, hash_b, distance, item_a, item_b,
    n_a, n_b), item_* being the smallest id of the group and n_* its size.

    Every item of group a is within `distance` of every item of group b; items with one
    hash form a row with hash_a = hash_b and distance 0. Copies collapse into their
    group before any pairing, so a group of any size costs one row. Items without bytes
    (null) have no hash and are left out; short ones are compared like any other.
    """
    groups = (
        items.where(F.col(content).isNotNull())
        .select(F.col(item).alias("id"), byte_grid_hash(F.col(content)).alias("phash"))
        .groupBy("phash")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_item"))
        .withColumn("bits", hash_bits(F.col("phash")))
    )
    groups = written(groups, "hash-groups")
    pairs = near_hash_pairs(groups.select("bits"), max_distance, hot_bucket)

    group = F.struct("phash", F.col("first_item").alias("item"), "n")

    def side(name: str) -> DataFrame:
        return groups.select(F.col("bits").alias(name), group.alias(f"g{name}"))

    named = large_join(large_join(pairs, side("a"), "a"), side("b"), "b")
    first, second = F.least("ga", "gb"), F.greatest("ga", "gb")
    distance = hamming_bits(F.col("a"), F.col("b"))
    across = named.select(first.alias("x"), second.alias("y"), distance.alias("distance"))
    same = groups.where(F.col("n") > 1).select(
        group.alias("x"), group.alias("y"), F.lit(0).alias("distance")
    )
    return across.unionByName(same).select(
        F.col("x.phash").alias("hash_a"),
        F.col("y.phash").alias("hash_b"),
        F.col("distance").cast("int").alias("distance"),
        F.col("x.item").alias("item_a"),
        F.col("y.item").alias("item_b"),
        F.col("x.n").alias("n_a"),
        F.col("y.n").alias("n_b"),
    )


TILE_ROWS = 8_192
# Tiles up to here give all their links, at most half as many a row; larger ones a spanning forest.
FEW_ROWS = 16


def _tile_links(max_distance: int):
    def links(tile: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        """Of whole tiles, their rows side by side."""
        at = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        sizes = np.diff(np.append(at, len(tile)))
        few = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= FEW_ROWS), sizes))
        x = bits.view(np.uint64)
        some = x[few]
        i, j = few_links(tile[few], lambda i, j: np.bitwise_count(some[i] ^ some[j]) <= max_distance)
        left, right = [few[i]], [few[j]]
        for k in np.flatnonzero(sizes > FEW_ROWS):
            own = x[at[k] : at[k] + sizes[k]]
            near = lambda lo, hi: np.bitwise_count(own[lo:hi, None] ^ own[None, :]) <= max_distance  # noqa: E731, B023
            i, j = spanning_forest(near, len(own))
            left.append(at[k] + i)
            right.append(at[k] + j)
        i, j = np.concatenate(left), np.concatenate(right)
        return pa.RecordBatch.from_arrays([pa.array(bits[i]), pa.array(bits[j])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, bits = np.empty(0, np.int64), np.empty(0, np.int64)
        held, n = [], 0
        for batch in batches:
            held.append((batch.column("tile").to_numpy(), batch.column("bits").to_numpy()))
            n += batch.num_rows
            if n < TILE_ROWS:
                continue
            tile, bits = (np.concatenate(c) for c in zip(*held))
            # The last tile may go on in the next batch.
            cut = int(np.flatnonzero(tile[1:] != tile[:-1])[-1]) + 1 if tile[0] != tile[-1] else 0
            if cut:
                yield links(tile[:cut], bits[:cut])
            held, n = [(tile[cut:], bits[cut:])], 0
        if held:
            yield links(*(np.concatenate(c) for c in zip(*held)))

    return run


def near_hash_groups(hashes: DataFrame, max_distance: int) -> DataFrame:
    """(bits, root) of distinct 64-bit hashes (column `bits`): root is the smallest hash reached by steps
    of at most max_distance bits. Exact for every distance.

    Hashes meet in buckets that share some bit blocks. A bucket is cut into tiles in which
    any two of its members meet; a tile returns the forest of its links, so that what
    leaves it is linear in its members however close they lie.
    """
    keys = _bucket_keys(hashes, _block_masks(max_distance))
    # Only buckets of more than one tile are looked up: few, as each has very many of the hashes.
    large = keys.groupBy("mask_no", "key").agg(F.count("*").alias("n")).where(F.col("n") > TILE_ROWS)
    large = written(large.select("mask_no", "key", F.ceil(F.col("n") * 2 / TILE_ROWS).alias("chunks")), "large-buckets")
    counted = lookup_join(keys, large, ["mask_no", "key"], "left", salt_by=["bits"])
    counted = counted.withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
    chunk = F.pmod(F.xxhash64("bits"), "chunks")
    tiled = counted.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    tile = F.xxhash64("mask_no", "key", F.least("chunk", "other"), F.greatest("chunk", "other"))
    dealt = tiled.select(tile.alias("tile"), "bits").repartition("tile").sortWithinPartitions("tile", "bits")
    # Two tiles of one hash would only be compared with each other's members as well.
    linked = components(dealt.mapInArrow(_tile_links(max_distance), "a long, b long"))
    out = large_join(hashes, linked.withColumnRenamed("node", "bits"), "bits", "left")
    return out.select("bits", F.coalesce("root", "bits").alias("root"))


def near_duplicate_groups(items: DataFrame, max_distance: int = 3, item: str = "item_id", content: str = "content") -> DataFrame:
    """Groups of near duplicates as membership: (item, phash, group_item, n_items, n_hashes), one row per item with bytes.

    A group is what steps of at most max_distance bits connect; group_item is its smallest
    item id. Linear in the items: no pairs are formed.
    """
    printed = items.where(F.col(content).isNotNull()).select(item, byte_grid_hash(F.col(content)).alias("phash"))
    printed = written(printed.withColumn("bits", hash_bits(F.col("phash"))), "hashes")
    hashes = written(printed.groupBy("bits").agg(F.count("*").alias("n"), F.min(item).alias("first_item")), "hash-groups")
    roots = written(near_hash_groups(hashes.select("bits"), max_distance), "roots")
    groups = large_join(hashes, roots, "bits").groupBy("root").agg(
        F.min("first_item").alias("group_item"), F.sum("n").alias("n_items"), F.count("*").alias("n_hashes")
    )
    of = lookup_join(roots, groups, ["root"], "inner", salt_by=["bits"])
    named = lookup_join(printed, written(of, "groups"), ["bits"], "inner", salt_by=[item])
    return named.select(item, "phash", "group_item", "n_items", "n_hashes")

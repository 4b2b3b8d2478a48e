"""Fingerprints against a blocklist."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgate.functions.hashing import hamming_bits, hash_bits
from siftgate.plans.joins import is_small, lookup_join


def _of_kind(blocklist: DataFrame, kind: str, flag: str) -> DataFrame:
    key = "md5" if kind == "md5" else "phash"
    # Distinct keys: a lookup must never multiply items.
    return blocklist.where(F.col("kind") == kind).select(
        F.lower("hash").alias(f"__{key}"), F.lit(True).alias(flag)
    ).distinct()


def blocklist_lookup(
    items: DataFrame, blocklist: DataFrame, item: str = "item_id", fits: bool | None = None
) -> DataFrame:
    """Add hit_hash and hit_kind to items with md5 and phash columns; MD5 wins. Exact only."""
    if fits is None:
        fits = is_small(blocklist)
    keyed = items.withColumn("__md5", F.lower("md5")).withColumn("__phash", F.lower("phash"))
    for kind, key in (("md5", "__md5"), ("phash", "__phash")):
        keyed = lookup_join(
            keyed, _of_kind(blocklist, kind, f"__{kind}_hit"), [key], "left", [item], small_fits=fits
        )
    return (
        keyed.withColumn("hit_hash", F.when(F.col("__md5_hit"), F.col("__md5")).when(F.col("__phash_hit"), F.col("__phash")))
        .withColumn("hit_kind", F.when(F.col("__md5_hit"), "md5").when(F.col("__phash_hit"), "phash"))
        .select(*items.columns, "hit_hash", "hit_kind")
    )


def blocklist_blocked(items: DataFrame, blocklist: DataFrame, item: str = "item_id") -> DataFrame:
    """Items on the blocklist."""
    hits = blocklist_lookup(items, blocklist, item)
    return hits.where(F.col("hit_kind").isNotNull()).select(*items.columns)


def blocklist_clean(items: DataFrame, blocklist: DataFrame, item: str = "item_id") -> DataFrame:
    """Items not on the blocklist."""
    hits = blocklist_lookup(items, blocklist, item)
    return hits.where(F.col("hit_kind").isNull()).select(*items.columns)


def blocklist_events(hits: DataFrame, item: str = "item_id", published_at: Column | None = None) -> DataFrame:
    """One event row per hit of `blocklist_lookup`."""
    out = hits.where(F.col("hit_kind").isNotNull()).select(
        F.lit("pipeline.preprocess.blocklist-hit").alias("type"),
        F.col(item),
        F.when(F.col("hit_kind") == "md5", F.col("hit_hash")).otherwise(F.col("md5")).alias("md5"),
        F.when(F.col("hit_kind") == "phash", F.col("hit_hash")).otherwise(F.col("phash")).alias("phash"),
        "hit_kind",
    )
    return out if published_at is None else out.withColumn("published_at", published_at)


# Blocked hashes up to here are held by every worker.
NEAR_ROWS = 2_000_000
_CANDIDATES = 1 << 22


class BandTable:
    """Blocked 64-bit hashes, findable by each of max_distance + 1 bit bands: within the distance one band is equal."""

    def __init__(self, hashes: np.ndarray, max_distance: int):
        self.hashes, self.max_distance = np.unique(hashes.astype(np.uint64)), max_distance
        edges = [64 * i // (max_distance + 1) for i in range(max_distance + 2)]
        self.bands = []
        for lo, hi in zip(edges, edges[1:]):
            value = self._band(self.hashes, lo, hi)
            order = np.argsort(value, kind="stable")
            self.bands.append((lo, hi, value[order], order))

    @staticmethod
    def _band(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return (x >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)  # 64 bits at most

    def nearest(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash the place of the nearest blocked one, ties to the smaller, and the distance; -1 without one."""
        asked, back = np.unique(asked.astype(np.uint64), return_inverse=True)
        best = np.full(len(asked), np.iinfo(np.int64).max)
        for lo, hi, values, order in self.bands:
            value = self._band(asked, lo, hi)
            first, last = np.searchsorted(values, value), np.searchsorted(values, value, "right")
            sizes = last - first
            # As many hashes at a time as meet a bounded number of candidates; one may meet more.
            group = np.cumsum(sizes) // _CANDIDATES
            for some in np.split(np.arange(len(asked)), np.flatnonzero(np.diff(group)) + 1):
                n = sizes[some]
                who = np.repeat(some, n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[some], n)
                place = order[at]
                distance = np.bitwise_count(asked[who] ^ self.hashes[place]).astype(np.int64)
                near = distance <= self.max_distance
                np.minimum.at(best, who[near], (distance[near] << 40) | place[near])
        found = best < np.iinfo(np.int64).max
        place = np.where(found, best & ((1 << 40) - 1), -1)
        return place[back], np.where(found, best >> 40, -1)[back]


def blocklist_near(items: DataFrame, blocklist: DataFrame, max_distance: int, item: str = "item_id", fits: bool | None = None) -> DataFrame:
    """Add near_hash and near_distance: the nearest blocked grid hash within max_distance bits, ties to the smaller hash.

    While the blocked hashes fit, workers hold them banded: items do not move, also on a
    stream. Beyond that the items' distinct hashes meet the bands in a join. Hashes that
    do not have 16 digits are neither near nor blocked.
    """
    whole = lambda c: F.when(F.lower(c).rlike("^[0-9a-f]{16}$"), F.lower(c))
    blocked = blocklist.where(F.col("kind") == "phash").select(whole(F.col("hash")).alias("blocked")).dropna().distinct()
    if fits is None:
        fits = is_small(blocked, NEAR_ROWS)
    spark = items.sparkSession
    if fits:
        names = sorted(r.blocked for r in blocked.collect())
        table = BandTable(np.array([int(n, 16) for n in names], np.uint64), max_distance)
        shared = spark.sparkContext.broadcast((table, pa.array(names, pa.string())))

        @F.arrow_udf("struct<hash:string,distance:int>")
        def nearest(bits: pa.Array) -> pa.Array:
            table, names = shared.value
            asked = bits.fill_null(0).to_numpy().view(np.uint64)
            place, distance = table.nearest(asked)
            none = pa.array((place < 0) | bits.is_null().to_numpy(zero_copy_only=False))
            hashes = names.take(pa.compute.if_else(none, None, pa.array(place)))
            return pa.StructArray.from_arrays([hashes, pa.compute.if_else(none, None, pa.array(distance.astype(np.int32)))], ["hash", "distance"])

        found = items.withColumn("__near", nearest(F.when(whole(F.col("phash")).isNotNull(), hash_bits(F.col("phash")))))
        return found.select(*items.columns, F.col("__near.hash").alias("near_hash"), F.col("__near.distance").alias("near_distance"))
    edges = [64 * i // (max_distance + 1) for i in range(max_distance + 2)]

    def band(lo: int, hi: int) -> Column:
        if hi - lo == 64:
            return F.col("bits")
        return F.shiftrightunsigned("bits", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("bigint"))

    def banded(hashes: DataFrame) -> DataFrame:
        keys = [F.struct(F.lit(no).alias("no"), band(*edge).alias("band")) for no, edge in enumerate(zip(edges, edges[1:]))]
        return hashes.select("*", F.inline(F.array(*keys)))

    asked = items.select(whole(F.col("phash")).alias("phash")).dropna().distinct().withColumn("bits", hash_bits(F.col("phash")))
    other = banded(blocked.withColumn("bits", hash_bits(F.col("blocked")))).withColumnRenamed("bits", "other")
    met = banded(asked).join(other, ["no", "band"])
    distance = hamming_bits(F.col("bits"), F.col("other")).cast("int")
    near = met.withColumn("distance", distance).where(F.col("distance") <= max_distance)
    best = near.groupBy("phash").agg(F.min(F.struct("distance", "blocked")).alias("m"))
    known = best.select(F.col("phash").alias("__phash"), F.col("m.blocked").alias("near_hash"), F.col("m.distance").alias("near_distance"))
    keyed = items.withColumn("__phash", F.lower("phash"))
    return lookup_join(keyed, known, ["__phash"], "left", [item]).select(*items.columns, "near_hash", "near_distance")

"""Fingerprints, blocklist, duplicates and headers on small fixed inputs."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftgate.functions.hashing import byte_grid_hash, byte_grid_hash_expr, hamming_hex, md5_hex
from siftgate.operators import duplicates
from siftgate.operators.blocklist import blocklist_blocked, blocklist_clean, blocklist_events, blocklist_lookup, blocklist_near
from siftgate.operators.duplicates import exact_duplicates, near_duplicates, near_hash_pairs
from siftgate.operators.images import image_header, image_inventory
from siftgate.plans.preprocess import preprocess_items
from siftgate.queries import QUERIES
from siftgate.sources.blocklist import blocklist_counts, load_blocklist
from siftgate.sources.items import items_from, read_items

# Bytes with their known MD5 and grid hash.
KNOWN = [
    (b"test-fixture-1", "29b137702ea42a389ca9a29e540fc784", "0003ffffffffffff"),
    (b"this is not an image at all", "1717b9136f4f42d6fdadb8970f367c9c", "9220021fffffffff"),
    (b"", "d41d8cd98f00b204e9800998ecf8427e", "0000000000000000"),
    (b"alpha", "2c1743a391305fbf367df8e4f069f9f9", "07ffffffffffffff"),
    (b"beta beta", "1add1dffcb8b329d3ccef8218e1e95a0", "007fffffffffffff"),
    (b"gamma gamma gamma", "06fbf7340cd4b9a29b8dfd8896cf6f18", "00007fffffffffff"),
    (b"delta delta delta delta", "5a2b23c70351469bbb23b5603940965e", "000001ffffffffff"),
    (b"\xff", "00594fd4f42ba43fc1ca0427a0576295", "8000000000000000"),
    (b"\0\0\0\0", "f1d3ff8443297732862df21dc4e57262", "0fffffffffffffff"),
]


def test_known_fingerprints(spark):
    df = spark.createDataFrame([(k[0],) for k in KNOWN], "c binary")
    got = {(bytes(r.c), r.m, r.g) for r in df.select("c", md5_hex(F.col("c")).alias("m"), byte_grid_hash(F.col("c")).alias("g")).collect()}
    assert got == set(KNOWN)


def test_grid_hash_equals_expression(spark):
    rng = random.Random(7)
    blobs = [rng.randbytes(n) for n in [*range(0, 70), 127, 128, 129, 1000, 6400, 6401]]
    df = spark.createDataFrame([(b,) for b in blobs] + [(None,)], "c binary").coalesce(2)
    rows = df.select("c", byte_grid_hash(F.col("c")).alias("g"), byte_grid_hash_expr(F.col("c")).alias("e")).collect()
    assert all(r.g == r.e for r in rows if r.c is not None)
    assert [r.g for r in rows if r.c is None] == [None]


def test_hamming(spark):
    pairs = [("0000", "0000", 0), ("0000", "ffff", 16), ("aaaa", "5555", 16), ("00", "0000", -1),
             ("f" * 16, "0" * 16, 64), ("f" * 33, "0" * 33, 132), ("zz", "ff", 8), ("", "", 0)]
    df = spark.createDataFrame(pairs, "a string, b string, n int")
    assert df.where(hamming_hex(F.col("a"), F.col("b")) != F.col("n")).collect() == []


def test_load_blocklist(spark, tmp_path):
    file = tmp_path / "seeds.json"
    file.write_text(json.dumps({"md5": ["AB" * 16, "ab" * 16], "phash_seed": ["F" * 16]}, indent=1))
    loaded = load_blocklist(spark, str(file))
    assert {tuple(r) for r in loaded.collect()} == {("ab" * 16, "md5"), ("f" * 16, "phash")}
    assert {r.kind: r.n for r in blocklist_counts(loaded).collect()} == {"md5": 1, "phash": 1}
    partial = tmp_path / "partial.json"
    partial.write_text('{"md5": ["cc"]}')
    assert [tuple(r) for r in load_blocklist(spark, str(partial)).collect()] == [("cc", "md5")]


@pytest.mark.parametrize("fits", [True, False])
def test_lookup_prefers_md5_and_ignores_case(spark, fits):
    items = spark.createDataFrame(
        [("1", "aa", "p1"), ("2", "bb", "p2"), ("3", "AA", "p2"), ("4", "cc", "p9")], "item_id string, md5 string, phash string"
    )
    blocked = spark.createDataFrame([("AA", "md5"), ("p2", "phash"), ("aa", "md5"), ("cc", "phash")], "hash string, kind string")
    hits = blocklist_lookup(items, blocked, fits=fits)
    assert {(r.item_id, r.hit_hash, r.hit_kind) for r in hits.collect()} == {
        ("1", "aa", "md5"), ("2", "p2", "phash"), ("3", "aa", "md5"), ("4", None, None),
    }
    assert blocklist_blocked(items, blocked).count() == 3
    assert [r.item_id for r in blocklist_clean(items, blocked).collect()] == ["4"]
    assert {(r.item_id, r.md5, r.phash) for r in blocklist_events(hits).collect()} == {
        ("1", "aa", "p1"), ("2", "bb", "p2"), ("3", "aa", "p2"),
    }


@pytest.mark.parametrize("distance, hot", [(0, 2000), (3, 2000), (3, 1), (6, 2000)])
def test_near_pairs_equal_all_pairs(spark, distance, hot):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = set(base)
    for b in base:
        for _ in range(12):
            flipped = b
            for bit in rng.sample(range(64), rng.randint(1, 7)):
                flipped ^= 1 << bit
            values.add(flipped)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    expected = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
    df = spark.createDataFrame([(v,) for v in signed], "bits bigint")
    assert {tuple(r) for r in near_hash_pairs(df, distance, hot).collect()} == expected


def test_near_duplicates_collapse_copies(spark):
    text = bytes(range(32, 128)) * 20
    other = text[:-1] + b"~"
    rows = [(f"{i}", text) for i in range(50)] + [("x", other), ("y", b"short")]
    df = spark.createDataFrame(rows, "item_id string, content binary")
    got = near_duplicates(df).collect()
    assert sum(r.n_a for r in got if r.distance == 0 and r.hash_a == r.hash_b) >= 50
    assert all("y" not in (r.item_a, r.item_b) for r in got)
    md5s = df.select("item_id", F.md5("content").alias("md5"))
    assert [(r.n, r.first_item) for r in exact_duplicates(md5s).collect()] == [(50, "0")]


def png(width, height, colour=6):
    return b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR" + width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, colour, 0, 0, 0])


def jpeg(width, height, marker=0xC0, before=b""):
    frame = bytes([0xFF, marker]) + b"\0\x11\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x03" + bytes(12)
    return b"\xff\xd8" + before + frame


def test_headers(spark):
    app = b"\xff\xe0\x00\x10" + bytes(14)
    cases = {
        "png": (png(3_000_000_000, 7), ("png", 3_000_000_000, 7, 4, True)),
        "rgb": (png(1, 1, 2), ("png", 1, 1, 3, False)),
        "sof0": (jpeg(640, 480, before=app), ("jpeg", 640, 480, 3, False)),
        "sof2": (jpeg(5, 6, 0xC2, before=b"\0\0\xff\xd0"), ("jpeg", 5, 6, 3, False)),
        "big": (jpeg(8, 9, before=b"\xff\xe1\xff\xff" + bytes(65533)), ("jpeg", 8, 9, 3, False)),
        "sof1": (jpeg(5, 6, 0xC1), None),
        "text": (b"no image", None),
        "cut": (png(1, 1)[:20], None),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "item_id string, content binary")
    got = {r.item_id: None if r.header is None else tuple(r.header) for r in image_header(df).collect()}
    assert got == {k: v[1] for k, v in cases.items()}
    counts = {r.format: r.n for r in image_inventory(df).groupBy("format").agg(F.sum("n").alias("n")).collect()}
    assert counts == {"png": 2, "jpeg": 3, "unknown": 3}


def test_preprocess_status(spark):
    raw = spark.createDataFrame([("ok", png(1, 1)), ("hit", b"test-fixture-1"), ("bad", b"plain"), ("none", None)], "item_id string, content binary")
    items = items_from(raw, "item_id", content=F.col("content"))
    blocked = spark.createDataFrame([(KNOWN[0][1].upper(), "md5")], "hash string, kind string")
    got = {r.item_id: (r.status, r.preprocess_score, r.format, r.width) for r in preprocess_items(items, blocked).collect()}
    assert got == {
        "ok": ("ok", 0.0, "png", 1),
        "hit": ("blocklist-hit", 1.0, "unknown", 0),
        "bad": ("preprocess-failed", 0.0, "unknown", 0),
        "none": ("preprocess-failed", 0.0, "unknown", 0),
    }


def test_preprocess_images_has_no_blocklist_hits(spark, tmp_path):
    """A short text of low quality has the grid hash of a part's name of its length."""
    spark.createDataFrame([(2, "abcde", 7)], "p_partkey long, p_name string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, "vwxyz")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = QUERIES["preprocess_images"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("2", "preprocess-failed", "unknown", 0, 0)]


def test_read_items_from_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(2, 3))
    rows = read_items(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].item_id.endswith("a.png") and bytes(rows[0].content) == png(2, 3)
    stored = tmp_path / "table"
    spark.createDataFrame([("1", "text")], "item_id string, ocr_text string").write.parquet(str(stored))
    row = read_items(spark, str(stored), "parquet").first()
    assert (row.item_id, row.ocr_text, row.content) == ("1", "text", None)


def test_hot_bucket_default_is_in_use():
    assert duplicates.HOT_BUCKET > 1 and len(duplicates._block_masks(3)) == 20


def brute_near(asked, blocked, distance):
    best = min(((bin(int(asked, 16) ^ int(b, 16)).count("1"), b) for b in blocked), default=(99, None))
    return (best[1], best[0]) if best[0] <= distance else (None, None)


@pytest.mark.parametrize("distance", [0, 3, 10])
@pytest.mark.parametrize("fits", [True, False])
def test_blocklist_near_is_brute_force(spark, distance, fits):
    rng = random.Random(distance)
    blocked = [f"{rng.getrandbits(64):016x}" for _ in range(40)]
    asked = [f"{int(rng.choice(blocked), 16) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(13))):016x}" for _ in range(150)]
    rows = [(str(i), h) for i, h in enumerate(asked)] + [("null", None), ("short", "00ff"), ("upper", blocked[0].upper()), ("again", asked[0])]
    items = spark.createDataFrame(rows, "item_id string, phash string")
    seeds = [(h.upper(), "phash") for h in blocked] + [("00ff", "phash"), ("0" * 32, "md5"), (asked[1], "md5")]
    got = blocklist_near(items, spark.createDataFrame(seeds, "hash string, kind string"), distance, fits=fits)
    expected = {i: brute_near(h, blocked, distance) if h and len(h) == 16 else (None, None) for i, h in rows}
    assert {r.item_id: (r.near_hash, r.near_distance) for r in got.collect()} == expected
    none = blocklist_near(items, spark.createDataFrame([], "hash string, kind string"), distance, fits=fits)
    assert {(r.near_hash, r.near_distance) for r in none.collect()} == {(None, None)}


@pytest.mark.parametrize("distance, tile", [(2, 8192), (6, 8192), (6, 20), (10, 8192)])
def test_near_hash_groups_are_brute_force(spark, monkeypatch, distance, tile):
    monkeypatch.setattr(duplicates, "TILE_ROWS", tile)
    rng = random.Random(7)
    hashes = [rng.getrandbits(64) for _ in range(30)]
    for h in list(hashes):
        for _ in range(6):
            h ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 12)))
            hashes.append(h)
    hashes = sorted({h - (1 << 64) if h >> 63 else h for h in hashes})
    root = {h: h for h in hashes}
    for a in hashes:
        for b in hashes:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= distance and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {h: new if r == old else r for h, r in root.items()}
    got = duplicates.near_hash_groups(spark.createDataFrame([(h,) for h in hashes], "bits long"), distance)
    assert {tuple(r) for r in got.collect()} == set(root.items())


def test_a_dense_group_gives_one_row_per_item(spark):
    """10,000 hashes within 4 bits of each other: their 50 million pairs are never listed."""
    masks = [0] + [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i in range(64) for j in range(i)]
    extra = [(1 << i) | (1 << j) | (1 << k) for i in range(40) for j in range(i) for k in range(j)]
    bits = [m - (1 << 64) if m >> 63 else m for m in (masks + extra)[:10_000]]
    links = []
    run = duplicates._tile_links(4)
    table = pa.table({"tile": [1] * len(bits), "bits": pa.array(bits, pa.int64())})
    for batch in run(table.to_batches(1000)):
        links.append(batch.num_rows)
    assert len(set(bits)) == 10_000 and sum(links) == 9_999


def test_near_duplicate_groups_of_items(spark):
    rows = [(None, b"x"), ("b", b"abc" * 50), ("a", b"abc" * 50), ("c", None), ("d", b"zzzz"), ("e", b"")]
    got = duplicates.near_duplicate_groups(spark.createDataFrame(rows, "item_id string, content binary"), 0)
    found = {r.item_id: (r.group_item, r.n_items, r.n_hashes) for r in got.collect()}
    assert found["a"] == found["b"] == ("a", 2, 1) and "c" not in found and len(found) == 5


def test_tables_that_grow_with_the_items_are_not_broadcast(spark):
    """A million hashes weigh little as files, but not in a driver's hash table."""
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    rows = [(str(i), bytes([i]) * 70 + bytes([255 - i]) * i) for i in range(100)]
    items = spark.createDataFrame(rows, "item_id string, content binary")
    assert "BroadcastHashJoin" not in plan(near_duplicates(items))
    hashes = spark.createDataFrame([(i,) for i in range(100)], "bits long")
    assert "BroadcastHashJoin" not in plan(duplicates.near_hash_groups(hashes, 1))


def test_tiles_cut_between_batches_give_all_links():
    """Few and many members per tile, over batches that end inside of tiles."""
    sizes = [1, 2, 17, 3, 1, 40, 16]
    tile = [t for t, n in enumerate(sizes) for _ in range(n)]
    bits = [(t << 40) | (i << 8) for t, n in enumerate(sizes) for i in range(n)]
    table = pa.table({"tile": pa.array(tile, pa.int64()), "bits": pa.array(bits, pa.int64())})
    for step in (1, 5, 100):
        out = [b for b in duplicates._tile_links(64)(iter(table.to_batches(step)))]
        links = {(a, b) for r in out for a, b in zip(r.column("a").to_pylist(), r.column("b").to_pylist())}
        assert all(a >> 40 == b >> 40 for a, b in links)
        assert {x for pair in links for x in pair} == {b for b, t in zip(bits, tile) if sizes[t] > 1}

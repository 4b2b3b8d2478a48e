"""Hard negatives against brute force and SQL; the index passes cells over without loss."""

import math

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from siftgate.llm import hard_negatives as hn
from siftgate.llm.queries import ORACLES, QUERIES

NAN = float("nan")
SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, q long, part string, shard string, scores string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 7) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(5, 12))
    out = []
    for i in range(400):
        x = centers[rng.integers(5)] + rng.normal(size=12) * 0.4
        out.append((i, (x / np.linalg.norm(x)).astype(np.float32).tolist(), int(rng.integers(4))))
    out += [(1000 + i, out[3][1], i % 2) for i in range(60)]  # copies, under two labels
    out += [(20, out[20][1], out[20][2])]  # a repeated anchor
    out += [(2000, None, 1), (2020, [NAN] * 12, 1), (2040, [None] * 12, 1), (2060, out[3][1], None), (2080, [0.0] * 12, 1)]
    out += [(2100, [], 1), (2101, [], 1), (2102, [], 2), (2120, [1.0], 1), (2121, [0.5], 1), (2122, [0.4], 2), (2123, [-0.4], 2)]
    out += [(3000, [3e30, 1.0], 7), (3001, [3e30, 1.0], 7), (3002, [1e30, 1.0], 8)]
    return out


def brute_force(rows, positives=5, negatives=10):
    good = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    good = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in good]
    out = []
    for i, v, label in {(i, tuple(v), label) for i, v, label in good if i % 20 == 0}:
        scored = sorted((-min(sum(x * y for x, y in zip(v, w)), 2**63 - 1), j, other) for j, w, other in good if j != i and len(w) == len(v))
        for p, j, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            out += [(i, j, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("shard", [4096, 32])
def test_negatives_are_brute_force(spark, rows, monkeypatch, shard):
    monkeypatch.setattr(hn, "SHARD_ROWS", shard)
    monkeypatch.setattr(hn, "ANCHORS", shard)
    got = hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 20 == 0, F.col("label"))
    assert sorted(tuple(r) for r in got.collect()) == brute_force(rows)


def test_negatives_equal_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(QUERIES["op11_hard_negatives"](spark, sf), connect(sf), ORACLES["op11_hard_negatives"]) is None


def test_no_rows(spark):
    for rows in ([], [(0, [1.0], 1)], [(0, None, None)]):
        assert hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 20 == 0, F.col("label")).collect() == []


def test_cells_come_by_falling_bound_and_hold_all_rows():
    rng = np.random.default_rng(4)
    x = np.floor(256 * np.repeat(rng.normal(size=(8, 16)), 50, axis=0) + rng.normal(size=(400, 16)) * 5)
    cells = hn.Cells(x, np.arange(400), np.zeros(400, np.int64), (hn.codebook(x[:, :8]), hn.codebook(x[:, 8:])))
    a = x[7]
    seen = list(cells.by_bound(a))
    bounds = [b for b, _, _ in seen]
    assert bounds == sorted(bounds, reverse=True) and sum(s.stop - s.start for _, _, s in seen) == 400
    for most, least, rows in seen:
        score = hn.products(cells.x[rows], a)
        assert least <= score.min() and score.max() <= most
    best = hn.Best(5)
    read = hn.search(cells, a, 7, lambda v: v == 0, [best])
    assert read < len(seen)  # certified before the last cell
    order = sorted((-int(s), i) for i, s in enumerate(hn.products(x, a)) if i != 7)[:5]
    assert [(-s, i) for s, i in zip(best.score.tolist(), best.id.tolist())] == order


def isotropic(n, dim=24, seed=5):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_anchors_meet_cells_in_blocks(monkeypatch):
    """Where nothing is passed over, a task makes no product per anchor and cell."""
    x = isotropic(600)
    rows = [{"id": i, "label": i % 4, "v": v.tolist(), "dim": 24, "part": 0, "block": 0, "shard": i % 3, "q": 0, "positives": None, "scores": None} for i, v in enumerate(x)]
    asked = [{**r, "shard": -1, "q": 1} for r in rows if r["id"] % 20 == 0]
    scaled = np.floor(256 * x.astype(float))
    books = {24: (hn.codebook(scaled[:, :12]), hn.codebook(scaled[:, 12:]))}
    types = [(c, pa.list_(pa.float32()) if c == "v" else pa.list_(pa.int64()) if c in ("positives", "scores") else pa.int64()) for c in rows[0]]

    def found(asked, k, mining):
        table = pa.Table.from_pylist(asked + sorted(rows, key=lambda r: r["shard"]), pa.schema(types))
        return pa.Table.from_batches(hn._task(books, 256, k, 30, 90, mining)(table.to_batches(100))).to_pylist()

    calls = []
    for name in ("search", "products"):
        monkeypatch.setattr(hn, name, lambda *a, of=getattr(hn, name): calls.append(1) or of(*a))
    near = found(asked, 5, False)
    for a in asked:
        own = [r for r in near if r["anchor_id"] == a["id"]]
        a["positives"], a["scores"] = [r["positive_id"] for r in own], [r["positive_score"] for r in own]
    out, rank = [], {}
    for r in found(asked, 10, True):
        key = (r["anchor_id"], r["positive_id"])
        rank[key] = rank.get(key, 0) + 1
        out.append((*key, rank[key], r["negative_id"], r["positive_score"], r["negative_score"]))
    assert sorted(out) == brute_force([(r["id"], r["v"], r["label"]) for r in rows])
    assert not calls


def test_parts_do_not_grow_with_the_rows(spark, monkeypatch):
    """An anchor goes to PARTS tasks at most, and gets as many lists, whatever the number of shards."""
    rows = [(i, v.tolist(), i % 4) for i, v in enumerate(isotropic(800))]
    monkeypatch.setattr(hn, "SHARD_ROWS", 8)
    monkeypatch.setattr(hn, "PARTS", 2)
    returned = spark.sparkContext.accumulator(0)

    def counted(*args, task=hn._task):
        def run(batches):
            for batch in task(*args)(batches):
                returned.add(batch.num_rows)
                yield batch

        return run

    monkeypatch.setattr(hn, "_task", counted)
    got = hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 20 == 0, F.col("label"))
    assert sorted(tuple(r) for r in got.collect()) == brute_force(rows)
    assert 0 < returned.value <= 40 * 2 * (5 + 5 * 10)


@pytest.mark.parametrize("tile", [1 << 19, 50])
def test_ties_and_scores_beyond_doubles_share_a_block(spark, monkeypatch, tile):
    """Anchors that need whole numbers beyond doubles, and many equal scores, beside plain ones."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-3, 4, 3).astype(float).tolist(), int(rng.integers(3))) for i in range(300)]
    rows += [(400 + i, [1.0, 1.0, 1.0], i % 3) for i in range(100)]
    rows += [(600 + i, [(1 + i) * 1e7, -1e6 * i, 1.0], i % 3) for i in range(60)]
    rows += [(700 + i, [1e30 * (i % 5), 1e29 * i, -1.0], i % 3) for i in range(40)]
    rows = [(i, np.float32(v).tolist(), label) for i, v, label in rows]
    monkeypatch.setattr(hn, "SHARD_ROWS", 64)
    monkeypatch.setattr(hn, "RUN", 2)
    monkeypatch.setattr(hn, "TILE", tile)
    got = hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 20 == 0, F.col("label"))
    assert sorted(tuple(r) for r in got.collect()) == brute_force(rows)


@pytest.mark.parametrize("tile", [1 << 19, 7])
def test_block_equals_single_searches(monkeypatch, tile):
    monkeypatch.setattr(hn, "TILE", tile)
    rng = np.random.default_rng(7)
    x = np.floor(256 * np.concatenate([isotropic(200), np.repeat(isotropic(4, seed=8), 25, axis=0)]))
    x[::50] *= 1e8
    ids, labels = rng.permutation(len(x)), rng.integers(0, 3, len(x))
    a, own, label = x[::3], ids[::3], labels[::3]
    lo, hi = np.sort(rng.integers(-20_000, 60_000, (2, len(a), 4)), axis=0)
    lo[::5, 1], hi[::5, 1] = hn.LONG.max, hn.LONG.min
    windows, single = hn.Windows(6, lo, hi), [[hn.Best(6, int(p), int(q)) for p, q in zip(*w)] for w in zip(lo, hi)]
    for part in (slice(0, 150), slice(150, None)):
        cells = hn.Cells(x[part], ids[part], labels[part], (hn.codebook(x[:, :12]), hn.codebook(x[:, 12:])))
        hn.search_block(cells, a, own, label, False, windows)
        for i, found in enumerate(single):
            hn.search(cells, a[i], own[i], lambda v: v != label[i], found)
    for i, found in enumerate(single):
        assert [(w.score.tolist(), w.id.tolist()) for w in windows.one(i)] == [(w.score.tolist(), w.id.tolist()) for w in found]

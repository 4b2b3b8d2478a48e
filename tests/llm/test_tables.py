"""Vectors, archives and the pipeline against brute force, and odd rows."""

import gzip

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from siftgate.llm import ann, bpe, embed_dedup, jaccard, quality, warc
from siftgate.llm.queries import ORACLES, QUERIES
from siftgate.plans.scratch import scratch_path

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, node long, h long, dim string, score string"
NAN = float("nan")


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 6) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 20))
    out = []
    for i in range(240):
        x = centers[i % 6] + rng.normal(size=20) * (0.12 if i % 3 else 1)
        out.append((i, x.astype(np.float32).tolist(), i % 2))
    out += [(300 + i, out[7][1], 1) for i in range(40)]  # copies
    out += [(400, None, 1), (401, [], 1), (402, [0.0] * 20, 1), (403, [NAN] * 20, 1), (404, [None] * 20, 1), (405, out[7][1], None), (406, [1.0, 2.0], 1), (407, [2.0, 4.0], 1)]
    return out


def usable(x):
    return bool(x) and None not in x and np.isfinite(x).all() and any(x)


def test_embeddings_are_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CHUNK", 16)
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(frame(spark, rows)).collect()}

    def near(a, b):
        x, y = np.array(a[1], float), np.array(b[1], float)
        return len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98

    good = [r for r in rows if usable(r[1]) and r[2] is not None]
    links = {r[0]: set() for r in rows}
    for i, a in enumerate(good):
        for b in good[:i]:
            if a[2] == b[2] and near(a, b):
                links[a[0]].add(b[0]), links[b[0]].add(a[0])
    root = {}
    for start in sorted(links):
        todo = [start]
        while todo:
            k = todo.pop()
            if k not in root:
                root[k] = start
                todo += links[k]
    assert got == {k: (len(links[k]), root[k], root[k] == k) for k in links}


def test_vectors_repeat_and_vanish(spark):
    none = frame(spark, [])
    assert embed_dedup.near_duplicates(none).count() == ann.nearest(none, F.lit(True)).count() == 0
    twice = frame(spark, [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [0.0, -0.0], 1)])
    got = sorted((r.id or 0, r.n_links, r.component_id) for r in embed_dedup.near_duplicates(twice).collect())
    assert got == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2)]


@pytest.mark.parametrize("factor", [1.0, 1.5])
def test_nearest(spark, rows, monkeypatch, factor):
    monkeypatch.setattr(ann, "SHARD_ROWS", 100)
    got = ann.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, 20, factor).collect()
    good = [(i, np.array(x, float)) for i, x, _ in rows if usable(x)]
    hits = total = 0
    for i, q in good:
        if i % 20:
            continue
        scored = [(-float((x * q).sum()), j) for j, x in good if j != i and len(x) == len(q)]
        expected = [j for _, j in sorted(scored)[:20]]
        found = [r.vec_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)]
        assert len(found) == len(expected)
        hits, total = hits + len(set(found) & set(expected)), total + len(expected)
        if factor == 1:
            assert found == expected
    assert hits >= 0.9 * total


PAGES = "page_id long, url string, html string, payload string, key string, size string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], PAGES)


def test_warc_equals_sql(spark):
    assert compare(QUERIES["op6_warc"](spark, SF), connect(SF), ORACLES["op6_warc"]) is None


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "http://c\r\nX: y", ""), (4, "u", None), (5, "u", "é" * 70_000), (None, "n", "x"), (6, "h", "a\r\n\r\nb"), (2, None, "x")]
    folder = scratch_path(spark, "warc-test")
    warc.write_archive(pages(spark, rows), folder)
    got = warc.read_archive(spark, folder).collect()
    assert len(got) == len(rows)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (6, "response", None)]
    text = {i: (h or "").encode() for i, _, h in rows}
    assert all(r.payload_bytes == len(text[r.page_id]) for r in got)
    assert all((r.payload == text[r.page_id]) if r.record_type == "response" else r.payload is None for r in got)
    fs, base = warc.opened(folder)
    parts = [f.path for f in fs.get_file_info(warc.pafs.FileSelector(base)) if f.path.endswith(".warc.gz")]
    assert sum(gzip.open(p).read().count(b"WARC/1.1\r\n") for p in parts) == len(rows)


def test_warc_appends_keep_earlier_records(spark):
    folder = scratch_path(spark, "warc-test")
    for ids in ((1, 2), (3,), ()):
        warc.write_archive(pages(spark, [(i, "u", f"text {i}") for i in ids]), folder)
    assert sorted(r.page_id for r in warc.read_archive(spark, folder, ("page_id",)).collect()) == [1, 2, 3]


def test_warc_pushes_filters_down(spark):
    folder = scratch_path(spark, "warc-test")
    warc.write_archive(pages(spark, [(i, "u", "same" if i % 2 else str(i)) for i in range(20)]), folder)
    some = warc.read_archive(spark, folder, ("page_id", "record_type")).where("record_type = 'revisit' AND page_id = 3")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert some.collect() == [(3, "revisit")] and "Filter" not in plan.replace("RuntimeFilters", "")


def test_warc_small_payloads_and_no_rows(spark):
    rows = warc.archive_rows(pages(spark, [(1, "u", "ab"), (2, "u", "ab")]), min_revisit_bytes=3).collect()
    assert {r.record_type for r in rows} == {"response"}
    folder = scratch_path(spark, "warc-test")
    warc.write_archive(pages(spark, []), folder)
    assert warc.read_archive(spark, folder).count() == 0


def similar_roots(rows):
    """The smallest id of each component of five-word Jaccard 0.8, and the similarities of its links, by brute force."""

    def plain(t):
        parts = (t or "").lower().split()
        return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()

    sets = {i: plain(t) for i, t in rows}
    root = {i: i for i in sets}
    values = []
    for i in sets:
        for j in sets:
            if i < j and (small := min(len(sets[i]), len(sets[j]))) * 5 >= 4 * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                either = len(sets[i]) + len(sets[j]) - both
                if 5 * both >= 4 * either:
                    values.append(both / max(either, 1) if small else 1)
                    old, new = max(root[i], root[j]), min(root[i], root[j])
                    root = {k: new if v == old else v for k, v in root.items()}
    return sorted(set(root.values())), values


def test_pipeline(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == first.columns
        kept.append(docs)
    quality_docs, single, masked, mixed = kept
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    score = quality.scorer(first, quality.fit(first, labels))(F.col("text"))
    assert {r.doc_id for r in first.where(score >= 0.3).collect()} == {r.doc_id for r in quality_docs.collect()}
    assert sorted(r.doc_id for r in single.collect()) == similar_roots([(r.doc_id, r.text) for r in quality_docs.collect()])[0]
    assert {r.doc_id for r in masked.collect()} == {r.doc_id for r in single.collect()}
    encoded = corpus_pipeline.STAGES[-1][1](spark, mixed, SF).collect()
    decode = bpe.Automaton(*bpe.load(public_tokenizers.path("byte_bpe_50k.json"))).decode
    assert sorted(decode(r.ids) for r in encoded) == sorted(r.text for r in mixed.collect())


def test_pipeline_without_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "none")
    assert docs.count() == 0


def test_near_duplicate_stage_is_brute_force_jaccard(spark):
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    shared = word(150)
    texts, base = [], word(300)
    for changed in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15, 20, 40):  # similarity 1 down to below 0.3
        near = list(base)
        for i in rng.choice(300, changed, replace=False):
            near[i] = f"x{rng.integers(10**9)}"
        texts.append(" ".join(near))
    texts += [" ".join(base[:250]), " ".join(base[: 240 + 20]), " ".join(base + word(60))]
    texts += [" ".join(shared + word(50)) for _ in range(30)]  # shared boilerplate, not similar
    texts += [" ".join(shared * 20 + word(30)) for _ in range(20)]  # the boilerplate again and again: near 0.7
    for k in range(20):
        text = word(40 + 10 * k)
        texts += [" ".join(text), " ".join(text[: -(k % 5) * 4 or None])]
    texts += ["", None, " \n", "a b", "A  b", "a b c", "a b c d e f"]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]

    smallest, values = similar_roots(rows)
    assert sum(0.8 <= v < 0.9 for v in values) > 5
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, other int").repartition(5)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    kept = stage(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in kept) == smallest


def test_tiles_of_near_copies_return_forests(monkeypatch):
    rng = np.random.default_rng(6)
    calls = []
    monkeypatch.setattr(jaccard, "_common", lambda x, y, old=jaccard._common: calls.append(1) or old(x, y))
    per_set, rows = [], []
    for size in (500, 1000, 2000, 4000):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 50)]
        sets = []
        for _ in range(size):
            near = list(base)
            near[rng.integers(50)] = f"x{rng.integers(10**9)}"
            sets.append(jaccard.shingles(" ".join(near).encode()))
        key = pa.array(range(size), pa.int64())
        table = pa.table({"g": [0] * size, "lo": [0] * size, "hi": [0] * size, "key": key, "root": key, "s": pa.array(sets, pa.list_(pa.int64()))})
        calls.clear()
        out = list(jaccard._links_in_tiles(table.to_batches()))
        per_set.append(len(calls) / size)
        rows.append(sum(b.num_rows for b in out) / size)
        bits = pa.array([np.frombuffer(jaccard._bit_map(s, jaccard.BITS), np.int64) for s in sets], pa.list_(pa.int64()))
        table = table.drop_columns(["g", "s"]).append_column("h", pa.array([0] * size)).append_column("bits", bits).append_column("n", pa.array(map(len, sets), pa.int32()))
        assert sum(b.num_rows for b in jaccard._likely_in_tiles(table.to_batches())) < 2 * size
    assert max(rows) < 1 and max(per_set) < 20  # of up to 3,999 partners

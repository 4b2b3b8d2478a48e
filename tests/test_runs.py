"""Clamps, fusion, scorers and whole runs on small fixed inputs."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftgate.constants import FUSION_WEIGHTS, LAYERS
from siftgate.functions.clamp import clamp01, clamp_unit
from siftgate.operators.fusion import (
    configure_fusion,
    fuse,
    fuse_fast_path,
    fuse_long,
    layer_contribution,
    layer_vector,
    score_to_action,
)
from siftgate.operators import matching, search
from siftgate.operators.matching import Entry
from siftgate.operators.scorers import (
    ScorerRegistry,
    batch_scorer,
    column_scorer,
    constant_scorer,
    default_slots,
    native_scorer,
    python_scorer,
    score_layers,
    wordlist_scorer,
)
from siftgate.plans.screen import (
    abnormal_report,
    audit_by_agent,
    audit_events,
    audit_tuple,
    rescreen,
    resume_screen,
    review_queue,
    screen,
    state_events,
    write_review_queue,
)
from siftgate.sources.audit_log import audit_line_count, file_line_count, read_audit, write_audit
from siftgate.sources.items import items_from
from siftgate.streaming.jobs import stream_screen

NAN, INF = float("nan"), float("inf")
LAYER_SCHEMA = "item_id string, " + ", ".join(f"{k} double" for k in LAYERS)


@pytest.mark.parametrize(
    "value, unit, plain",
    [(None, 0, 0), (NAN, 0, 0), (INF, 0, 1), (-INF, 0, 0), (5.0, 1, 1), (-1.0, 0, 0), (0.3, 0.3, 0.3)],
)
def test_clamps(spark, value, unit, plain):
    df = spark.createDataFrame([(value,)], "x double")
    assert tuple(df.select(clamp_unit(F.col("x")), clamp01(F.col("x"))).first()) == (unit, plain)


@pytest.mark.parametrize(
    "layers, config, score, action",
    [
        ([0.0] * 7, {}, 0.0, "PASS"),
        ([0.5] * 7, {}, 0.5, "REVIEW"),
        ([1.0] * 7, {}, 1.0, "REJECT"),
        ([1.0] + [0.0] * 6, {}, 0.1, "PASS"),
        ([1.0] + [0.0] * 6, {"weights": {"text_risk": 1.0, **{k: 0.0 for k in LAYERS[1:]}}}, 1.0, "REJECT"),
        ([None] * 7, {}, 0.0, "PASS"),
        ([5.0] * 7, {}, 1.0, "REJECT"),
        ([-1.0] * 7, {}, 0.0, "PASS"),
        ([0.5] * 7, {"review_at": 0.6}, 0.5, "PASS"),
    ],
)
def test_fuse(spark, layers, config, score, action):
    df = spark.createDataFrame([("1", *layers)], LAYER_SCHEMA)
    row = fuse(df, configure_fusion(**config)).first()
    assert (round(row.score, 10), row.action) == (score, action)
    assert dict(FUSION_WEIGHTS) == dict(configure_fusion().weights)


def test_bands_and_fast_path(spark):
    df = spark.createDataFrame([(0.39,), (0.40,), (0.8499,), (0.85,)], "s double")
    assert [r[0] for r in df.select(score_to_action(F.col("s"))).collect()] == ["PASS", "REVIEW", "REVIEW", "REJECT"]
    assert tuple(spark.range(1).select(*fuse_fast_path()).first()) == (1.0, "REJECT")


def test_long_form_contributions_and_vector(spark):
    rows = [("1", 0.1, 0.9, 0.4, None, 2.0, NAN, 0.3), ("2", *[0.5] * 7)]
    df = spark.createDataFrame(rows, LAYER_SCHEMA)
    wide = {r.item_id: round(r.score, 9) for r in fuse(df).collect()}
    long = fuse_long(df.unpivot("item_id", list(LAYERS), "layer", "score"))
    assert {r.item_id: r.score for r in long.collect()} == wide
    top = {r.item_id: r.layer for r in layer_contribution(fuse(df)).where("rank = 1").collect()}
    assert top == {"1": "vision", "2": "vision"}
    shares = layer_contribution(fuse(df)).groupBy("item_id").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in shares)
    vector = layer_vector(spark.createDataFrame([("n/a", "0.5")], "text_risk string, vision string")).first()
    assert (vector.text_risk, vector.vision, vector.logo) == (0.0, 0.0, 0.0)


def test_registry():
    registry = ScorerRegistry()
    registry.register("porn", constant_scorer("porn"))
    registry.register("ad", constant_scorer("ad"))
    with pytest.raises(ValueError):
        registry.register("ad", constant_scorer("ad"))
    assert registry.targets() == ["porn", "ad"] and registry.size() == 2 and registry.get("logo") is None
    registry.targets().append("logo")
    assert registry.size() == 2
    assert list(default_slots(logo=constant_scorer("logo", 0.9))) == list(LAYERS)
    with pytest.raises(ValueError):
        default_slots(unknown=constant_scorer("x"))


PNG = b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR\0\0\0\1\0\0\0\1\x08\6\0\0\0"
RAW = [("normal", PNG, "free und"), ("blocked", b"test-fixture-1", "free"), ("corrupt", b"this is not an image at all", None)]
BLOCKED_MD5 = "29b137702ea42a389ca9a29e540fc784"


@pytest.fixture()
def items(spark):
    raw = spark.createDataFrame(RAW, "id string, content binary, t string")
    return items_from(raw, "id", content=F.col("content"), ocr_text=F.col("t"))


@pytest.fixture()
def blocked(spark):
    return spark.createDataFrame([(BLOCKED_MD5, "md5")], "hash string, kind string")


def by_id(df):
    return {r.item_id: r for r in df.collect()}


@pytest.mark.parametrize("fits", [True, False])
def test_run_of_three_items(spark, items, blocked, fits):
    result = screen(items, blocked, blocklist_fits=fits)
    rows = by_id(result)
    assert {k: (r.action, r.terminal_state) for k, r in rows.items()} == {
        "normal": ("REVIEW", "done"), "blocked": ("REJECT", "done"), "corrupt": ("REVIEW", "done"),
    }
    assert rows["blocked"].vision.reason == "skipped-blocklist" and rows["blocked"].score == 1.0
    assert (rows["normal"].format, rows["normal"].width, rows["corrupt"].status) == ("png", 1, "preprocess-failed")
    audit = audit_events(result)
    assert {r.item_id: r.n for r in audit_line_count(audit).collect()} == {"normal": 9, "blocked": 2, "corrupt": 9}
    assert {k: (r.action, r.audit_rows) for k, r in by_id(audit_tuple(result, audit)).items()} == {
        "normal": ("REVIEW", 9), "blocked": ("REJECT", 2), "corrupt": ("REVIEW", 9),
    }
    agents = {r.agent: (r.calls, r.mean_score, r.errors) for r in audit_by_agent(audit).collect()}
    assert agents["vision-stub-002"] == (2, 0.5, 0) and agents["risk-fusion-agent"][0] == 3


@pytest.mark.parametrize("fits", [True, False])
def test_failed_and_cancelled_items(spark, items, blocked, fits):
    def failing(texts: pd.Series) -> pd.Series:
        if (texts == "free und").any():
            raise ValueError("cannot read")
        return texts.str.len() / 10

    slots = {"text_risk": python_scorer("model", failing, ["ocr_text"], "length")}
    cancel = spark.createDataFrame([("corrupt", "stop"), ("normal", "stop"), ("blocked", "stop")], "item_id string, reason string")
    result = screen(items, blocked, slots, cancel_requests=cancel, blocklist_fits=fits)
    rows = by_id(result)
    assert {k: (r.terminal_state, r.terminal_reason, r.action) for k, r in rows.items()} == {
        "normal": ("failed", "model threw: cannot read", None),
        "blocked": ("done", None, "REJECT"),
        "corrupt": ("cancelled", "stop", "REVIEW"),
    }
    assert (rows["normal"].text_risk.score, rows["normal"].text_risk.reason) == (-1.0, "error: cannot read")
    assert (rows["corrupt"].score, rows["corrupt"].reason) == (0.5, "cancelled-before-fusion")
    assert {r.item_id: r.n for r in audit_line_count(audit_events(result)).collect()} == {
        "normal": 8, "blocked": 2, "corrupt": 8,
    }
    events = {}
    for r in state_events(result).orderBy("item_id", "seq").collect():
        events.setdefault(r.item_id, []).append(r.type)
    assert events["blocked"] == [
        "pipeline.init.enter", "pipeline.init.leave", "pipeline.preprocess.enter", "pipeline.preprocess.leave",
        "pipeline.fusion.enter", "pipeline.fusion.leave", "pipeline.done.enter", "pipeline.done",
    ]
    assert events["normal"][-3:] == ["pipeline.parallel-fan-out.leave", "pipeline.failed.enter", "pipeline.failed"]
    assert events["corrupt"][-1] == "pipeline.cancelled"


def test_wordlist_and_other_scorers(spark, items, blocked, tmp_path):
    zero = {k: constant_scorer(k, 0.0) for k in LAYERS[3:]}
    slots = {
        "text_risk": wordlist_scorer([Entry("free", "promo", "原则性错误"), Entry("und", "fill", "提示")]),
        "vision": native_scorer("exif", lambda i: F.coalesce(F.size("exif"), F.lit(0)) * 1.0, "exif"),
        "metadata": column_scorer("model-table", "model_score", "model"),
        **zero,
    }
    given = items.withColumn("model_score", F.lit(0.0))
    config = configure_fusion(weights={"text_risk": 1.0})
    result = screen(given, blocked, slots, config)
    rows = by_id(result)
    assert rows["normal"].action == "REVIEW" and rows["corrupt"].action == "PASS"
    assert [m.word for m in rows["normal"].text_risk.details.matched_words] == ["free", "und"]
    report = by_id(abnormal_report(result, config))
    assert {k: r.cause for k, r in report.items()} == {"normal": "text_risk", "blocked": "blocklist-md5"}
    assert [r.item_id for r in review_queue(result).collect()] == ["normal"]
    write_review_queue(result, str(tmp_path / "queue"))
    assert spark.read.json(str(tmp_path / "queue")).first().item_id == "normal"


def test_rescreen_takes_new_and_changed_items(spark, items, blocked):
    done = screen(items, blocked).select("item_id", "md5")
    assert rescreen(items, done, blocked).count() == 0
    stale = done.withColumn("md5", F.when(F.col("item_id") == "normal", "old").otherwise(F.col("md5")))
    assert [r.item_id for r in rescreen(items, stale, blocked).collect()] == ["normal"]


def test_audit_lines(spark, items, blocked, tmp_path):
    path = str(tmp_path / "audit")
    audit = audit_events(screen(items, blocked))
    write_audit(audit, path)
    write_audit(audit, path)
    day = next((tmp_path / "audit").glob("dt=*"))
    (day / "seed.json").write_text("seed\n")
    rows = read_audit(spark, path, keep_corrupt=False)
    assert rows.count() == 40
    assert {tuple(r) for r in rows.select("level", "phase", "message").distinct().collect()} == {("INFO", "AGENT_RUN", "agent.audit")}
    kept = read_audit(spark, path).where("_corrupt_record is not null")
    assert [r._corrupt_record for r in kept.collect()] == ["seed"]
    assert file_line_count(spark, path).agg(F.sum("n")).first()[0] == 41


LISTED = [
    Entry("free", "promotion", "一般错误"),
    Entry("FREE", "shouting", "原则性错误"),
    Entry("包邮", "shipping", "原则性错误", "exact"),
    Entry("(?<!不)包邮", "shipping", "提示", "regex"),
    Entry("", "none", "提示"),
    Entry("a long phrase of many words", "phrase", "提示"),
]
READ = [("a", "Free shipping 包邮"), ("b", "不包邮 f r e e"), ("c", None), ("c", "a long phrase of many words"), (None, "free"), ("e", "😀free 包邮")]


@pytest.mark.parametrize("form", ["index", "joined"])
@pytest.mark.parametrize("blocklist_fits", [True, False])
def test_screen_with_a_wordlist_table_equals_the_literal_list(spark, monkeypatch, form, blocklist_fits):
    if form == "joined":
        monkeypatch.setattr(matching, "GRAM_PATTERNS", 0)
        monkeypatch.setattr(search, "GRAM_PATTERNS", 0)
    read = spark.createDataFrame(READ, "item_id string, text string")
    items = items_from(read, "item_id", content=F.encode(F.coalesce("text", F.lit("")), "UTF-8"), ocr_text=F.col("text"))
    blocked = spark.createDataFrame([("0" * 32, "md5")], "hash string, kind string")
    rows = [(i, e.word, e.category, e.severity, e.match) for i, e in enumerate(LISTED)]
    table = spark.createDataFrame(rows, "entry_no int, word string, category string, severity string, match string")
    expected = screen(items, blocked, {"text_risk": wordlist_scorer(LISTED)}, blocklist_fits=blocklist_fits)
    got = screen(items, blocked, wordlist=table, blocklist_fits=blocklist_fits)
    assert got.columns == expected.columns and got.schema["text_risk"].dataType.simpleString() == expected.schema["text_risk"].dataType.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


@pytest.mark.parametrize("bound", [200_000, 0])
def test_match_wordlist_forms_agree(spark, monkeypatch, bound):
    read = spark.createDataFrame(READ, "item_id string, text string")
    expected = sorted(map(str, matching.match_wordlist(read, LISTED).collect()))
    monkeypatch.setattr(matching, "wordlist_entries", lambda wordlist, limit=0: None)
    monkeypatch.setattr(matching, "GRAM_PATTERNS", bound)
    rows = [(i, e.word, e.category, e.severity, e.match) for i, e in enumerate(LISTED)]
    table = spark.createDataFrame(rows, "entry_no int, word string, category string, severity string, match string")
    assert sorted(map(str, matching.match_wordlist(read, table).collect())) == expected
    monkeypatch.setattr(matching, "REGEX_ENTRIES", 0)
    with pytest.raises(ValueError, match="regex"):
        matching.match_wordlist(read, table).collect()


def test_streams_refuse_a_wordlist_beyond_the_bounds(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(matching, "GRAM_PATTERNS", 0)
    table = spark.createDataFrame([(0, "a", "c", "s", None)], "entry_no int, word string, category string, severity string, match string")
    with pytest.raises(ValueError, match="too large for a stream"):
        stream_screen(None, None, str(tmp_path), str(tmp_path), wordlist=table)


def model_calls(folder):
    return [line.split() for f in folder.glob("*") for line in f.read_text().splitlines()]


def test_resume_runs_scorers_on_missing_layers_only(spark, items, blocked, tmp_path):
    folder = str(tmp_path)

    def seen(text, item):
        with open(f"{folder}/{os.getpid()}", "a") as log:
            log.writelines(f"{i}\n" for i in item)
        return pd.Series([0.25] * len(text))

    slots = {"ad": python_scorer("counting", seen, ["target", "item_id"], "counted")}
    more = items.where("item_id = 'normal'")
    for name in ("lacks_ad", "lacks_text", "lacks_all", "unknown", "other_agent", "failed_layer"):
        more = more.unionByName(items.where("item_id = 'normal'").withColumn("item_id", F.lit(name)))
    everything = items.unionByName(more.where("item_id <> 'normal'"))
    whole = screen(everything, blocked, slots)
    full = spark.createDataFrame(whole.collect(), whole.schema)
    is_ = lambda name: F.col("item_id") == name
    stored = full.where(~is_("unknown")).withColumns(
        {
            **{c: F.when(~is_("lacks_all"), F.col(c)) for c in full.columns if c not in ("item_id", "ad", "text_risk")},
            "text_risk": F.when(~(is_("lacks_text") | is_("lacks_all")), F.col("text_risk")),
            "ad": F.when(is_("other_agent"), F.col("ad").withField("agent", F.lit("old")))
            .when(is_("failed_layer"), F.col("ad").withField("error", F.lit("threw")))
            .when(~(is_("lacks_ad") | is_("lacks_all")), F.col("ad")),
        }
    )
    stored = spark.createDataFrame(stored.collect(), stored.schema)
    for f in tmp_path.glob("*"):
        f.unlink()
    got = resume_screen(everything, stored, blocked, slots)
    rows = got.collect()
    assert got.columns == full.columns and sorted(map(str, rows)) == sorted(map(str, full.collect()))
    assert sorted(c[0] for c in model_calls(tmp_path)) == ["failed_layer", "lacks_ad", "lacks_all", "other_agent", "unknown"]


def test_batch_scorer_sets_up_once_per_worker_and_cuts_by_bytes(spark, tmp_path):
    folder = str(tmp_path)

    def setup():
        with open(f"{folder}/{os.getpid()}", "a") as log:
            log.write("setup\n")

        def score(text):
            with open(f"{folder}/{os.getpid()}", "a") as log:
                log.write(f"batch {len(text)} {int(text.str.len().sum())}\n")
            if (text == "bad").any():
                raise ValueError("cannot read")
            return text.str.len() / 1000

        return score

    rows = [(str(i), "bad" if i == 70 else "x" * (900 if i == 5 else i % 40)) for i in range(400)]
    items = items_from(spark.createDataFrame(rows, "id string, t string").repartition(6), "id", content=F.lit(b""), ocr_text=F.col("t"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        slots = default_slots(text_risk=batch_scorer("model", setup, ["ocr_text"], "length", batch_bytes=500, batch_rows=50))
        got = {r.item_id: (r.text_risk_score, r.text_risk_error) for r in score_layers(items, slots).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: (-1.0, "cannot read") if t == "bad" else (len(t) / 1000, None) for i, t in rows}
    calls = model_calls(tmp_path)
    batches = [(int(c[1]), int(c[2])) for c in calls if c[0] == "batch"]
    assert len([c for c in calls if c[0] == "setup"]) == len(list(tmp_path.glob("*")))
    assert all(n == 1 or (n <= 50 and size <= 500) for n, size in batches) and max(n for n, _ in batches) > 7

"""Rows that the registered twins do not hold: repeated and null ids, nulls, failures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftgate.operators import matching, search
from siftgate.operators.fusion import layer_vector
from siftgate.operators.matching import Entry, match_wordlist
from siftgate.operators.messages import request_response
from siftgate.operators.scorers import python_scorer
from siftgate.operators.search import contains_any, find_regex, regex_rows, regex_start
from siftgate.plans.screen import abnormal_report, audit_events, screen
from siftgate.sources.items import items_from
from siftgate.sources.wordlist import read_wordlist


def test_requests_without_correlation_id_time_out(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, None, "t.request", at), (2, None, "t.response", at + dt.timedelta(seconds=1)), (3, "c", "t.request", at), (4, "c", "t.response", at)]
    got = request_response(spark.createDataFrame(rows, "event_id long, correlation_id string, type string, ts timestamp"), "t").collect()
    assert {r.event_id: (r.response_id, r.status) for r in got} == {1: (None, "timed-out"), 3: (4, "answered")}


def test_text_is_no_number_in_a_layer_vector(spark):
    row = layer_vector(spark.createDataFrame([("0.9", 0.9, 1)], "text_risk string, vision double, porn int")).first()
    assert (row.text_risk, row.vision, row.porn, row.logo) == (0.0, 0.9, 1.0, 0.0)


@pytest.mark.parametrize("pattern, text, start", [(r"(a)\1", "😀xbaa", 3), ("b*", "😀ab", 0), ("a", "😀", None), (r"(.)\1", "😀😀", 0)])
def test_regex_start_with_back_references(spark, pattern, text, start):
    assert spark.createDataFrame([(text,)], "t string").select(regex_start(F.col("t"), pattern)).first()[0] == start


def test_find_regex_keeps_back_references(spark):
    row = find_regex(spark.createDataFrame([("1", "😀xbaa")], "item_id string, text string"), [(r"(a)\1", "c", "s")]).first()
    assert (row.first_start, row.matches) == (3, ["aa"])


ROWS = [("1", "free pay"), ("1", "free"), ("1", "free"), (None, "pay"), ("2", None), ("3", "")]


@pytest.mark.parametrize("large", [False, True])
def test_contains_any_is_the_same_for_any_number_of_patterns(spark, monkeypatch, large):
    if large:
        monkeypatch.setattr(search, "LITERAL_PATTERNS", 0)
    items = spark.createDataFrame(ROWS, "item_id string, text string")
    patterns = spark.createDataFrame([("pay",), (None,), ("",)], "pattern string")
    assert sorted(contains_any(items, patterns).collect(), key=str) == sorted([(None, "pay"), ("1", "free pay")], key=str)


@pytest.mark.parametrize("large", [False, True])
def test_match_wordlist_is_the_same_for_any_number_of_entries(spark, monkeypatch, large):
    if large:
        monkeypatch.setattr(matching, "wordlist_entries", lambda wordlist, limit=0: None)
    items = spark.createDataFrame(ROWS, "item_id string, text string")
    wordlist = spark.createDataFrame(
        [(1, "pay", "c", "s", None), (2, None, "c", "s", None), (3, "fr[a-z]+e", "c", "s", "regex"), (4, "PAY", "c", "s", None)],
        "entry_no int, word string, category string, severity string, match string",
    )
    got = [(r.item_id or "", [m.word for m in r.matched], r.total) for r in match_wordlist(items, wordlist).collect()]
    words = {"free pay": ["fr[a-z]+e", "pay"], "free": ["fr[a-z]+e"], "pay": ["pay"]}
    assert sorted(got) == sorted((i or "", words.get(t, []), 4) for i, t in ROWS)


def blocked(spark):
    return spark.createDataFrame([], "hash string, kind string")


def test_models_get_null_inputs_and_answer_for_every_row(spark):
    items = items_from(spark.createDataFrame([("a", None), ("b", "x")], "id string, t string"), "id", content=F.lit(b"x" * 80), ocr_text=F.col("t"))
    seen = python_scorer("model", lambda t: t.isna().map({True: 0.9, False: 0.1}), ["ocr_text"], "null")
    result = screen(items, blocked(spark), {"vision": seen})
    assert {r.item_id: r.vision.score for r in result.collect()} == {"a": 0.9, "b": 0.1}
    short = python_scorer("short", lambda t: t.iloc[:0], ["ocr_text"], "none")
    assert {r.terminal_state for r in screen(items, blocked(spark), {"vision": short}).collect()} == {"failed"}


def test_audit_names_the_scorers_that_ran_and_failures_are_reported(spark):
    items = items_from(spark.createDataFrame([("a", "bad"), ("b", "fine")], "id string, t string"), "id", content=F.lit(b"x" * 80), ocr_text=F.col("t"))

    def picky(t):
        if (t == "bad").any():
            raise ValueError("no")
        return t.map(lambda _: 1.0)

    result = screen(items, blocked(spark), {"text_risk": python_scorer("my-model", picky, ["ocr_text"], "r")})
    agents = {r.agent for r in audit_events(result).where("seq = 1").collect()}
    assert agents == {"my-model"}
    report = {r.item_id: r for r in abnormal_report(result).collect()}
    assert report["a"].cause == "my-model threw: no" and report["a"].action is None


def test_entries_without_a_word_report_nothing():
    assert matching._first_listed([Entry(None, "c", "s"), Entry("", "c", "s"), Entry("A", "c", "s"), Entry("a", "c", "s")], False) == [Entry("A", "c", "s")]


def test_every_regex_match_has_its_place(spark):
    items = spark.createDataFrame([("1", "éabxb"), ("2", None), ("4", "😀xb"), ("3", "x\ufffey")], "item_id string, text string")
    got = regex_rows(find_regex(items, [("b*", "c", "s"), ("(?<=x)b", "c", "s"), ("y", "c", "s")]))
    rows = {}
    for r in got.orderBy("item_id", "entry_no", "start").collect():
        rows.setdefault((r.item_id, r.entry_no), []).append((r.start, r.end, r.hit))
    assert rows[("1", 0)] == [(0, 0, ""), (1, 1, ""), (2, 3, "b"), (3, 3, ""), (4, 5, "b"), (5, 5, "")]
    assert rows[("1", 1)] == [(4, 5, "b")] and rows[("4", 1)] == [(2, 3, "b")] and rows[("3", 2)] == [(2, 3, "y")] and ("2", 0) not in rows


@pytest.mark.parametrize(
    "line, problem", [('{"entry_no": 1, "word": "x", "category": "c", "severity": "s", "note": "?"}', "unknown fields"), ('{"entry_no": 1, "word": "x", "category": "c", "severity": "s", "match": "glob"}', "invalid match"), ('{"entry_no": 1, "word": "x", "category": "c", "severity": "s"}', None)]
)
def test_read_wordlist_is_strict(spark, tmp_path, line, problem):
    (tmp_path / "list.json").write_text(line + "\n")
    if problem is None:
        assert read_wordlist(spark, str(tmp_path)).collect() == [(1, "x", "c", "s", None)]
        return
    with pytest.raises(Exception, match=problem):
        read_wordlist(spark, str(tmp_path)).collect()

"""Normalisation, pattern search and wordlist matching on small fixed inputs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftgate.functions.text import ascii_lower, fullwidth_to_halfwidth, match_text, normalize, text_windows
from siftgate.operators.matching import (
    Entry,
    match_category_counts,
    match_rows,
    match_wordlist,
    severity_score,
)
from siftgate.operators import grams, matching, search
from siftgate.operators.search import contains_any, find_exact, find_exact_large, find_regex
from siftgate.sources.wordlist import validate_wordlist, wordlist_category_counts, wordlist_terms

WIDE_ABC = "ＡＢＣ"


@pytest.mark.parametrize(
    "text, mode, expected",
    [
        (WIDE_ABC, "collapse", "abc"),
        ("１２３", "collapse", "123"),
        ("　包　邮", "collapse", "包 邮"),
        (WIDE_ABC + " ＰＡＣＫ", "collapse", "abc pack"),
        ("  包  邮  ", "preserve", "  包  邮  "),
        ("包  邮", "strip", "包邮"),
        ("A B　C﻿D\u0085E", "strip", "abcd\u0085e"),
        ("É A", "strip", "Éa"),
        ("", "collapse", ""),
    ],
)
def test_normalize(spark, text, mode, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(normalize(F.col("t"), mode)).first()[0] == expected


def test_character_maps(spark):
    df = spark.createDataFrame([(WIDE_ABC + "É",)], "t string")
    row = df.select(fullwidth_to_halfwidth(F.col("t")), ascii_lower(F.lit("ÉAZ")), match_text(F.col("t"))).first()
    assert tuple(row) == ("ABCÉ", "Éaz", "abcé")


def test_windows_cover_text_with_overlap(spark):
    text = "".join(random.Random(1).choice("ab😀é") for _ in range(1000))
    df = spark.createDataFrame([(text,)], "t string")
    for size in (10, 400):
        got = df.select(text_windows(F.col("t"), size, 5)).first()[0]
        assert got == [text[i : i + size + 5] for i in range(0, len(text), size)]


def brute(texts, patterns, fold=str.lower):
    return sorted(
        (item, p, i)
        for item, text in texts
        for p in patterns
        if p
        for i in range(len(text))
        if fold(text).startswith(fold(p), i)
    )


TEXTS = [
    ("a", "xABCabcaaaa"),
    ("b", "京东包邮"),
    ("c", ""),
    ("d", "x" * 600 + "foo😀aab" + "y" * 255 + "FOO" + "(a+)"),
    ("e", "que" * 300),
]
PATTERNS = ["ABC", "AB", "BC", "aa", "包邮", "京东", "", "foo", "AB", "(a+)", "quequeque"]


@pytest.mark.parametrize("strategy", ["literal", "table", "join"])
def test_find_exact_equals_brute_force(spark, strategy):
    items = spark.createDataFrame(TEXTS, "item_id string, text string")
    got = find_exact(items, PATTERNS, strategy=strategy)
    assert sorted(map(tuple, got.collect())) == brute(TEXTS, PATTERNS)
    sensitive = find_exact(items, PATTERNS, case_sensitive=True, strategy=strategy)
    assert sorted(map(tuple, sensitive.collect())) == brute(TEXTS, PATTERNS, lambda s: s)


@pytest.mark.parametrize("rows, anchors", [(0, 20_000), (500_000, 2), (0, 2)])
def test_find_exact_large_beyond_bounds(spark, monkeypatch, rows, anchors):
    """Past the broadcast and literal bounds the joins shuffle and the prefilter goes."""
    monkeypatch.setattr(search, "LITERAL_ANCHORS", anchors)
    monkeypatch.setattr(search, "GRAM_PATTERNS", 0)
    real = search.lookup_join
    monkeypatch.setattr(search, "lookup_join", lambda *a, **k: real(*a, **k, max_rows=rows))
    items = spark.createDataFrame(TEXTS, "item_id string, text string")
    patterns = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    got = find_exact_large(items, patterns)
    assert sorted(map(tuple, got.collect())) == brute(TEXTS, PATTERNS)


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_gram_table_is_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(grams, "CHUNK", chunk)
    rng = random.Random(5)
    letters = "ab\0é京😀"
    texts = [None, "", *("".join(rng.choices(letters, [5, 5, 1, 1, 1, 1], k=rng.randrange(60))) for _ in range(60)), "ab" * 40]
    patterns = {"".join(rng.choices(letters, [5, 5, 1, 1, 1, 1], k=rng.randrange(1, 14))) for _ in range(120)}
    patterns |= {"ab" * n for n in range(1, 15)} | {"b" * n for n in (1, 7, 8, 9, 16)}
    patterns = sorted(patterns)
    table = grams.GramTable(patterns)
    expected = sorted((r, p, i) for r, t in enumerate(texts) for p, w in enumerate(patterns) for i in range(len(t or "")) if t.startswith(w, i))
    array = pa.array(["x", *texts])[1:]  # a slice: its buffer starts before it
    assert sorted(zip(*map(list, table.search(array)))) == expected
    firsts = {}
    for r, p, i in expected:
        firsts.setdefault((r, p), i)
    assert {(r, p): i for r, p, i in zip(*map(list, table.firsts(array)))} == firsts
    assert len(grams.GramTable([]).search(array)[0]) == 0 and len(table.search(array[:0])[0]) == 0


def test_find_exact_refuses_many_literals(spark):
    items = spark.createDataFrame(TEXTS, "item_id string, text string")
    with pytest.raises(ValueError, match="patterns"):
        find_exact(items, [f"p{i}" for i in range(65)], strategy="literal")


def test_find_exact_without_patterns(spark):
    items = spark.createDataFrame(TEXTS, "item_id string, text string")
    assert find_exact(items, []).count() == 0
    assert find_exact(items, [""], strategy="join").count() == find_exact_large(items, spark.createDataFrame([("",)], "pattern string")).count() == 0


def test_contains_any(spark, monkeypatch):
    items = spark.createDataFrame(TEXTS, "item_id string, text string")
    expected = ["a", "d", "e"]
    assert sorted(r.item_id for r in contains_any(items, ["AA", "quequ"]).collect()) == expected
    monkeypatch.setattr(search, "LITERAL_PATTERNS", 1)
    assert sorted(r.item_id for r in contains_any(items, ["AA", "quequ"]).collect()) == expected


def test_find_regex(spark):
    items = spark.createDataFrame(
        [("1", "the foo and the bar"), ("2", "不包邮包邮"), ("3", "abc"), ("4", "😀不包邮包邮")],
        "item_id string, text string",
    )
    got = find_regex(items, [("foo|bar", "c", "s"), ("(?<!不)包邮", "c", "s"), ("x*", "c", "s")])
    rows = {(r.item_id, r.entry_no): (r.matches, r.first_start) for r in got.collect()}
    assert rows[("1", 0)] == (["foo", "bar"], 4)
    assert rows[("2", 1)] == (["包邮"], 3)
    assert rows[("4", 1)] == (["包邮"], 4)
    assert rows[("3", 2)] == (["", "", "", ""], 0)
    assert ("3", 0) not in rows


ONE = [Entry("第一", "极限词", "原则性错误")]
LOOKBEHIND = [Entry("(?<!不)包邮", "平台违规", "原则性错误", "regex")]
SHIP = [Entry("包邮", "平台违规", "原则性错误")]


@pytest.mark.parametrize(
    "entries, text, expected, score",
    [
        (ONE, "本店第一", [("第一", 2, 4, "exact")], 1.0),
        (SHIP + [Entry("次日达", "x", "y")], "包邮次日达", [("包邮", 0, 2, "exact"), ("次日达", 2, 5, "exact")], 1.0),
        (LOOKBEHIND, "包邮", [("(?<!不)包邮", 0, 2, "regex")], 1.0),
        (LOOKBEHIND, "不包邮", [], 0.0),
        (SHIP, "包邮包邮包邮", [("包邮", 0, 2, "exact")], 1.0),
        (SHIP, "  包邮  ", [("包邮", 0, 2, "exact")], 1.0),
        ([Entry("a", "x", "y"), Entry("b", "x", "y")], "ab", [("a", 0, 1, "exact"), ("b", 1, 2, "exact")], 1.0),
        ([], "anything", [], 0.0),
        ([Entry("Free", "x", "y"), Entry("free", "z", "y")], "FREE", [("Free", 0, 4, "exact")], 0.5),
        ([Entry("a b", "x", "y")], "a b", [], 0.0),
    ],
)
def test_match_wordlist(spark, entries, text, expected, score):
    items = spark.createDataFrame([("1", text)], "item_id string, text string")
    row = match_wordlist(items, entries).first()
    assert [(m.word, m.span.start, m.span.end, m.match) for m in row.matched] == expected
    assert (row.total, row.score) == (len(entries), score)


def test_case_sensitive_words_with_capitals_never_match(spark):
    """The text is lowered by normalisation even then; kept for parity."""
    items = spark.createDataFrame([("1", "ABC abc")], "item_id string, text string")
    row = match_wordlist(items, [Entry("ABC", "x", "y"), Entry("abc", "x", "y")], case_sensitive=True).first()
    assert [m.word for m in row.matched] == ["abc"]


def test_large_wordlist_gives_the_same(spark, monkeypatch):
    items = spark.createDataFrame(TEXTS, "item_id string, text string")
    rows = [
        (1, "abc", "c1", "提示", None),
        (2, "ABC", "c2", "提示", "exact"),
        (3, "fo+", "c1", "一般错误", "regex"),
        (4, "包邮", "c3", "原则性错误", None),
        (5, "que", "c3", "提示", "exact"),
    ]
    wordlist = spark.createDataFrame(rows, "entry_no int, word string, category string, severity string, match string")
    small = sorted(map(str, match_wordlist(items, wordlist).collect()))
    monkeypatch.setattr(matching, "LITERAL_ENTRIES", 2)
    monkeypatch.setattr(matching.wordlist_entries, "__defaults__", (2,))
    assert sorted(map(str, match_wordlist(items, wordlist).collect())) == small


def test_match_reports(spark):
    items = spark.createDataFrame([("1", "free und"), ("2", "und"), ("3", "-")], "item_id string, text string")
    entries = [Entry("free", "promo", "一般错误"), Entry("und", "fill", "提示"), Entry("nd", "fill", "提示")]
    matched = match_wordlist(items, entries)
    assert match_rows(matched).count() == 5
    counts = {(r.category, r.severity): (r.hits, r["items"]) for r in match_category_counts(matched).collect()}
    assert counts == {("promo", "一般错误"): (1, 1), ("fill", "提示"): (4, 2)}
    scores = {r.item_id: r.s for r in matched.select("item_id", severity_score(F.col("matched")).alias("s")).collect()}
    assert scores["1"] == pytest.approx(0.4 * 0.6 + 0.6 * (0.6 + 0.2 + 0.2) / 3)
    assert scores["3"] == 0.0


def test_wordlist_tables(spark):
    raw = spark.createDataFrame(
        [(1, "最优", "a", "s", None), (2, "618", "a", "s", "exact"), (3, "x", "b", "s", "glob"),
         (4, "", "b", "s", None), (5, "y", None, "s", None), (6, "z", "b", "", "regex"), (7, "第一", "b", "s", "regex")],
        "entry_no int, word string, category string, severity string, match string",
    )
    checked = validate_wordlist(raw)
    errors = {r.entry_no: r.error for r in checked.collect()}
    assert errors == {1: None, 2: None, 3: "invalid match", 4: "missing word", 5: "missing category", 6: "missing severity", 7: None}
    with pytest.raises(Exception, match="wordlist: entry [3-6]: "):
        validate_wordlist(raw, strict=True).collect()
    valid = checked.where("error is null")
    terms = [r.word for r in wordlist_terms(valid).collect()]
    assert terms[0] == "618" and terms[-1] == "最优"
    assert {r.category: r.n for r in wordlist_category_counts(valid).collect()} == {"a": 2, "b": 1}


def test_a_search_holds_the_hits_of_a_chunk_only():
    """Four million bytes with a hit at nearly every one: work arrays and hits of all would be hundreds of MB."""
    import tracemalloc

    table = grams.GramTable(["a", "b", "ab", "ba", "abab"])
    array = pa.array(["ab" * 1000] * 2000)
    tracemalloc.start()
    row, pattern, place = table.firsts(array)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(row) == 5 * 2000 and set(place.tolist()) == {0, 1} and peak < 100_000_000

"""Search for many fixed patterns and for regular expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from siftgate.functions.text import text_windows
from siftgate.operators.grams import GramTable
from siftgate.plans.joins import is_small, lookup_join
from siftgate.plans.scratch import written

# Up to here a pattern list is written into the plan as literals.
LITERAL_PATTERNS = 64
# A pattern table up to both bounds becomes one search table that every worker holds.
GRAM_PATTERNS = 200_000
GRAM_BYTES = 20_000_000
# Distinct anchors up to here become one hash-set test per text position.
LITERAL_ANCHORS = 20_000
# Hits that a worker returns in one batch.
HITS = 100_000
ANCHOR_LENGTH = 6
WINDOW = 256
ANCHOR_WINDOW = 64

_HIT = "array<struct<pattern:string,idx:int,times:int>>"


def _fold(c: Column, case_sensitive: bool) -> Column:
    return c if case_sensitive else F.lower(c)


def _pattern_table(patterns: DataFrame, case_sensitive: bool) -> DataFrame:
    """One row per distinct pattern with its folded form and how often it is listed."""
    return (
        patterns.select("pattern")
        .where(F.char_length("pattern") > 0)
        .groupBy("pattern")
        .agg(F.count(F.lit(1)).cast("int").alias("times"))
        .withColumn("folded", _fold(F.col("pattern"), case_sensitive))
    )


def _windows(items: DataFrame, item: str, text: Column, longest: int, size: int = WINDOW) -> DataFrame:
    size = max(size, longest)
    return items.select(
        F.col(item), F.posexplode(text_windows(text, size, longest - 1)).alias("part", "window")
    ).select(item, (F.col("part") * size).alias("start"), "window", F.lit(size).alias("size"))


def _expand(hits: DataFrame, item: str) -> DataFrame:
    """Report a pattern as often as it is listed."""
    return hits.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("times")))).select(
        item, "pattern", "idx"
    )


def find_exact(
    items: DataFrame,
    patterns: DataFrame | Iterable[str],
    case_sensitive: bool = False,
    strategy: str = "auto",
    item: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """Every occurrence of every pattern, overlapping ones included.

    Returns (item, pattern, idx): pattern as listed, idx = 0-based code point in the
    searched text. A pattern listed twice is reported twice. strategy: "literal" puts the
    patterns into the plan and refuses more than LITERAL_PATTERNS, "table" gives every worker
    a search table where the patterns fit, else joins as "join" does; "auto" decides by their number.
    """
    spark = items.sparkSession
    if not isinstance(patterns, DataFrame):
        patterns = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    few = strategy in ("auto", "literal") and is_small(patterns, LITERAL_PATTERNS)
    if strategy == "literal" and not few:
        raise ValueError(f"more than {LITERAL_PATTERNS} patterns do not go into the plan")
    table = _pattern_table(patterns, case_sensitive)
    if few:
        listed = [(r.folded, r.pattern, r.times) for r in table.collect()]
        return _find_literal(items, listed, case_sensitive, item, text)
    table = written(table, "patterns")
    if strategy != "join" and is_small(table, GRAM_PATTERNS, GRAM_BYTES):
        return _find_grams(items, table, case_sensitive, item, text)
    return _find_join(items, table, case_sensitive, item, text)


def find_exact_large(items: DataFrame, patterns: DataFrame, case_sensitive: bool = False, **names) -> DataFrame:
    """`find_exact` for pattern tables of any size."""
    return find_exact(items, patterns, case_sensitive, strategy="table", **names)


def gram_table(spark: SparkSession, patterns: Sequence[str]):
    """A search table for the workers, of a list within the bounds."""
    return spark.sparkContext.broadcast(GramTable(patterns))


def _find_grams(items: DataFrame, table: DataFrame, case_sensitive: bool, item: str, text: str) -> DataFrame:
    spark = items.sparkSession
    folded = sorted({r.folded for r in table.select("folded").collect()})
    shared = gram_table(spark, folded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, pattern, place in shared.value.parts(batch.column(1)):
                for s in range(0, len(row), HITS):
                    some = slice(s, s + HITS)
                    columns = [batch.column(0).take(pa.array(row[some])), pa.array(pattern[some].astype(np.int32)), pa.array(place[some].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, [item, "__no", "idx"])

    searched = items.select(item, _fold(F.col(text), case_sensitive).alias("__t"))
    schema = StructType([items.schema[item], StructField("__no", IntegerType()), StructField("idx", IntegerType())])
    numbers = spark.createDataFrame(list(enumerate(folded)), "__no int, folded string")
    named = table.join(F.broadcast(numbers), "folded").select("__no", "pattern", "times")
    hits = searched.mapInArrow(run, schema).join(F.broadcast(named), "__no")
    if not table.where("times > 1").head(1):
        return hits.select(item, "pattern", "idx")
    return _expand(hits, item)


def _positions(window: Column, word: str) -> Column:
    """Where `word` occurs in a window that contains it, overlapping occurrences included.

    The window is cut in front of every occurrence by one regex pass; the starts of the
    pieces are the positions, so the work per window follows the number of hits.
    """
    quoted = re.sub(r"([^\w\s])", r"\\\1", word, flags=re.ASCII)
    pieces = F.regexp_extract_all(window, F.lit(f"(?s).+?(?={quoted}|\\z)"), F.lit(0))
    starts = F.aggregate(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        F.array(F.lit(0)),
        lambda at, piece: F.concat(at, F.array(F.element_at(at, -1) + F.char_length(piece))),
    )
    return F.when(F.startswith(window, F.lit(word)), starts).otherwise(
        F.slice(starts, F.lit(2), F.size(starts))
    )


def _report_at(at: Column, start: Column, pattern: str, times: int) -> Column:
    return F.transform(
        at,
        lambda i: F.struct(
            F.lit(pattern).alias("pattern"),
            (start + i).cast("int").alias("idx"),
            F.lit(times).alias("times"),
        ),
    )


def _find_literal(
    items: DataFrame,
    listed: Sequence[tuple[str, str, int]],
    case_sensitive: bool,
    item: str,
    text: str,
) -> DataFrame:
    by_folded: dict[str, list[tuple[str, int]]] = {}
    for folded, pattern, times in listed:
        by_folded.setdefault(folded, []).append((pattern, times))
    if not by_folded:
        return items.select(item, F.lit("").alias("pattern"), F.lit(0).alias("idx")).where(F.lit(False))
    words = sorted(by_folded)
    longest = max(map(len, words))
    searched = items.select(item, _fold(F.col(text), case_sensitive).alias("__t"))
    # Substring tests in generated code drop the windows without a hit. Tested per window,
    # not per text: a filter on the folded text would fold it once per pattern.
    in_window = [F.contains("window", F.lit(w)) for w in words]
    windows = _windows(searched, item, F.col("__t"), longest).where(reduce(lambda x, y: x | y, in_window))
    window, start = F.col("window"), F.col("start")

    def hits_of(word: str) -> Column:
        at = F.filter(_positions(window, word), lambda i: i < F.col("size"))
        reports = [_report_at(at, start, pattern, times) for pattern, times in by_folded[word]]
        found = reports[0] if len(reports) == 1 else F.flatten(F.array(*reports))
        return F.when(F.contains(window, F.lit(word)), found).otherwise(F.array().cast(_HIT))

    hits = windows.select(
        item, F.inline(F.flatten(F.array(*[hits_of(w) for w in words])))
    )
    return _expand(hits, item)


def _find_join(
    items: DataFrame, table: DataFrame, case_sensitive: bool, item: str, text: str
) -> DataFrame:
    shape = table.select(F.max(F.char_length("folded")).alias("longest")).first()
    if shape.longest is None:
        return items.select(item, F.lit("").alias("pattern"), F.lit(0).alias("idx")).where(F.lit(False))
    # Anchors are shortened until so few are distinct that they fit one hash-set test per position.
    for width in range(ANCHOR_LENGTH, 0, -1):
        anchored = table.withColumn("anchor", F.left("folded", F.lit(width)))
        few = [r.anchor for r in anchored.select("anchor").distinct().limit(LITERAL_ANCHORS + 1).collect()]
        if len(few) <= LITERAL_ANCHORS:
            break
    by_length: dict[int, list[str]] = {}
    for anchor in few:
        by_length.setdefault(len(anchor), []).append(anchor)

    searched = items.select(item, _fold(F.col(text), case_sensitive).alias("__t"))
    windows = _windows(searched, item, F.col("__t"), shape.longest, ANCHOR_WINDOW)
    window, at = F.col("window"), F.col("at")
    last = F.least(F.col("size"), F.char_length(window)) - 1
    # One row per position, tested in generated code before anything is copied.
    placed = windows.where(F.char_length(window) > 0).select(
        item, "start", "window", F.explode(F.sequence(F.lit(0), last)).alias("at")
    )

    # All lengths of anchors are tested at a position in one pass over the texts.
    def gram(k: int) -> Column:
        return F.substring(window, at + 1, F.lit(k))

    def is_anchor(k: int) -> Column:
        # More than the bound only with one-character anchors: then every position goes on.
        known = gram(k).isin(by_length[k]) if len(few) <= LITERAL_ANCHORS else F.lit(True)
        return known & (F.char_length(window) - at >= k)

    widths = sorted(by_length)
    found = F.array(*[F.when(is_anchor(k), gram(k)) for k in widths])
    grams = placed.where(reduce(lambda x, y: x | y, [is_anchor(k) for k in widths])).select(
        item,
        (F.col("start") + at).cast("int").alias("idx"),
        F.substring(window, at + 1, F.lit(shape.longest)).alias("rest"),
        F.explode(F.array_compact(found)).alias("anchor"),
    )
    # An anchor shared by many patterns must not multiply positions by patterns: a
    # position fans out only to the distinct lengths its anchor occurs with, then each
    # piece meets the pattern table on the whole pattern.
    lengths = anchored.select("anchor", F.char_length("folded").alias("m")).distinct()
    sized = lookup_join(grams, lengths, ["anchor"], "inner", salt_by=[item, "idx"])
    whole = sized.where(F.char_length("rest") >= F.col("m")).select(
        item, "idx", F.substring("rest", F.lit(1), F.col("m")).alias("folded")
    )
    hits = lookup_join(
        whole, table.select("folded", "pattern", "times"), ["folded"], "inner", salt_by=[item, "idx"]
    )
    return _expand(hits, item)


def contains_any(
    items: DataFrame,
    patterns: DataFrame | Iterable[str],
    case_sensitive: bool = False,
    item: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """Rows of items in which at least one pattern occurs, whatever their ids. Null patterns are none."""
    spark = items.sparkSession
    if not isinstance(patterns, DataFrame):
        patterns = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    if is_small(patterns, LITERAL_PATTERNS):
        words = [r.folded for r in _pattern_table(patterns, case_sensitive).collect()]
        if not words:
            return items.where(F.lit(False))
        # Folded once in its own projection, not once per pattern.
        folded = items.withColumn("__t", _fold(F.col(text), case_sensitive))
        tests = [F.contains(F.col("__t"), F.lit(w)) for w in sorted(words)]
        return folded.where(reduce(lambda x, y: x | y, tests)).drop("__t")
    keyed = items.withColumn("__key", row_key(item, text))
    searched = keyed.select("__key", F.col(text).alias("__t")).dropDuplicates(["__key"])
    hits = find_exact_large(searched, patterns, case_sensitive, item="__key", text="__t")
    return keyed.join(hits.select("__key").distinct(), "__key", "left_semi").drop("__key")


def row_key(item: str, text: str) -> Column:
    """A key of what decides a row's matches: its id, which may be null or repeat, and its text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in (item, text)]
    return F.sha2(F.concat(F.char_length(parts[0]).cast("string"), F.lit(":"), *parts), 256)


def regex_start(text: Column, pattern: str) -> Column:
    """0-based code point where the first match begins; null without a match.

    The built-in position counts UTF-16 units. For texts with characters outside the
    basic plane the start is the length of the text before the first match, the pattern
    itself being left as it is (a further group would shift its back-references).
    """
    unit = F.regexp_instr(text, F.lit(pattern))
    before = F.when(unit == 1, F.lit(0)).otherwise(F.char_length(F.get(F.split(text, pattern, 2), F.lit(0))))
    beyond_bmp = text.rlike(r"[\x{10000}-\x{10FFFF}]")
    return F.when(unit > 0, F.when(beyond_bmp, before).otherwise(unit - 1))


_OPEN, _CLOSE = "\ufffe", "\uffff"


def regex_spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, hit) of all matches, zero-width ones included, in code points.

    One pass puts a mark around every match, and running lengths of the pieces give the
    positions. The marks are the two noncharacters U+FFFE and U+FFFF; a text that holds
    one itself is searched with U+FFFD in its place. The engine works on UTF-16 units: in
    texts with characters outside the basic plane a pattern that matches nothing (zero
    width) is also found between such a character's two units, and later places are off.
    """
    plain = F.translate(text, _OPEN + _CLOSE, "\ufffd\ufffd")
    pieces = F.split(F.regexp_replace(plain, F.lit(pattern), F.lit(f"{_OPEN}$0{_CLOSE}")), _OPEN, -1)
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    begin = F.struct(F.char_length(F.get(pieces, F.lit(0))).alias("at"), none.alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        hit = F.substring_index(piece, _CLOSE, 1)
        end = acc["at"] + F.char_length(hit)
        one = F.struct(acc["at"].alias("start"), end.alias("end"), hit.alias("hit"))
        return F.struct((acc["at"] + F.char_length(piece) - 1).alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    return F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), begin, step, lambda acc: acc["found"])


def find_regex(
    items: DataFrame,
    entries: Sequence[tuple[str, str, str]],
    item: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """All matches per (pattern, category, severity) entry; entries without a hit give no row.

    Patterns are plan constants, so each is compiled once per task. `matches` keeps
    zero-width matches as empty strings; `spans` has the start and end of each as 0-based
    code points, `first_start` that of the first.
    """
    t = F.col(text)
    rows = [
        F.struct(
            F.lit(no).alias("entry_no"),
            F.lit(pattern).alias("pattern"),
            F.lit(category).alias("category"),
            F.lit(severity).alias("severity"),
            F.when(t.rlike(pattern), regex_spans(t, pattern)).alias("spans"),
        )
        for no, (pattern, category, severity) in enumerate(entries)
    ]
    # Wrapped, so that a filter on the spans does not search the texts a second time.
    found = items.select(item, F.inline(F.filter(F.array(*rows), lambda e: e["spans"].isNotNull())))
    return found.select(
        item, "entry_no", "pattern", "category", "severity", "spans",
        F.col("spans.hit").alias("matches"),
        F.col("spans")[0]["start"].alias("first_start"),
        F.size("spans").alias("n_matches"),
    )


def regex_rows(found: DataFrame, item: str = "item_id") -> DataFrame:
    """One row (item, entry_no, pattern, start, end, hit) per match of `find_regex`."""
    return found.select(item, "entry_no", "pattern", F.inline("spans"))

"""Wordlist matching on normalised text, and the scores that follow from it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgate.constants import SEVERITY_WEIGHTS
from siftgate.functions.clamp import clamp01
from siftgate.functions.text import match_text
from siftgate.operators.search import GRAM_BYTES, GRAM_PATTERNS, find_exact_large, gram_table, regex_start, row_key
from siftgate.plans.joins import is_small

# Exact entries up to here are searched in place; a longer list is a search table or joined.
LITERAL_ENTRIES = 500
# Regex entries are plan constants, each a pass over the text: more of them are refused.
REGEX_ENTRIES = 200

MATCHED = (
    "array<struct<word:string,category:string,severity:string,"
    "span:struct<start:int,end:int>,match:string>>"
)


FOUND = "array<struct<start:int,end:int,word:string,category:string,severity:string,match:string>>"


@dataclass(frozen=True)
class Entry:
    word: str
    category: str
    severity: str
    match: str | None = None


def _first_listed(entries: Iterable[Entry], case_sensitive: bool) -> list[Entry]:
    """Of entries that search for the same thing only the first listed reports."""
    seen: set[tuple[bool, str]] = set()
    kept = []
    for entry in entries:
        if not entry.word:
            continue
        key = (entry.match == "regex", entry.word if case_sensitive else entry.word.lower())
        if key not in seen:
            seen.add(key)
            kept.append(entry)
    return kept


def _candidate(text: Column, entry: Entry, case_sensitive: bool) -> Column:
    """(start, end, word, ...) of an entry's first occurrence; start is null without one."""
    if entry.match == "regex":
        pattern = entry.word if case_sensitive else "(?iu)" + entry.word
        start = regex_start(text, pattern)
        hit = F.coalesce(F.regexp_substr(text, F.lit(pattern)), F.lit(""))
        end = start + F.char_length(hit)
    else:
        word = entry.word if case_sensitive else entry.word.lower()
        start = F.nullif(F.instr(text, word), F.lit(0)) - 1
        end = start + len(word)
    return F.struct(
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        F.lit(entry.word).alias("word"),
        F.lit(entry.category).alias("category"),
        F.lit(entry.severity).alias("severity"),
        F.lit("regex" if entry.match == "regex" else "exact").alias("match"),
    )


def _in_order(found: Column) -> Column:
    """Sort by (start, end, word) and shape as the `matched` column."""
    return F.transform(
        F.array_sort(found),
        lambda m: F.struct(
            m["word"].alias("word"),
            m["category"].alias("category"),
            m["severity"].alias("severity"),
            F.struct(m["start"].alias("start"), m["end"].alias("end")).alias("span"),
            m["match"].alias("match"),
        ),
    )


def matched_in(text: Column, entries: Sequence[Entry], case_sensitive: bool = False) -> Column:
    """`matched` for one text column that already went through `match_text`."""
    kept = _first_listed(entries, case_sensitive)
    if not kept:
        return F.array().cast(MATCHED)
    found = F.filter(
        F.array(*[_candidate(text, e, case_sensitive) for e in kept]),
        lambda m: m["start"].isNotNull(),
    )
    return _in_order(found)


def wordlist_entries(wordlist: DataFrame | Sequence[Entry], limit: int = LITERAL_ENTRIES):
    """Entries as a list in listed order when there are at most `limit`, else None."""
    if not isinstance(wordlist, DataFrame):
        return list(wordlist)
    rows = wordlist.limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    rows.sort(key=lambda r: r.entry_no)
    return [Entry(r.word, r.category, r.severity, r.match) for r in rows]


def _is_regex() -> Column:
    return F.coalesce(F.col("match") == "regex", F.lit(False))


def _regex_entries(wordlist: DataFrame, case_sensitive: bool) -> list[Entry]:
    """The regex entries of a wordlist table in listed order, each once; an error if they are too many."""
    rows = wordlist.where(_is_regex() & (F.char_length("word") > 0)).orderBy("entry_no").limit(REGEX_ENTRIES + 1).collect()
    if len(rows) > REGEX_ENTRIES:
        raise ValueError(f"more than {REGEX_ENTRIES} regex entries; join them into alternations or split the list")
    return _first_listed([Entry(r.word, r.category, r.severity, "regex") for r in rows], case_sensitive)


def _exact_entries(wordlist: DataFrame, case_sensitive: bool) -> DataFrame:
    """(pattern, e): one row per distinct folded word with the first entry listed for it."""
    fold = F.col("word") if case_sensitive else F.lower("word")
    exact = wordlist.where(~_is_regex() & (F.char_length("word") > 0)).withColumn("pattern", fold)
    return exact.groupBy("pattern").agg(F.min_by(F.struct("word", "category", "severity"), "entry_no").alias("e"))


class WordlistIndex:
    """A wordlist table as a search table that every worker holds; works on batches and streams.

    `of` gives None for a list beyond the bounds of a search table.
    """

    def __init__(self, patterns: Sequence[str], entries: Sequence[Sequence[str]], regexes: Sequence[Entry], total: int, case_sensitive: bool, spark):
        self.total, self.regexes, self.case_sensitive = total, regexes, case_sensitive
        shared = gram_table(spark, patterns)
        word, category, severity = (pa.array([e[i] for e in entries], pa.string()) for i in range(3))
        chars = np.array([len(p) for p in patterns], np.int64)

        @F.arrow_udf(FOUND)
        def found(texts: pa.Array) -> pa.Array:
            row, pattern, place = shared.value.firsts(texts)
            at = pa.array(pattern)
            start, end = (pa.array(x.astype(np.int32)) for x in (place, place + chars[pattern]))
            columns = [start, end, word.take(at), category.take(at), severity.take(at), pa.array(["exact"] * len(row), pa.string())]
            structs = pa.StructArray.from_arrays(columns, ["start", "end", "word", "category", "severity", "match"])
            ends = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), structs)

        self._found = found if len(patterns) else None

    @classmethod
    def of(cls, wordlist: DataFrame, case_sensitive: bool = False) -> WordlistIndex | None:
        exact = _exact_entries(wordlist, case_sensitive)
        if not is_small(exact, GRAM_PATTERNS, GRAM_BYTES):
            return None
        rows = sorted(exact.collect())
        regexes = _regex_entries(wordlist, case_sensitive)
        return cls([r.pattern for r in rows], [r.e for r in rows], regexes, wordlist.count(), case_sensitive, wordlist.sparkSession)

    def matched(self, text: Column) -> Column:
        """`matched` for one text column that already went through `match_text`; empty for null."""
        found = F.array().cast(FOUND) if self._found is None else self._found(text)
        if self.regexes:
            candidates = F.array(*[_candidate(text, e, self.case_sensitive) for e in self.regexes])
            found = F.concat(found, F.filter(candidates, lambda m: m["start"].isNotNull()))
        return _in_order(found)


def match_score(n: Column, total: Column) -> Column:
    """Share of the entries that matched; 0 for an empty wordlist."""
    return F.when(total == 0, F.lit(0.0)).otherwise(clamp01(n / total))


def match_wordlist(
    items: DataFrame,
    wordlist: DataFrame | Sequence[Entry],
    case_sensitive: bool = False,
    item: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """(item, matched, total, score) per row of items, whatever its id. Each entry reports its
    first occurrence; entries without a word report nothing but count in the total."""
    entries = wordlist_entries(wordlist)
    normalised = items.select(item, match_text(F.col(text), case_sensitive).alias("__t"))
    if entries is not None:
        matched, total = matched_in(F.col("__t"), entries, case_sensitive), F.lit(len(entries))
    else:
        index = WordlistIndex.of(wordlist, case_sensitive)
        if index is None:
            return _match_large(normalised, wordlist, case_sensitive, item)
        matched, total = index.matched(F.col("__t")), F.lit(index.total)
    found = normalised.select(item, matched.alias("matched"))
    return found.select(
        item, "matched", total.alias("total"), match_score(F.size("matched"), total).alias("score")
    )


def _match_large(rows: DataFrame, wordlist: DataFrame, case_sensitive: bool, name: str) -> DataFrame:
    keyed = rows.withColumn("__key", row_key(name, "__t"))
    # Rows equal in id and text are searched once; results come back to every row.
    normalised, item = keyed.select("__key", "__t").dropDuplicates(["__key"]), "__key"
    total = wordlist.count()
    per_item = matched_per_key(normalised, wordlist, case_sensitive)
    n = F.lit(total)
    return (
        keyed.select("__key", name)
        .join(per_item, item, "left")
        .select(
            name,
            F.coalesce("matched", F.array().cast(MATCHED)).alias("matched"),
            n.cast("int").alias("total"),
            match_score(F.coalesce(F.size("matched"), F.lit(0)), n).alias("score"),
        )
    )


def matched_per_key(normalised: DataFrame, wordlist: DataFrame, case_sensitive: bool) -> DataFrame:
    """(__key, matched) of the rows (__key, __t) with any match, for a wordlist of any size."""
    item = "__key"
    exact = _exact_entries(wordlist, case_sensitive)
    hits = find_exact_large(normalised, exact.select("pattern"), True, item=item, text="__t")
    firsts = hits.groupBy(item, "pattern").agg(F.min("idx").alias("start"))
    if is_small(exact):
        exact = F.broadcast(exact)
    exact_found = firsts.join(exact, "pattern").select(
        item,
        F.struct(
            "start",
            (F.col("start") + F.char_length("pattern")).alias("end"),
            "e.word",
            "e.category",
            "e.severity",
            F.lit("exact").alias("match"),
        ).alias("m"),
    )
    regexes = _regex_entries(wordlist, case_sensitive)
    found = exact_found
    if regexes:
        regex_found = normalised.select(
            item, F.explode(F.array(*[_candidate(F.col("__t"), e, case_sensitive) for e in regexes])).alias("m")
        ).where(F.col("m.start").isNotNull())
        found = found.unionByName(regex_found)
    # At most one row per entry and item, so the list per item is no longer than the wordlist.
    return found.groupBy(item).agg(_in_order(F.collect_list("m")).alias("matched"))


def match_rows(matched: DataFrame, item: str = "item_id") -> DataFrame:
    """One row per item and matched entry."""
    # Exploding an expression, not the bare column: for a column the optimizer adds a
    # filter on its size and, pushing that down, computes the matches a second time.
    flat = F.transform(
        "matched",
        lambda m: F.struct(
            m["word"].alias("word"),
            m["category"].alias("category"),
            m["severity"].alias("severity"),
            m["span"]["start"].alias("start"),
            m["span"]["end"].alias("end"),
            m["match"].alias("match"),
        ),
    )
    return matched.select(item, F.inline(flat))


def match_category_counts(matched: DataFrame) -> DataFrame:
    """Hits and items per category and severity.

    Counted inside each item first, so the shuffle carries one partial row per group
    and task and no distinct over item ids is needed.
    """
    group = lambda m: F.struct(m["category"].alias("category"), m["severity"].alias("severity"))
    groups = F.array_distinct(F.transform("matched", group))
    per_item = matched.select(
        F.inline(
            F.transform(
                groups,
                lambda g: F.struct(
                    g["category"].alias("category"),
                    g["severity"].alias("severity"),
                    F.size(F.filter("matched", lambda m: group(m) == g)).alias("hits"),
                ),
            )
        )
    )
    return per_item.groupBy("category", "severity").agg(
        F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("items")
    )


def severity_score(matched: Column, weights: dict[str, float] = SEVERITY_WEIGHTS) -> Column:
    """clamp01(0.4 * highest severity + 0.6 * min(1, sum of severities / 3)).

    Summed by severity class in a fixed order, so the result does not depend on the
    order of the matches. Unknown severities weigh 0.
    """
    counts = {
        name: F.size(F.filter(matched, lambda m: m["severity"] == name)) for name in weights
    }
    total = highest = None
    for name, weight in weights.items():
        part = counts[name] * F.lit(weight)
        total = part if total is None else total + part
    for name, weight in sorted(weights.items(), key=lambda kv: kv[1]):
        highest = F.when(counts[name] > 0, F.lit(weight)).otherwise(
            F.lit(0.0) if highest is None else highest
        )
    return clamp01(F.lit(0.4) * highest + F.lit(0.6) * F.least(F.lit(1.0), total / F.lit(3.0)))

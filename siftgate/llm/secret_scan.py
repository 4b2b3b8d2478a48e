"""Secrets in whole texts, with SQL functions only.

Base kinds are regex matches, leftmost and non-overlapping per kind: `assign`, `access`
and `hex`. The entropy kinds add to them: over each candidate string (a maximal run of one
character class) a window slides, its Shannon entropy kept by incremental counts: the entering
character's count goes up, the leaving one's down, and only their two terms of the sum
change. Windows above the class's threshold are joined into spans. A candidate on the
allow list (plain words, plain numbers, UUIDs, separators) is passed over, and
so is a span that lies within a base span.

Null texts count as empty. Positions are code points, ends exclusive. All is computed within
the row: no shuffle, and other columns do not matter. Rows repeated give repeated results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # the runs of 24 and more among all maximal runs
BASE_KINDS = ("assign", "access", "hex")
MIN_VALUE, MIN_ACCESS = 6, 20

WINDOW = 20
# Class name: (alphabet, bits per character above which a window is suspicious).
CLASSES = {
    "entropy_hex": ("0123456789abcdefABCDEF", 3.0),
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 3.9),
}
ALLOWED = (
    "[a-z]+",
    "[A-Z]+",
    "[0-9]+",
    "[A-Z]?[a-z]+([A-Z_/+=-]+[a-z]{2,})*",
    "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "[+/=_-]+",
)


def _int(x: Column) -> Column:
    return x.cast("int")


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches as array of (start, end, hit, value), value being the group's text.

    What lies between matches and the matches themselves are lined up; running lengths give
    the positions.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    parts = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))
    none = F.array().cast("array<struct<start:int,end:int,hit:string,value:string>>")

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["gap"])
        end = start + F.length(part["hit"])
        found = F.struct(start.alias("start"), end.alias("end"), part["hit"].alias("hit"), part["value"].alias("value"))
        return F.struct(
            F.coalesce(end, start).alias("at"),
            F.when(part["hit"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(found))).alias("found"),
        )

    return F.aggregate(parts, F.struct(_int(F.lit(0)).alias("at"), none.alias("found")), step, lambda acc: acc["found"])


def _kind(spans: Column, kind: str, order: int) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")),
    )


SPANS = "array<struct<start:int,order:int,end:int,kind:string>>"


def _nothing() -> Column:
    return F.array().cast(SPANS)


def base_spans(text: Column) -> Column:
    """Sorted array of (start, order, end, kind) of the base kinds; a cheap test comes before each regex."""
    lower = F.lower(text)
    named = F.lit(False)
    for word in ASSIGN_WORDS:
        named = named | F.contains(lower, F.lit(word))
    assign = F.filter(matches(text, ASSIGN, 2), lambda s: F.length(s["value"]) >= MIN_VALUE)
    access = F.filter(matches(text, ACCESS), lambda s: F.length(s["hit"]) >= MIN_ACCESS)
    tests = (named, F.contains(text, F.lit("AKIA")), text.rlike("[0-9a-f]{24}"))
    found = (assign, access, matches(text, HEX))
    parts = [
        F.when(test, _kind(spans, kind, order).cast(SPANS)).otherwise(_nothing())
        for order, (test, spans, kind) in enumerate(zip(tests, found, BASE_KINDS))
    ]
    return F.array_sort(F.concat(*parts))


def _cell(counts: Column, code: Column) -> Column:
    return F.element_at(counts, code)


def _term(n: Column) -> Column:
    """n log2 n, 0 at 0."""
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def hot_windows(run: Column, alphabet: str, threshold: float, window: int = WINDOW) -> Column:
    """Spans (start, end) within a run where some window has more than `threshold` bits per character."""
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(alphabet), c))
    late = F.slice(F.concat(F.array_repeat(F.lit(0), window), codes), F.lit(1), F.length(run))
    steps = F.zip_with(codes, late, lambda e, l: F.struct(e.alias("enter"), l.alias("leave")))
    start = F.struct(
        _int(F.lit(0)).alias("i"),
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.array().cast("array<struct<start:int,end:int>>").alias("found"),
    )

    def step(acc: Column, x: Column) -> Column:
        enter, leave = x["enter"], x["leave"]
        counts = F.transform(
            acc["counts"],
            lambda n, k: n + F.when(k + 1 == enter, 1).otherwise(0) - F.when(k + 1 == leave, 1).otherwise(0),
        )
        came = _cell(acc["counts"], enter)
        left = F.when(leave > 0, _cell(acc["counts"], F.greatest(leave, F.lit(1)))).otherwise(F.lit(0))
        change = F.when(enter == leave, F.lit(0.0)).otherwise(
            _term(came + 1) - _term(came) + F.when(leave > 0, _term(left - 1) - _term(left)).otherwise(F.lit(0.0))
        )
        total = acc["sum"] + change
        end = acc["i"] + 1
        last = F.try_element_at(acc["found"], F.lit(-1))
        hot = (end >= window) & (F.lit(math.log2(window)) - total / window > threshold)
        one = F.array(F.struct((end - window).cast("int").alias("start"), end.cast("int").alias("end")))
        longer = F.concat(
            F.slice(acc["found"], F.lit(1), F.greatest(F.size(acc["found"]) - 1, F.lit(0))),
            F.array(F.struct(last["start"].alias("start"), end.cast("int").alias("end"))),
        )
        found = F.when(~hot, acc["found"]).when(last.isNotNull() & (last["end"] >= end - window), longer).otherwise(F.concat(acc["found"], one))
        return F.struct(end.cast("int").alias("i"), counts.alias("counts"), total.alias("sum"), found.alias("found"))

    return F.aggregate(steps, start, step, lambda acc: acc["found"])


def _class_pattern(alphabet: str) -> str:
    inside = "[" + "".join("\\" + c if c in "/=_-+" else c for c in alphabet) + "]"
    return f"(?<!{inside}){inside}{{{WINDOW},}}+"


def _moved(alphabet: str, threshold: float, kind: str, order: int):
    """A run's suspicious spans at their place in the text."""

    def of(run: Column) -> Column:
        def placed(w: Column) -> Column:
            start, end = run["start"] + w["start"], run["start"] + w["end"]
            return F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(kind).alias("kind"))

        return F.transform(hot_windows(run["hit"], alphabet, threshold), placed)

    return of


def entropy_spans(text: Column, base: Column) -> Column:
    """Sorted spans of the entropy kinds that no base span contains."""
    allowed = "^(" + "|".join(ALLOWED) + ")$"
    parts = []
    for order, (kind, (alphabet, threshold)) in enumerate(CLASSES.items(), len(BASE_KINDS)):
        pattern = _class_pattern(alphabet)
        runs = F.filter(matches(text, pattern), lambda s: ~s["hit"].rlike(allowed))

        hot = F.flatten(F.transform(runs, _moved(alphabet, threshold, kind, order)))
        parts.append(F.when(text.rlike(pattern), hot.cast(SPANS)).otherwise(_nothing()))
    new = F.filter(F.concat(*parts), lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    return F.array_sort(new)


def with_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with columns `base` and `spans`: sorted arrays of (start, order, end, kind)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    based = docs.withColumn("base", base_spans(text))
    more = based.withColumn("spans", entropy_spans(text, F.col("base")))
    return more.withColumn("spans", F.array_sort(F.concat("base", "spans")))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or group of overlapping spans, replaced by the mark."""
    start = F.struct(_int(F.lit(0)).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        piece = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(piece).alias("out"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with the secrets in their texts replaced; every row stays, null texts stay null."""
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text_col).alias("text"))
    found = with_secrets(inner)
    new = redacted(F.col("text"), F.col("spans"), mark)
    return found.select(*[(new if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names])

"""Normalisation, pattern search and wordlist matching over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftgate.functions.text import ascii_lower, fullwidth_to_halfwidth, match_text, normalize
from siftgate.operators.matching import (
    match_category_counts,
    match_rows,
    match_wordlist,
    severity_score,
)
from siftgate.operators.search import contains_any, find_exact, find_exact_large, find_regex
from siftgate.queries.base import (
    ENTRIES,
    SQL_DOCS,
    SQL_MATCHES,
    SQL_SEVERITY,
    query,
    sql_ascii_lower,
    sql_match_text,
    sql_narrow,
    sql_normalize,
    sql_text,
    table,
    texts,
)

# ASCII letters and the space moved up to their wide forms, so there is something to map.
_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
_RAISED = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + chr(0x3000)
SQL_RAISED = f"translate(text, {sql_text(_PLAIN)}, {sql_text(_RAISED)})"


def raised(spark, sf_dir):
    return texts(spark, sf_dir).withColumn("text", F.translate("text", _PLAIN, _RAISED))


@query("normalize_fullwidth", f"WITH {SQL_DOCS} SELECT item_id, {sql_narrow(SQL_RAISED)} AS text FROM docs")
def normalize_fullwidth_query(spark, sf_dir):
    return raised(spark, sf_dir).select("item_id", fullwidth_to_halfwidth(F.col("text")).alias("text"))


@query("normalize_lower", f"WITH {SQL_DOCS} SELECT item_id, {sql_ascii_lower('text')} AS text FROM docs")
def normalize_lower_query(spark, sf_dir):
    return texts(spark, sf_dir).select("item_id", ascii_lower(F.col("text")).alias("text"))


def _normalize_query(mode, name):
    sql = f"WITH {SQL_DOCS} SELECT item_id, {sql_normalize(SQL_RAISED, mode)} AS text FROM docs"

    @query(name, sql)
    def run(spark, sf_dir):
        return raised(spark, sf_dir).select("item_id", normalize(F.col("text"), mode).alias("text"))


_normalize_query("collapse", "normalize_collapse")
_normalize_query("preserve", "normalize_preserve")
_normalize_query("strip", "normalize_strip")


@query("casefold_match", f"WITH {SQL_DOCS} SELECT item_id, {sql_match_text('text')} AS text FROM docs")
def casefold_match_query(spark, sf_dir):
    return texts(spark, sf_dir).select("item_id", match_text(F.col("text")).alias("text"))


PATTERNS = ["free", "license", "public", "und", "Und", "que", "", "ere", "rere", "que"]
SENSITIVE = ["The", "Und", "de", "DE", "Que"]


def _find_sql(patterns_cte, folded):
    """Texts in overlapping windows, so that no position needs a walk over a whole text."""
    return f"""WITH {SQL_DOCS}, {patterns_cte},
span AS (SELECT max(length(pattern)) AS longest FROM patterns),
win AS (
  SELECT item_id, c, substring({folded('text')}, c + 1, 256 + longest) AS w
  FROM (SELECT item_id, text, unnest(range(0, greatest(length(text), 1), 256)) AS c FROM docs), span),
hit AS (
  SELECT item_id, pattern, c, w, unnest(range(0, 256)) AS i
  FROM win JOIN patterns ON pattern <> '' AND contains(w, {folded('pattern')}))
SELECT item_id, pattern, CAST(c + i AS INTEGER) AS idx FROM hit
WHERE substring(w, i + 1, length(pattern)) = {folded('pattern')}"""


def _listed(patterns):
    return "patterns(pattern) AS (VALUES " + ", ".join(f"({sql_text(p)})" for p in patterns) + ")"


@query("find_exact", _find_sql(_listed(PATTERNS), lambda c: f"lower({c})"))
def find_exact_query(spark, sf_dir):
    return find_exact(texts(spark, sf_dir), PATTERNS)


@query("find_exact_case_sensitive", _find_sql(_listed(SENSITIVE), lambda c: c))
def find_exact_case_sensitive_query(spark, sf_dir):
    return find_exact(texts(spark, sf_dir), SENSITIVE, case_sensitive=True)


# Patterns of the large search: the distinct words of the benchmark passages.
_WORDS = """patterns AS (
  SELECT DISTINCT word AS pattern
  FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS word FROM benchmark) WHERE word <> '')"""
_LARGE_SQL = f"""WITH {SQL_DOCS}, {_WORDS},
lengths AS (SELECT DISTINCT length(pattern) AS m FROM patterns),
span AS (SELECT max(m) AS longest FROM lengths),
win AS (
  SELECT item_id, c, substring(lower(text), c + 1, 256 + longest) AS w
  FROM (SELECT item_id, text, unnest(range(0, greatest(length(text), 1), 256)) AS c FROM docs), span),
gram AS (
  SELECT item_id, c + i AS idx, m, substring(w, i + 1, m) AS g
  FROM (SELECT item_id, c, w, unnest(range(0, 256)) AS i FROM win), lengths)
SELECT item_id, pattern, count(*) AS n, CAST(min(idx) AS INTEGER) AS first_idx, CAST(max(idx) AS INTEGER) AS last_idx,
       CAST(sum(idx) AS BIGINT) AS idx_sum
FROM gram JOIN patterns ON g = lower(pattern) AND m = length(pattern) GROUP BY item_id, pattern"""


def benchmark_words(spark, sf_dir):
    words = F.explode(F.split("text", "[^A-Za-z]+")).alias("pattern")
    return table(spark, sf_dir, "benchmark").select(words).where(F.char_length("pattern") > 0).distinct()


@query("find_exact_large", _LARGE_SQL)
def find_exact_large_query(spark, sf_dir):
    hits = find_exact_large(texts(spark, sf_dir), benchmark_words(spark, sf_dir))
    idx = F.col("idx")
    return hits.groupBy("item_id", "pattern").agg(
        F.count("*").alias("n"), F.min(idx).alias("first_idx"), F.max(idx).alias("last_idx"), F.sum(idx.cast("long")).alias("idx_sum")
    )


_ANY = ["free", "license", "@mail"]


@query(
    "contains_any",
    f"WITH {SQL_DOCS} SELECT item_id FROM docs WHERE "
    + " OR ".join(f"contains(lower(text), {sql_text(p)})" for p in _ANY),
)
def contains_any_query(spark, sf_dir):
    return contains_any(texts(spark, sf_dir), _ANY).select("item_id")


REGEXES = [
    ("licen[sc]e", "legal", "提示"),
    ("@mail[0-9]+", "contact", "原则性错误"),
    ("[0-9]{3}-[0-9]{4}", "contact", "一般错误"),
    ("qu?e", "filler", "提示"),
]


def _regex_sql(no, pattern, category, severity):
    p = sql_text(pattern)
    return f"""SELECT item_id, {no} AS entry_no, {p} AS pattern, {sql_text(category)} AS category,
  {sql_text(severity)} AS severity, CAST(len(m) AS INTEGER) AS n_matches,
  CAST(strpos(text, m[1]) - 1 AS INTEGER) AS first_start, array_to_string(m, '|') AS matches,
  array_to_string(list_transform(range(2, len(s) + 1),
    lambda i: CAST(list_sum(list_transform(s[1:i - 1], lambda x: length(x))) AS BIGINT) - (i - 2)), '|') AS starts
FROM (SELECT item_id, text, regexp_extract_all(text, {p}) AS m,
        string_split(regexp_replace(text, {p}, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS s FROM docs) WHERE len(m) > 0"""


@query(
    "find_regex",
    f"WITH {SQL_DOCS} " + " UNION ALL ".join(_regex_sql(no, *e) for no, e in enumerate(REGEXES)),
)
def find_regex_query(spark, sf_dir):
    found = find_regex(texts(spark, sf_dir), REGEXES)
    starts = F.array_join(F.col("spans.start").cast("array<string>"), "|")
    return found.withColumns({"matches": F.array_join("matches", "|"), "starts": starts}).drop("spans")


# "ue" not after "q": the twin hides "que" behind filler of the same length.
@query(
    "regex_lookbehind",
    f"""WITH {SQL_DOCS}, masked AS (SELECT item_id, replace(text, 'que', 'q##') AS t FROM docs)
SELECT item_id, CAST(len(regexp_extract_all(t, 'ue')) AS INTEGER) AS n_matches,
       CAST(strpos(t, 'ue') - 1 AS INTEGER) AS first_start
FROM masked WHERE contains(t, 'ue')""",
)
def regex_lookbehind_query(spark, sf_dir):
    found = find_regex(texts(spark, sf_dir), [("(?<!q)ue", "filler", "提示")])
    return found.select("item_id", "n_matches", "first_start")


def matched(spark, sf_dir):
    return match_wordlist(texts(spark, sf_dir), ENTRIES)


_SPELLED = """coalesce(string_agg(word || '@' || "start" || '-' || "end", ',' ORDER BY "start", "end", word), '')"""


@query(
    "match_wordlist",
    f"""WITH {SQL_MATCHES}
SELECT d.item_id, {_SPELLED} AS matched, {len(ENTRIES)} AS total, count(word) / {len(ENTRIES)}e0 AS score
FROM docs d LEFT JOIN matches m USING (item_id) GROUP BY d.item_id""",
)
def match_wordlist_query(spark, sf_dir):
    spelled = F.transform(
        "matched",
        lambda m: F.concat(
            m["word"], F.lit("@"), m["span"]["start"].cast("string"), F.lit("-"), m["span"]["end"].cast("string")
        ),
    )
    return matched(spark, sf_dir).withColumn("matched", F.array_join(spelled, ","))


@query("match_rows", f'WITH {SQL_MATCHES} SELECT item_id, word, category, severity, "start", "end", match FROM matches')
def match_rows_query(spark, sf_dir):
    return match_rows(matched(spark, sf_dir))


@query(
    "match_category_counts",
    f"""WITH {SQL_MATCHES} SELECT category, severity, count(*) AS hits, count(DISTINCT item_id) AS items
FROM matches GROUP BY category, severity""",
)
def match_category_counts_query(spark, sf_dir):
    return match_category_counts(matched(spark, sf_dir))


@query("severity_score", f"WITH {SQL_SEVERITY} SELECT item_id, text_score FROM severity")
def severity_score_query(spark, sf_dir):
    return matched(spark, sf_dir).select("item_id", severity_score(F.col("matched")).alias("text_score"))


@query("match_score", f"WITH {SQL_SEVERITY} SELECT item_id, n / {len(ENTRIES)}e0 AS score FROM severity")
def match_score_query(spark, sf_dir):
    return matched(spark, sf_dir).select("item_id", "score")

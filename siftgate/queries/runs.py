"""Whole screening runs over the documents and the tables that follow from them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from siftgate.constants import DEFAULT_SCORER_IDS, FUSION_ID, FUSION_WEIGHTS, LAYERS, PREPROCESS_ID
from siftgate.operators.scorers import native_scorer, python_scorer, wordlist_scorer
from siftgate.plans.scratch import scratch_path, written
from siftgate.plans.screen import (
    abnormal_report,
    audit_by_agent,
    audit_events,
    audit_tuple,
    cancelled_items,
    failed_items,
    rescreen,
    resume_screen,
    review_queue,
    screen,
    state_events,
)
from siftgate.queries.base import (
    ENTRIES,
    SQL_BLOCKLIST,
    SQL_SEVERITY,
    blocklist,
    item_key,
    items,
    query,
    sql_entries,
    table,
)
from siftgate.queries.layers import sql_action
from siftgate.sources.audit_log import audit_line_count, file_line_count, read_audit, write_audit
from siftgate.sources.audit_sink import append_audit, read_committed_audit

TEXT_SCORER = wordlist_scorer(ENTRIES)
ADDRESS_SCORER = native_scorer(
    "address",
    lambda i: F.lit(0.25),
    "address",
    lambda i: F.when(F.contains("ocr_text", F.lit("@")), "holds an address"),
)
PLAIN_SLOTS = {"text_risk": TEXT_SCORER}
MIXED_SLOTS = {"text_risk": TEXT_SCORER, "ad": ADDRESS_SCORER}


def plain_run(spark, sf_dir):
    return screen(items(spark, sf_dir), blocklist(spark, sf_dir), PLAIN_SLOTS)


def cancel_requests(spark, sf_dir):
    marked = table(spark, sf_dir, "labels").where("quality = 1")
    return marked.select(item_key(), F.lit("labelled").alias("reason"))


def mixed_run(spark, sf_dir):
    """A run in which some items fail and some are cancelled."""
    return screen(
        items(spark, sf_dir), blocklist(spark, sf_dir), MIXED_SLOTS, cancel_requests=cancel_requests(spark, sf_dir)
    )


def flat(result):
    """Scalar columns of a result; layers as their scores."""
    return result.select(
        "item_id", "terminal_state", "md5", "phash", "hit_kind", "status",
        *[F.col(k)["score"].alias(k) for k in LAYERS], "score", "reason", "action",
    )


def _sum(values):
    return " + ".join(f"{FUSION_WEIGHTS[k]!r}::DOUBLE * ({values.get(k, '5e-1')})" for k in LAYERS)


SQL_RUN = f"""{SQL_SEVERITY}, {SQL_BLOCKLIST},
legs AS (
  SELECT l.*, CASE WHEN hit_kind IS NOT NULL THEN 5e-1 ELSE text_score END AS text_risk,
         {_sum({'text_risk': 'text_score'})} AS s
  FROM looked l JOIN severity v USING (item_id)),
run AS (
  SELECT item_id, md5, phash, hit_kind, text_risk,
         CASE WHEN hit_kind IS NOT NULL THEN 'blocklist-hit' ELSE 'preprocess-failed' END AS status,
         CASE WHEN hit_kind IS NOT NULL OR s > 1 THEN 1e0 ELSE s END AS score
  FROM legs),
plain AS (SELECT *, {sql_action('score')} AS action FROM run)"""

SQL_MIXED = f"""{SQL_SEVERITY}, {SQL_BLOCKLIST},
asked AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS item_id FROM labels WHERE quality = 1),
state AS (
  SELECT l.*, text_score, CASE
      WHEN hit_kind IS NOT NULL THEN 'hit'
      WHEN contains(d.text, '@') THEN 'failed'
      WHEN a.item_id IS NOT NULL THEN 'cancelled' ELSE 'done' END AS path,
    {_sum({'text_risk': 'text_score', 'ad': '25e-2'})} AS s
  FROM looked l JOIN severity USING (item_id) JOIN docs d USING (item_id) LEFT JOIN asked a USING (item_id)),
mixed AS (
  SELECT *, CASE path WHEN 'hit' THEN 1e0 WHEN 'failed' THEN NULL WHEN 'cancelled' THEN 5e-1 ELSE least(s, 1e0) END AS score,
         CASE path WHEN 'failed' THEN NULL WHEN 'cancelled' THEN 'cancelled-before-fusion' ELSE 'fusion-decision' END AS reason,
         CASE path WHEN 'hit' THEN 'done' ELSE path END AS terminal_state
  FROM state),
acted AS (
  SELECT *, CASE path WHEN 'failed' THEN NULL WHEN 'cancelled' THEN 'REVIEW' ELSE {sql_action('score')} END AS action FROM mixed)"""


def _audit_sql(source):
    legs = {
        "text_risk": ("text-risk-wordlist", "text_score", "'wordlist-match'"),
        "vision": (None, "5e-1", "'stub-vision'"),
        "metadata": (None, "5e-1", "'stub-metadata'"),
        "porn": (None, "5e-1", "'stub-porn'"),
        "ad": (
            "address",
            "CASE WHEN path = 'failed' THEN -1e0 ELSE 25e-2 END",
            "CASE WHEN path = 'failed' THEN 'error: holds an address' ELSE 'address' END",
        ),
        "political": (None, "5e-1", "'stub-political'"),
        "logo": (None, "5e-1", "'stub-logo'"),
    }
    if source == "plain":
        legs["ad"] = (None, "5e-1", "'stub-ad'")
    rows = [
        f"""SELECT item_id, 0 AS seq, '{PREPROCESS_ID}' AS agent, CASE WHEN path = 'hit' THEN 1e0 ELSE 0e0 END AS score,
  CASE WHEN path = 'hit' THEN 'blocklist-hit' ELSE 'preprocess-failed' END AS reason FROM src"""
    ]
    for seq, (layer, (agent, score, reason)) in enumerate(legs.items(), 1):
        name = agent or DEFAULT_SCORER_IDS[layer]
        rows.append(f"SELECT item_id, {seq}, '{name}', {score}, {reason} FROM src WHERE path <> 'hit'")
    rows.append(
        f"SELECT item_id, 8, '{FUSION_ID}', score, 'fusion-decision' FROM src WHERE path IN ('hit', 'done')"
    )
    return "audit AS (" + " UNION ALL ".join(rows) + ")"


SQL_MIXED_AUDIT = f"{SQL_MIXED}, src AS (SELECT * FROM acted), {_audit_sql('mixed')}"
SQL_PLAIN_AUDIT = f"""{SQL_RUN}, src AS (
  SELECT item_id, text_risk AS text_score, score, CASE WHEN hit_kind IS NULL THEN 'done' ELSE 'hit' END AS path FROM plain),
{_audit_sql('plain')}"""

SQL_SCREEN = f"""WITH {SQL_RUN}
SELECT item_id, 'done' AS terminal_state, md5, phash, hit_kind, status, text_risk,
       {', '.join(f'5e-1 AS {k}' for k in LAYERS[1:])}, score, 'fusion-decision' AS reason, action
FROM plain"""


@query("screen", SQL_SCREEN)
def screen_query(spark, sf_dir):
    return flat(plain_run(spark, sf_dir))


# The distinct words of the benchmark passages as a wordlist table of thousands of entries.
_LISTED = """listed(entry_no, word, category, severity, match) AS (
  SELECT 0, word, 'benchmark', CASE length(word) % 3 WHEN 0 THEN '原则性错误' WHEN 1 THEN '一般错误' ELSE '提示' END, NULL
  FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM benchmark) WHERE length(word) > 2)"""
SQL_SCREEN_TABLE = SQL_SCREEN.replace(sql_entries(), _LISTED)


def wordlist_table(spark, sf_dir):
    words = F.explode(F.split(F.lower("text"), "[^a-z]+"))
    named = table(spark, sf_dir, "benchmark").select(words.alias("word")).where(F.char_length("word") > 2).distinct()
    kind = F.char_length("word") % 3
    return named.select(
        F.lit(0).alias("entry_no"),
        "word",
        F.lit("benchmark").alias("category"),
        F.when(kind == 0, "原则性错误").when(kind == 1, "一般错误").otherwise("提示").alias("severity"),
        F.lit(None).cast("string").alias("match"),
    )


@query("screen_wordlist", SQL_SCREEN_TABLE)
def screen_wordlist_query(spark, sf_dir):
    return flat(screen(items(spark, sf_dir), blocklist(spark, sf_dir), wordlist=wordlist_table(spark, sf_dir)))


@query(
    "review_queue",
    f"""WITH {SQL_MIXED} SELECT item_id, score, reason, terminal_state FROM acted WHERE action = 'REVIEW'""",
)
def review_queue_query(spark, sf_dir):
    return review_queue(mixed_run(spark, sf_dir))


_TOP = {"text_risk": f"{FUSION_WEIGHTS['text_risk']!r}::DOUBLE * text_risk", "vision": f"{FUSION_WEIGHTS['vision']!r}::DOUBLE * 5e-1"}


@query(
    "abnormal_report",
    f"""WITH {SQL_RUN} SELECT item_id, action, score,
  CASE WHEN hit_kind IS NOT NULL THEN 'blocklist-' || hit_kind
       WHEN {_TOP['text_risk']} >= {_TOP['vision']} THEN 'text_risk' ELSE 'vision' END AS cause,
  CASE WHEN hit_kind IS NULL THEN greatest({_TOP['text_risk']}, {_TOP['vision']}) END AS contribution
FROM plain WHERE action <> 'PASS'""",
)
def abnormal_report_query(spark, sf_dir):
    return abnormal_report(plain_run(spark, sf_dir))


@query("audit_events", f"WITH {SQL_MIXED_AUDIT} SELECT item_id, seq, agent, score, reason FROM audit")
def audit_events_query(spark, sf_dir):
    return audit_events(mixed_run(spark, sf_dir))


@query(
    "audit_tuple",
    f"""WITH {SQL_MIXED_AUDIT} SELECT item_id, action, terminal_state, audit_rows
FROM acted JOIN (SELECT item_id, count(*) AS audit_rows FROM audit GROUP BY 1) USING (item_id)""",
)
def audit_tuple_query(spark, sf_dir):
    # Read twice, so stored first: the run itself happens once.
    result = written(mixed_run(spark, sf_dir), "result")
    return audit_tuple(result, audit_events(result))


@query(
    "audit_by_agent",
    f"""WITH {SQL_MIXED_AUDIT} SELECT agent, count(*) AS calls, round(avg(score) FILTER (score >= 0), 9) AS mean_score,
       count(*) FILTER (score = -1) AS errors FROM audit GROUP BY agent""",
)
def audit_by_agent_query(spark, sf_dir):
    by_agent = audit_by_agent(audit_events(mixed_run(spark, sf_dir)))
    return by_agent.withColumn("mean_score", F.round("mean_score", 9))


@query("audit_line_count", f"WITH {SQL_MIXED_AUDIT} SELECT item_id, count(*) AS n FROM audit GROUP BY item_id")
def audit_line_count_query(spark, sf_dir):
    return audit_line_count(audit_events(mixed_run(spark, sf_dir)))


def written_audit(spark, sf_dir):
    path = scratch_path(spark, "audit")
    write_audit(audit_events(plain_run(spark, sf_dir)), path)
    return path


@query("write_audit", f"WITH {SQL_PLAIN_AUDIT} SELECT count(*) AS n FROM audit")
def write_audit_query(spark, sf_dir):
    return file_line_count(spark, written_audit(spark, sf_dir)).agg(F.sum("n").alias("n"))


@query("append_audit", f"WITH {SQL_MIXED_AUDIT} SELECT item_id, agent, score, reason FROM audit")
def append_audit_query(spark, sf_dir):
    """Two commits, of blocked and of other items, read back from what they name."""
    path = scratch_path(spark, "audit")
    result = written(mixed_run(spark, sf_dir), "result")
    for part in (result.where("hit_kind IS NULL"), result.where("hit_kind IS NOT NULL")):
        append_audit(audit_events(part), path)
    return read_committed_audit(spark, path).select("item_id", "agent", "score", "reason")


@query(
    "read_audit",
    f"""WITH {SQL_PLAIN_AUDIT} SELECT item_id, agent, score, reason, 'INFO' AS level, 'AGENT_RUN' AS phase,
       'agent.audit' AS message FROM audit""",
)
def read_audit_query(spark, sf_dir):
    lines = read_audit(spark, written_audit(spark, sf_dir))
    return lines.select("item_id", "agent", "score", "reason", "level", "phase", "message")


def picky(text: pd.Series) -> pd.Series:
    """A model that cannot take some texts."""
    if text.str.lower().str.contains("free", regex=False).any():
        raise ValueError("free text")
    return text.str.len().clip(upper=1000) / 1000


@query(
    "failed_items",
    f"""WITH {SQL_BLOCKLIST}, t AS (SELECT CAST(doc_id AS VARCHAR) AS item_id, contains(lower(text), 'free') AS bad,
  contains(text, '@') AS odd FROM documents),
f AS (SELECT * FROM looked JOIN t USING (item_id) WHERE hit_kind IS NULL)
SELECT item_id, CASE WHEN bad THEN 'picky threw: free text' ELSE 'address threw: holds an address' END AS terminal_reason,
       bad AS text_failed, CASE WHEN odd THEN -1e0 ELSE 25e-2 END AS ad_score,
       CASE WHEN odd THEN 'error: holds an address' ELSE 'address' END AS ad_reason
FROM f WHERE bad OR odd""",
)
def failed_items_query(spark, sf_dir):
    slots = {"text_risk": python_scorer("picky", picky, ["ocr_text"], "length"), "ad": ADDRESS_SCORER}
    failed = failed_items(screen(items(spark, sf_dir), blocklist(spark, sf_dir), slots))
    return failed.select(
        "item_id",
        "terminal_reason",
        (F.col("text_risk.score") == -1).alias("text_failed"),
        F.col("ad.score").alias("ad_score"),
        F.col("ad.reason").alias("ad_reason"),
    )


@query(
    "cancelled_items",
    f"""WITH {SQL_MIXED} SELECT item_id, 'labelled' AS terminal_reason, text_score AS text_risk, score, reason, action
FROM acted WHERE path = 'cancelled'""",
)
def cancelled_items_query(spark, sf_dir):
    return cancelled_items(mixed_run(spark, sf_dir)).select(
        "item_id", "terminal_reason", F.col("text_risk.score").alias("text_risk"), "score", "reason", "action"
    )


def _path_rows():
    early = ["init", "preprocess", "parallel-fan-out"]
    walks = {
        "hit": (["init", "preprocess", "fusion", "done"], "done"),
        "failed": ([*early, "failed"], "failed"),
        "cancelled": ([*early, "cancelled"], "cancelled"),
        "done": ([*early, "fan-in", "fusion", "done"], "done"),
    }
    rows = []
    for path, (states, end) in walks.items():
        seq = 0
        for no, state in enumerate(states):
            rows.append((path, seq, state, "enter"))
            seq += 1
            if no + 1 < len(states):
                rows.append((path, seq, state, "leave"))
                seq += 1
        rows.append((path, seq, end, "end"))
    return ", ".join(f"('{p}', {s}, '{st}', '{ph}')" for p, s, st, ph in rows)


@query(
    "state_events",
    f"""WITH {SQL_MIXED}, walk(path, seq, state, phase) AS (VALUES {_path_rows()})
SELECT item_id, seq, CASE WHEN phase = 'end' THEN 'pipeline.' || state ELSE 'pipeline.' || state || '.' || phase END AS type,
       state, phase, CASE WHEN phase = 'end' AND path = 'failed' THEN 'address threw: holds an address'
                          WHEN phase = 'end' AND path = 'cancelled' THEN 'labelled' END AS reason
FROM acted JOIN walk USING (path)""",
)
def state_events_query(spark, sf_dir):
    return state_events(mixed_run(spark, sf_dir))


def done_items(spark, sf_dir):
    """Labelled documents as already screened; for some the bytes have changed since."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    changed = F.col("quality") == 0
    return docs.join(labels, "doc_id").select(item_key(), F.when(changed, "stale").otherwise(F.col("md5")).alias("md5"))


def resume_slots():
    return {**PLAIN_SLOTS, "ad": python_scorer("half", lambda target: pd.Series([0.5] * len(target)), ["target"], "stub-ad")}


def stopped_run(spark, sf_dir):
    """A run that stopped: of labelled documents the toxic ones lack their text layer, those of low
    quality their ad layer, and both together all stages; the others were not begun."""
    whole = screen(items(spark, sf_dir), blocklist(spark, sf_dir), resume_slots())
    marks = table(spark, sf_dir, "labels").groupBy(item_key()).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    marked = whole.join(marks, "item_id")
    toxic, low = F.col("toxic") == 1, F.col("quality") == 0
    stages = [c for c in whole.columns if c not in ("item_id", "text_risk", "ad")]
    kept = {c: F.when(~(toxic & low), F.col(c)) for c in stages}
    kept |= {"text_risk": F.when(~toxic, F.col("text_risk")), "ad": F.when(~low, F.col("ad"))}
    return written(marked.withColumns(kept).drop("toxic", "quality"), "stopped-run")


@query("resume_screen", SQL_SCREEN)
def resume_screen_query(spark, sf_dir):
    return flat(resume_screen(items(spark, sf_dir), stopped_run(spark, sf_dir), blocklist(spark, sf_dir), resume_slots()))


@query(
    "rescreen",
    f"""WITH {SQL_RUN}, finished AS (SELECT CAST(doc_id AS VARCHAR) AS item_id FROM labels WHERE quality <> 0)
SELECT item_id, score, action FROM plain WHERE item_id NOT IN (SELECT item_id FROM finished)""",
)
def rescreen_query(spark, sf_dir):
    fresh = rescreen(items(spark, sf_dir), done_items(spark, sf_dir), blocklist(spark, sf_dir), slots=PLAIN_SLOTS)
    return fresh.select("item_id", "score", "action")

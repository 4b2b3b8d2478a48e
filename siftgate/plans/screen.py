"""The screening run as one job, and the tables that follow from its result."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgate.constants import DEFAULT_SCORE, FUSION_ID, LAYERS, PREPROCESS_ID
from siftgate.functions.clamp import clamp_unit
from siftgate.functions.text import match_text
from siftgate.operators.blocklist import blocklist_lookup
from siftgate.operators.fusion import (
    DEFAULT_FUSION,
    FusionConfig,
    contributions,
    fuse_fast_path,
    fusion_score,
    placeholder,
    score_to_action,
)
from siftgate.operators.matching import MATCHED, WordlistIndex, matched_per_key
from siftgate.operators.scorers import (
    PARTS,
    Scorer,
    default_slots,
    matched_elsewhere,
    pack_layers,
    score_layers,
    wordlist_outcome,
    wordlist_scorer,
)
from siftgate.operators.search import row_key
from siftgate.plans.joins import is_small, lookup_join
from siftgate.plans.preprocess import preprocess_status, with_facts
from siftgate.plans.scratch import written

RESULT = (
    "item_id", "terminal_state", "terminal_reason", "md5", "phash", "hit_hash", "hit_kind",
    "status", "preprocess_score", "format", "width", "height", *LAYERS, "score", "reason", "action",
)


def _mask_skipped(layer: str) -> list[str]:
    """The outcome columns of a layer with those of blocked items set to the placeholder."""
    return [
        f"IF(hit_kind IS NULL, {layer}_score, {DEFAULT_SCORE}D) AS {layer}_score",
        f"IF(hit_kind IS NULL, {layer}_reason, 'skipped-blocklist') AS {layer}_reason",
        f"IF(hit_kind IS NULL, {layer}_error, NULL) AS {layer}_error",
        f"IF(hit_kind IS NULL, {layer}_details, NULL) AS {layer}_details",
    ]


def screen(
    items: DataFrame,
    blocklist: DataFrame,
    slots: Mapping[str, Scorer] | None = None,
    config: FusionConfig = DEFAULT_FUSION,
    cancel_requests: DataFrame | None = None,
    blocklist_fits: bool | None = None,
    wordlist: DataFrame | WordlistIndex | None = None,
) -> DataFrame:
    """Fingerprint, blocklist, seven layer scores, fusion: one row per item (RESULT).

    A single pass over the items. With a blocklist within the broadcast bound nothing is
    shuffled and scorers skip blocked items. With a larger one all layers are scored
    first, bytes and text are dropped, and only hashes and scores move.
    cancel_requests (item_id, reason): items stopped before fusion.
    blocklist_fits: the answer to the size check when the caller has it already.
    wordlist (entry_no, word, category, severity, match): the text layer's list, in place of its
    slot. Within the bounds of a search table the workers hold it and the items still do
    not move. A larger one is searched in a job of its own; its matches come back per
    item key after bytes and text are dropped.
    """
    index = WordlistIndex.of(wordlist) if isinstance(wordlist, DataFrame) else wordlist
    far = wordlist is not None and index is None
    if wordlist is not None:
        slots = {**(slots or {}), "text_risk": matched_elsewhere() if far else wordlist_scorer(index)}
    slots = default_slots(**(slots or {}))
    facts = with_facts(items)
    slim = ["item_id", "md5", "phash", "header"]
    outcomes = [f"{layer}_{part}" for layer in LAYERS for part in PARTS]
    if far:
        facts = facts.withColumn("__key", row_key("item_id", "ocr_text"))
        slim.append("__key")
    found = ["hit_hash", "hit_kind"]
    hit = F.col("hit_kind").isNotNull()
    fits = is_small(blocklist) if blocklist_fits is None else blocklist_fits
    if fits:
        looked = blocklist_lookup(facts, blocklist, fits=True)
        scored = score_layers(looked, slots, unless=hit)
    else:
        layers = score_layers(facts, slots).select(*slim, *outcomes)
        scored = blocklist_lookup(layers, blocklist, fits=False)
    if far:
        text = F.coalesce("ocr_text", F.lit(""))
        texts = items.select(row_key("item_id", "ocr_text").alias("__key"), match_text(text).alias("__t"))
        scored = lookup_join(scored.select(*slim, *found, *outcomes), matched_per_key(texts, wordlist, False), ["__key"], "left", ["item_id"])
        texted = wordlist_outcome({"matched": F.coalesce("matched", F.array().cast(MATCHED))})
        scored = scored.withColumns({f"text_risk_{part}": texted[part] for part in PARTS})
    scored = scored.selectExpr(*slim, *found, *[c for layer in LAYERS for c in _mask_skipped(layer)])
    facts = preprocess_status(F.col("hit_kind"), F.col("header"))
    return _fused(scored, slots, config, cancel_requests, facts)


def _fused(
    scored: DataFrame, slots: Mapping[str, Scorer], config: FusionConfig, cancel_requests: DataFrame | None, facts: list[Column]
) -> DataFrame:
    """RESULT of rows with all outcomes. facts: the columns of preprocess_status."""
    hit = F.col("hit_kind").isNotNull()
    if cancel_requests is None:
        scored = scored.withColumn("__cancel", F.lit(None).cast("string")).withColumn("__stop", F.lit(False))
    else:
        asked = cancel_requests.groupBy("item_id").agg(
            F.min("reason").alias("__cancel"), F.lit(True).alias("__stop")
        )
        scored = lookup_join(scored, asked, ["item_id"], "left", ["item_id"])

    def threw(layer: str) -> Column:
        return F.concat(F.lit(f"{slots[layer].id} threw: "), F.col(f"{layer}_error"))

    failure = F.coalesce(*[threw(layer) for layer in LAYERS])
    failed = ~hit & failure.isNotNull()
    stopped = ~hit & ~failed & F.coalesce("__stop", F.lit(False))
    fast_score, fast_action = fuse_fast_path(config)
    score = fusion_score({layer: clamp_unit(F.col(f"{layer}_score")) for layer in LAYERS}, config)
    held = placeholder("cancelled-before-fusion")
    fused = scored.select(
        "*",
        F.when(failed, "failed").when(stopped, "cancelled").otherwise("done").alias("terminal_state"),
        F.when(failed, failure).when(stopped, F.col("__cancel")).alias("terminal_reason"),
        *facts,
        F.when(hit, fast_score).when(stopped, held["score"]).when(~failed, score).alias("score"),
        F.when(stopped, held["reason"]).when(~failed, "fusion-decision").alias("reason"),
    )
    action = (
        F.when(hit, fast_action)
        .when(F.col("terminal_state") == "cancelled", held["action"])
        .when(F.col("terminal_state") == "done", score_to_action(F.col("score"), config))
    )
    names = [c for c in RESULT if c not in LAYERS]
    result = fused.withColumn("action", action).select(*names, *pack_layers(slots)).select(*RESULT)
    # Counts of the run. Observing them also keeps a filter on the result above the
    # computation: pushed below, it would repeat every expression it depends on.
    return result.observe(
        f"screened-{uuid.uuid4().hex}",
        F.count(F.lit(1)).alias("items"),
        F.count("hit_kind").alias("blocked"),
    )


def rescreen(items: DataFrame, done: DataFrame, blocklist: DataFrame, **options) -> DataFrame:
    """Screen what `done` (item_id, md5) does not hold yet; changed bytes count as new.

    The comparison moves ids and hashes only. The open ids are written once; few of them
    are broadcast back to the item scan, many are joined.
    """
    keys = items.select("item_id", F.md5(F.coalesce("content", F.lit(b""))).alias("md5"))
    open_ids = written(
        keys.join(done.select("item_id", "md5"), ["item_id", "md5"], "left_anti").select("item_id"),
        "open-items",
    )
    if is_small(open_ids):
        open_ids = F.broadcast(open_ids)
    return screen(items.join(open_ids, "item_id", "left_semi"), blocklist, **options)


def resume_screen(
    items: DataFrame,
    stored: DataFrame,
    blocklist: DataFrame,
    slots: Mapping[str, Scorer] | None = None,
    config: FusionConfig = DEFAULT_FUSION,
    cancel_requests: DataFrame | None = None,
) -> DataFrame:
    """The result of a full `screen`, computing only the stages that `stored` lacks.

    stored: rows of RESULT from a run that stopped, at most one per item id, in which a null
    md5 stands for a preprocess stage and a null layer for a layer that is missing. A
    layer stored by another scorer, or with an error, counts as missing. Fusion is done
    anew. Bytes and text are read of the open items only; scorers get only the rows that
    lack their layer, and fingerprints only those without. Items unchanged since is the
    caller's promise: `rescreen` compares hashes.
    """
    slots = default_slots(**(slots or {}))
    kept = [c for c in RESULT if c not in ("item_id", "terminal_state", "terminal_reason", "score", "reason", "action")]
    known = stored.select("item_id", *kept)
    there = {layer: F.col(layer).isNotNull() & F.col(f"{layer}.error").isNull() & (F.col(f"{layer}.agent") == slots[layer].id) for layer in LAYERS}
    blocked = F.col("md5").isNotNull() & F.col("hit_kind").isNotNull()
    whole = F.col("md5").isNotNull()
    for layer in LAYERS:
        whole = whole & there[layer]
    whole = F.coalesce(blocked | whole, F.lit(False))
    ids = items.select("item_id")
    finished = known.where(whole)
    open_ids = written(ids.join(finished.select("item_id"), "item_id", "left_anti").distinct(), "open-items")
    if is_small(open_ids):
        open_ids = F.broadcast(open_ids)
    partial = known.where(~whole & F.col("item_id").isNotNull())
    renamed = partial.select("item_id", F.struct(*kept).alias("__stored"))
    open_items = lookup_join(items.join(open_ids, "item_id", "left_semi"), renamed, ["item_id"], "left", ["item_id"])
    # Rows without an id match nothing stored.
    nobody = items.where("item_id IS NULL").withColumn("__stored", F.lit(None).cast(renamed.schema["__stored"].dataType))
    open_items = open_items.unionByName(nobody)

    had = F.col("__stored.md5").isNotNull()
    facts = with_facts(open_items.withColumn("__content", F.col("content")).withColumn("content", F.when(~had, F.col("content"))))
    facts = facts.withColumn("content", F.col("__content")).drop("__content")
    facts = facts.withColumns({c: F.when(had, F.col(f"__stored.{c}")).otherwise(F.col(c)) for c in ("md5", "phash")})
    looked = blocklist_lookup(facts, blocklist)
    looked = looked.withColumns({c: F.when(had, F.col(f"__stored.{c}")).otherwise(F.col(c)) for c in ("hit_hash", "hit_kind")})
    hit = F.col("hit_kind").isNotNull()
    have = {
        layer: F.coalesce(F.col(f"__stored.{layer}.error").isNull() & (F.col(f"__stored.{layer}.agent") == slots[layer].id), F.lit(False))
        for layer in LAYERS
    }
    scored = score_layers(looked, slots, {layer: hit | have[layer] for layer in LAYERS})
    merged = {
        f"{layer}_{part}": F.when(have[layer], F.col(f"__stored.{layer}.{part}")).otherwise(F.col(f"{layer}_{part}"))
        for layer in LAYERS
        for part in PARTS
    }
    scored = scored.withColumns(merged)
    slim = ["item_id", "md5", "phash", "header", "__stored", "hit_hash", "hit_kind"]
    scored = scored.selectExpr(*slim, *[c for layer in LAYERS for c in _mask_skipped(layer)])
    names = ("status", "preprocess_score", "format", "width", "height")
    computed = preprocess_status(F.col("hit_kind"), F.col("header"))
    facts = [F.when(had, F.col(f"__stored.{name}")).otherwise(c).alias(name) for name, c in zip(names, computed)]
    fresh = _fused(scored, slots, config, cancel_requests, facts)

    outcomes = [F.col(f"{layer}.{part}").alias(f"{layer}_{part}") for layer in LAYERS for part in PARTS]
    ready = finished.join(ids.distinct(), "item_id", "left_semi").select("item_id", *[c for c in kept if c not in LAYERS], *outcomes)
    ready = ready.selectExpr(*[c for c in ready.columns if c not in merged], *[c for layer in LAYERS for c in _mask_skipped(layer)])
    return fresh.unionByName(_fused(ready, slots, config, cancel_requests, [F.col(name) for name in names]))


def layer_scores(result: DataFrame, *more: str) -> DataFrame:
    """(item_id, action, score, hit_kind, seven layer doubles) as they entered fusion."""
    hit = F.col("hit_kind").isNotNull()
    return result.select(
        "item_id", "action", "score", "hit_kind", *more,
        *[F.when(hit, F.lit(1.0)).otherwise(clamp_unit(F.col(k)["score"])).alias(k) for k in LAYERS],
    )


def audit_events(result: DataFrame) -> DataFrame:
    """One row per call: preprocess, each layer, fusion. (item_id, seq, agent, score, reason)

    9 rows for a finished item, 2 for a blocklisted one, 8 when it failed or was
    cancelled before fusion.
    """
    ran = F.col("hit_kind").isNull()
    calls = [
        (F.lit(PREPROCESS_ID), F.col("preprocess_score"), F.col("status"), F.lit(True)),
        *[(F.col(k)["agent"], F.col(k)["score"], F.col(k)["reason"], ran) for k in LAYERS],
        (F.lit(FUSION_ID), F.col("score"), F.col("reason"), F.col("terminal_state") == "done"),
    ]
    rows = [
        F.struct(
            F.lit(seq).alias("seq"),
            agent.alias("agent"),
            score.alias("score"),
            reason.alias("reason"),
            happened.alias("happened"),
        )
        for seq, (agent, score, reason, happened) in enumerate(calls)
    ]
    return result.select("item_id", F.inline(F.array(*rows))).where("happened").drop("happened")


def audit_tuple(result: DataFrame, audit: DataFrame) -> DataFrame:
    """Action, end state and number of audit rows per item."""
    lines = audit.groupBy("item_id").agg(F.count(F.lit(1)).alias("audit_rows"))
    return result.select("item_id", "action", "terminal_state").join(lines, "item_id")


def audit_by_agent(audit: DataFrame) -> DataFrame:
    """Calls, mean score of the calls that worked, and failed calls (score -1) per agent."""
    return audit.groupBy("agent").agg(
        F.count(F.lit(1)).alias("calls"),
        F.avg(F.when(F.col("score") >= 0, F.col("score"))).alias("mean_score"),
        F.count_if(F.col("score") == -1.0).alias("errors"),
    )


def failed_items(result: DataFrame) -> DataFrame:
    return result.where(F.col("terminal_state") == "failed")


def cancelled_items(result: DataFrame) -> DataFrame:
    return result.where(F.col("terminal_state") == "cancelled")


def _walk(*states: str) -> list[tuple[str, str]]:
    """Enter and leave events along states; the last state is entered only."""
    steps = [(states[0], "enter")]
    for left, entered in zip(states, states[1:]):
        steps += [(left, "leave"), (entered, "enter")]
    return steps


def state_events(result: DataFrame) -> DataFrame:
    """Enter, leave and end events of every run: (item_id, seq, type, state, phase, reason)."""
    early = ("init", "preprocess", "parallel-fan-out")
    paths = {
        "hit": _walk("init", "preprocess", "fusion", "done"),
        "failed": _walk(*early, "failed"),
        "cancelled": _walk(*early, "cancelled"),
        "done": _walk(*early, "fan-in", "fusion", "done"),
    }

    def events(name: str) -> Column:
        end = "done" if name == "hit" else name
        return F.array(
            *[
                F.struct(
                    F.lit(seq).alias("seq"),
                    F.lit(f"pipeline.{state}.{phase}" if phase != "end" else f"pipeline.{state}").alias("type"),
                    F.lit(state).alias("state"),
                    F.lit(phase).alias("phase"),
                )
                for seq, (state, phase) in enumerate([*paths[name], (end, "end")])
            ]
        )

    path = (
        F.when(F.col("hit_kind").isNotNull(), events("hit"))
        .when(F.col("terminal_state") == "failed", events("failed"))
        .when(F.col("terminal_state") == "cancelled", events("cancelled"))
        .otherwise(events("done"))
    )
    return result.select("item_id", "terminal_reason", F.inline(path)).select(
        "item_id", "seq", "type", "state", "phase",
        F.when(F.col("phase") == "end", F.col("terminal_reason")).alias("reason"),
    )


def review_queue(result: DataFrame) -> DataFrame:
    """Items a person has to look at. Failed items have no action; abnormal_report lists them."""
    return result.where(F.col("action") == "REVIEW").select("item_id", "score", "reason", "terminal_state")


def write_review_queue(result: DataFrame, path: str) -> None:
    """The review queue as JSON lines."""
    review_queue(result).write.mode("append").json(path)


def abnormal_report(result: DataFrame, config: FusionConfig = DEFAULT_FUSION) -> DataFrame:
    """Items that did not pass, with the layer that contributed most, or the blocklist; failed
    items (no action, no score) with what they failed of."""
    top = F.get(contributions(config), F.lit(0))
    failed = F.col("terminal_state") == "failed"
    flagged = layer_scores(result, "terminal_state", "terminal_reason").where(failed | (F.col("action") != "PASS")).withColumn("__top", top)
    hit = F.col("hit_kind").isNotNull()
    return flagged.select(
        "item_id",
        "action",
        "score",
        F.when(hit, F.concat(F.lit("blocklist-"), F.col("hit_kind")))
        .when(failed, F.col("terminal_reason"))
        .otherwise(F.col("__top.layer"))
        .alias("cause"),
        F.when(~hit & ~failed, F.col("__top.contribution")).alias("contribution"),
    )

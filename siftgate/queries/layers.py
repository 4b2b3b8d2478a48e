"""Layer inputs, scorers, clamps and fusion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from siftgate.constants import FUSION_WEIGHTS, LAYERS
from siftgate.operators.fusion import (
    action_counts,
    configure_fusion,
    fuse,
    fuse_fast_path,
    fuse_long,
    fusion_input,
    layer_contribution,
    layer_vector,
    placeholder,
    score_to_action,
)
from siftgate.functions.clamp import clamp01, clamp_unit
from siftgate.operators.blocklist import blocklist_blocked
from siftgate.operators.scorers import (
    ScorerRegistry,
    batch_scorer,
    constant_scorer,
    default_slots,
    layer_inputs,
    native_scorer,
    pack_layers,
    python_scorer,
    score_layers,
)
from siftgate.queries.base import (
    SQL_BLOCKLIST,
    SQL_DOCS,
    blocklist,
    items,
    query,
    sql_clamp01,
    sql_clamp_unit,
    table,
)
from siftgate.queries.bytes_ import prints
from siftgate.sources.items import items_from
from siftgate.sources.tables import spread

# Line items as layer scores, with every kind of odd number among them. Both engines
# read these expressions.
RAW_LAYERS = {
    "text_risk": "l_discount * 10e0",
    "vision": "l_quantity / 50e0",
    "metadata": "l_tax * 10e0",
    "porn": "CASE WHEN l_linenumber = 7 THEN CAST('NaN' AS DOUBLE) ELSE l_discount * 5e0 END",
    "ad": "(l_extendedprice - 20000e0) / 50000e0",
    "political": "CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_tax * 12e0 END",
    "logo": """CASE WHEN l_linenumber = 6 THEN CAST('Infinity' AS DOUBLE)
      WHEN l_linenumber = 5 THEN CAST('-Infinity' AS DOUBLE) ELSE 3e-1 END""",
}
_ID = "CONCAT_WS('-', CAST(l_orderkey AS {0}), CAST(l_linenumber AS {0}), CAST(l_partkey AS {0}), CAST(l_suppkey AS {0}))"
SQL_RAW = (
    f"raw AS (SELECT {_ID.format('VARCHAR')} AS item_id, "
    + ", ".join(f"{e} AS {k}" for k, e in RAW_LAYERS.items())
    + " FROM lineitem)"
)


def raw_layers(spark, sf_dir):
    columns = [f"{e} AS {k}" for k, e in RAW_LAYERS.items()]
    lines = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    return lines.selectExpr(f"{_ID.format('STRING')} AS item_id", *columns)


def _weighted(weights, value):
    return " + ".join(f"{weights[k]!r}::DOUBLE * {value(k)}" for k in LAYERS)


def sql_action(score, reject_at=0.85, review_at=0.40):
    return f"CASE WHEN {score} >= {reject_at!r}::DOUBLE THEN 'REJECT' WHEN {score} >= {review_at!r}::DOUBLE THEN 'REVIEW' ELSE 'PASS' END"


def sql_fused(weights=FUSION_WEIGHTS, clamp=sql_clamp01):
    return f"""{SQL_RAW},
vec AS (SELECT item_id, {', '.join(f'{clamp(k)} AS {k}' for k in LAYERS)} FROM raw),
summed AS (SELECT *, {_weighted(weights, str)} AS s FROM vec),
fused AS (SELECT *, CASE WHEN s > 1 THEN 1e0 WHEN s < 0 THEN 0e0 ELSE s END AS score FROM summed)"""


_COLUMNS = ", ".join(LAYERS)


@query("clamp_unit", f"WITH {SQL_RAW} SELECT item_id, {', '.join(f'{sql_clamp_unit(k)} AS {k}' for k in LAYERS)} FROM raw")
def clamp_unit_query(spark, sf_dir):
    return raw_layers(spark, sf_dir).withColumns({k: clamp_unit(F.col(k)) for k in LAYERS})


@query("clamp01", f"WITH {SQL_RAW} SELECT item_id, {', '.join(f'{sql_clamp01(k)} AS {k}' for k in LAYERS)} FROM raw")
def clamp01_query(spark, sf_dir):
    return raw_layers(spark, sf_dir).withColumns({k: clamp01(F.col(k)) for k in LAYERS})


# Text is no number, even where it spells one, and one layer is missing.
@query(
    "layer_vector",
    f"""WITH {SQL_RAW}, typed AS (
  SELECT item_id, 0e0 AS porn, text_risk, vision, metadata, ad, political FROM raw)
SELECT item_id, {', '.join(f'{sql_clamp01(k)} AS {k}' for k in LAYERS if k != 'logo')}, 0e0 AS logo FROM typed""",
)
def layer_vector_query(spark, sf_dir):
    text = F.when(F.isnan("porn"), "n/a").otherwise(F.col("porn").cast("string"))
    return layer_vector(raw_layers(spark, sf_dir).drop("logo").withColumn("porn", text))


@query("fusion_input", f"WITH {SQL_RAW} SELECT item_id, {', '.join(f'{sql_clamp_unit(k)} AS {k}' for k in LAYERS)} FROM raw")
def fusion_input_query(spark, sf_dir):
    return fusion_input(raw_layers(spark, sf_dir))


@query("fuse", f"WITH {sql_fused()} SELECT item_id, score, {sql_action('score')} AS action FROM fused")
def fuse_query(spark, sf_dir):
    return fuse(raw_layers(spark, sf_dir)).select("item_id", "score", "action")


@query(
    "score_to_action",
    f"WITH {SQL_RAW} SELECT item_id, vision, {sql_action('vision')} AS action FROM raw",
)
def score_to_action_query(spark, sf_dir):
    return raw_layers(spark, sf_dir).select("item_id", "vision", score_to_action(F.col("vision")).alias("action"))


CUSTOM = configure_fusion(weights={"text_risk": 1.0, "logo": 0.0}, review_at=0.5)


@query(
    "fuse_custom",
    f"WITH {sql_fused(CUSTOM.weights)} SELECT item_id, score, {sql_action('score', 0.85, 0.5)} AS action FROM fused",
)
def fuse_custom_query(spark, sf_dir):
    return fuse(raw_layers(spark, sf_dir), CUSTOM).select("item_id", "score", "action")


@query(
    "fuse_fast_path",
    f"WITH {SQL_BLOCKLIST} SELECT item_id, 1e0 AS score, 'REJECT' AS action FROM looked WHERE hit_kind IS NOT NULL",
)
def fuse_fast_path_query(spark, sf_dir):
    score, action = fuse_fast_path()
    blocked = blocklist_blocked(prints(spark, sf_dir), blocklist(spark, sf_dir))
    return blocked.select("item_id", score.alias("score"), action.alias("action"))


@query(
    "placeholder_layers",
    f"""WITH {SQL_BLOCKLIST} SELECT item_id, layer, 5e-1 AS score, 'skipped-blocklist' AS reason, 'REVIEW' AS action
FROM looked, (VALUES {', '.join(f"('{k}')" for k in LAYERS)}) AS l(layer) WHERE hit_kind IS NOT NULL""",
)
def placeholder_layers_query(spark, sf_dir):
    blocked = blocklist_blocked(prints(spark, sf_dir), blocklist(spark, sf_dir))
    layer = F.explode(F.array(*[F.lit(k) for k in LAYERS])).alias("layer")
    held = blocked.select("item_id", layer).withColumn("out", placeholder("skipped-blocklist"))
    return held.select("item_id", "layer", "out.score", "out.reason", "out.action")


@query(
    "fuse_long",
    f"""WITH {SQL_RAW}, long AS (
  {' UNION ALL '.join(f"SELECT item_id, '{k}' AS layer, {FUSION_WEIGHTS[k]!r}::DOUBLE AS w, {k} AS x FROM raw" for k in LAYERS)}),
total AS (SELECT item_id, round(sum(w * {sql_clamp01('x')}), 9) AS s FROM long GROUP BY item_id),
fused AS (SELECT item_id, CASE WHEN s > 1 THEN 1e0 ELSE s END AS score FROM total)
SELECT item_id, score, {sql_action('score')} AS action FROM fused""",
)
def fuse_long_query(spark, sf_dir):
    scores = raw_layers(spark, sf_dir).unpivot("item_id", list(LAYERS), "layer", "score")
    return fuse_long(scores)


@query(
    "layer_contribution",
    f"""WITH {sql_fused()}, part_of AS (
  {' UNION ALL '.join(f"SELECT item_id, score, {no} AS ord, '{k}' AS layer, {FUSION_WEIGHTS[k]!r}::DOUBLE * {k} AS contribution FROM fused" for no, k in enumerate(LAYERS))}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, score ORDER BY contribution DESC, ord) AS r FROM part_of)
SELECT item_id, layer, contribution, CASE WHEN score > 0 THEN contribution / score ELSE 0e0 END AS share,
       CAST(r AS INTEGER) AS rank FROM ranked""",
)
def layer_contribution_query(spark, sf_dir):
    return layer_contribution(fuse(raw_layers(spark, sf_dir)))


@query(
    "action_counts",
    f"""WITH {sql_fused()}, acted AS (SELECT {sql_action('score')} AS action FROM fused)
SELECT action, count(*) AS n FROM acted GROUP BY action""",
)
def action_counts_query(spark, sf_dir):
    return action_counts(fuse(raw_layers(spark, sf_dir)))


# Conversations as items: every third turn lacks text, boxes and EXIF come and go.
_CONV = """conv AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS item_id,
         CASE WHEN turn % 3 <> 2 THEN text END AS ocr_text,
         CASE WHEN turn % 2 = 0 THEN role END AS box,
         CASE WHEN turn % 2 = 1 THEN 'Make,Model' ELSE '' END AS exif_keys
  FROM conversations)"""


def conversation_items(spark, sf_dir):
    turn = F.col("turn")
    return items_from(
        table(spark, sf_dir, "conversations"),
        F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string")),
        ocr_text=F.when(turn % 3 != 2, F.col("text")),
        bboxes=F.when(turn % 2 == 0, F.array("role")),
        exif=F.when(turn % 2 == 1, F.create_map(F.lit("Make"), F.lit("Canon"), F.lit("Model"), F.col("role"))),
    )


@query(
    "layer_inputs",
    f"""WITH {_CONV} SELECT item_id, coalesce(ocr_text, '') AS text_input, coalesce(box, '') AS boxes,
       ocr_text AS vision_text, CASE WHEN exif_keys = '' THEN NULL ELSE exif_keys END AS vision_exif,
       0 AS metadata_bytes, 'porn,ad,political,logo' AS targets FROM conv""",
)
def layer_inputs_query(spark, sf_dir):
    routed = layer_inputs(conversation_items(spark, sf_dir))
    return routed.select(
        "item_id",
        F.col("text_risk.ocr_text").alias("text_input"),
        F.array_join("text_risk.bboxes", ",").alias("boxes"),
        F.col("vision.ocr_text").alias("vision_text"),
        F.array_join(F.map_keys("vision.exif"), ",").alias("vision_exif"),
        F.octet_length("metadata.content").alias("metadata_bytes"),
        F.concat_ws(",", "porn.target", "ad.target", "political.target", "logo.target").alias("targets"),
    )


def scored(spark, sf_dir, **slots):
    chosen = default_slots(**slots)
    flat = score_layers(conversation_items(spark, sf_dir), chosen)
    return flat.select("item_id", *pack_layers(chosen))


@query(
    "score_constant",
    f"""WITH {_CONV} SELECT item_id, target, 5e-1 AS score, 'stub-' || target AS reason
FROM conv, (VALUES ('porn'), ('ad'), ('political'), ('logo')) AS t(target)""",
)
def score_constant_query(spark, sf_dir):
    legs = [F.col(k) for k in ("porn", "ad", "political", "logo")]
    rows = [F.struct(c["details"]["target"].alias("target"), c["score"].alias("score"), c["reason"].alias("reason")) for c in legs]
    return scored(spark, sf_dir).select("item_id", F.inline(F.array(*rows)))


@query("score_text_default", f"WITH {_CONV} SELECT item_id, 5e-1 AS score, 'stub-text-risk' AS reason, 0 AS n_matched FROM conv")
def score_text_default_query(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "item_id", "text_risk.score", "text_risk.reason", F.size("text_risk.details.matched_words").alias("n_matched")
    )


@query(
    "score_vision_default",
    f"""WITH {_CONV} SELECT item_id, 5e-1 AS score, 'stub-vision' AS reason, 5e-1 AS porn_score, 5e-1 AS violence_score,
       5e-1 AS ad_score, 5e-1 AS political_score, exif_keys FROM conv""",
)
def score_vision_default_query(spark, sf_dir):
    d = F.col("vision.details")
    axes = [d[f"{a}_score"].alias(f"{a}_score") for a in ("porn", "violence", "ad", "political")]
    return scored(spark, sf_dir).select(
        "item_id", "vision.score", "vision.reason", *axes, F.array_join(d["exif_keys"], ",").alias("exif_keys")
    )


@query(
    "score_metadata_default",
    f"""WITH {_CONV} SELECT item_id, 5e-1 AS score, 'stub-metadata' AS reason, false AS has_exif, false AS has_gps,
       false AS ai_gen_suspected FROM conv""",
)
def score_metadata_default_query(spark, sf_dir):
    flags = [F.col(f"metadata.details.{f}") for f in ("has_exif", "has_gps", "ai_gen_suspected")]
    return scored(spark, sf_dir).select("item_id", "metadata.score", "metadata.reason", *flags)


# A registry of two scorers, one replacing a default; layers without one keep theirs.
@query(
    "scorer_registry",
    f"""WITH {_CONV} SELECT item_id, least(1e0, length(coalesce(ocr_text, '')) / 1000e0) AS text_score,
       9e-1 AS logo_score, 5e-1 AS ad_score FROM conv""",
)
def scorer_registry_query(spark, sf_dir):
    registry = ScorerRegistry()
    registry.register(
        "text_risk",
        native_scorer("length", lambda i: F.least(F.lit(1.0), F.char_length(i["ocr_text"]) / 1000), "length"),
    )
    registry.register("logo", constant_scorer("logo", 0.9))
    out = scored(spark, sf_dir, **registry.slots())
    return out.select(
        "item_id",
        F.col("text_risk.score").alias("text_score"),
        F.col("logo.score").alias("logo_score"),
        F.col("ad.score").alias("ad_score"),
    )


@query(
    "scorer_slots",
    f"""WITH {_CONV} SELECT item_id, {', '.join(f'5e-1 AS {k}' for k in LAYERS)} FROM conv""",
)
def scorer_slots_query(spark, sf_dir):
    return scored(spark, sf_dir).select("item_id", *[F.col(f"{k}.score").alias(k) for k in LAYERS])


def digit_share(text: pd.Series) -> pd.Series:
    """Share of digits in a text, as a batch function stands in for a model."""
    return text.str.count("[0-9]") / text.str.len().clip(lower=1)


@query(
    "custom_scorer",
    f"""WITH {SQL_DOCS} SELECT item_id, length(regexp_replace(text, '[^0-9]', '', 'g')) / CAST(greatest(length(text), 1) AS DOUBLE) AS score,
       'digit-share' AS reason FROM docs""",
)
def custom_scorer_query(spark, sf_dir):
    slots = default_slots(text_risk=python_scorer("digits", digit_share, ["ocr_text"], "digit-share"))
    flat = score_layers(items(spark, sf_dir), slots)
    return flat.select("item_id", F.col("text_risk_score").alias("score"), F.col("text_risk_reason").alias("reason"))


@query(
    "batch_scorer",
    f"""WITH {SQL_DOCS} SELECT item_id, length(regexp_replace(text, '[^0-9]', '', 'g')) / CAST(greatest(length(text), 1) AS DOUBLE) AS score,
       'digit-share' AS reason FROM docs""",
)
def batch_scorer_query(spark, sf_dir):
    """As custom_scorer, with a model that each worker sets up once and that takes batches by bytes."""
    slots = default_slots(text_risk=batch_scorer("digits", lambda: digit_share, ["ocr_text"], "digit-share", batch_bytes=1_000_000))
    flat = score_layers(items(spark, sf_dir), slots)
    return flat.select("item_id", F.col("text_risk_score").alias("score"), F.col("text_risk_reason").alias("reason"))

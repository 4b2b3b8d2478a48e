"""Weighted fusion of layer scores into a risk score and an action."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from siftgate.constants import DEFAULT_SCORE, FUSION_WEIGHTS, LAYERS, REJECT_AT, REVIEW_AT
from siftgate.functions.clamp import clamp01, clamp_unit


@dataclass(frozen=True)
class FusionConfig:
    """Weights per layer and the two thresholds. Weights need not sum to 1."""

    weights: Mapping[str, float] = field(default_factory=lambda: MappingProxyType(dict(FUSION_WEIGHTS)))
    reject_at: float = REJECT_AT
    review_at: float = REVIEW_AT


DEFAULT_FUSION = FusionConfig()


def configure_fusion(
    weights: Mapping[str, float] | None = None,
    reject_at: float | None = None,
    review_at: float | None = None,
) -> FusionConfig:
    """The default configuration with some values replaced."""
    return FusionConfig(
        MappingProxyType({**FUSION_WEIGHTS, **(weights or {})}),
        REJECT_AT if reject_at is None else reject_at,
        REVIEW_AT if review_at is None else review_at,
    )


def score_to_action(score: Column, config: FusionConfig = DEFAULT_FUSION) -> Column:
    return (
        F.when(score >= config.reject_at, "REJECT")
        .when(score >= config.review_at, "REVIEW")
        .otherwise("PASS")
    )


def layer_vector(df: DataFrame) -> DataFrame:
    """The seven layer columns as clamped doubles; a missing value or one that is no number is 0.

    The column's type decides: text is no number, whatever it spells.
    """
    numbers = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    values = {layer: F.col(layer).cast("double") if layer in numbers else F.lit(0.0) for layer in LAYERS}
    return df.withColumns({layer: clamp01(value) for layer, value in values.items()})


def fusion_input(df: DataFrame) -> DataFrame:
    """Layer scores as they enter fusion: anything not finite counts as 0."""
    return df.withColumns({layer: clamp_unit(F.col(layer)) for layer in LAYERS})


def fusion_score(layers: Mapping[str, Column], config: FusionConfig = DEFAULT_FUSION) -> Column:
    """clamp01 of the weighted sum, added in the fixed layer order."""
    total = F.lit(0.0)
    for layer in LAYERS:
        total = total + F.lit(float(config.weights[layer])) * clamp01(layers[layer])
    return clamp01(total)


def fuse(df: DataFrame, config: FusionConfig = DEFAULT_FUSION) -> DataFrame:
    """Add score and action from the seven layer columns."""
    scored = df.withColumn("score", fusion_score({k: F.col(k) for k in LAYERS}, config))
    return scored.withColumn("action", score_to_action(F.col("score"), config))


def fuse_fast_path(config: FusionConfig = DEFAULT_FUSION) -> tuple[Column, Column]:
    """(score, action) of a blocklisted item: all layers at 1."""
    score = fusion_score({layer: F.lit(1.0) for layer in LAYERS}, config)
    return score, score_to_action(score, config)


def placeholder(reason: str | Column) -> Column:
    """Output that stands for a skipped step: 0.5, the reason, REVIEW."""
    return F.struct(
        F.lit(DEFAULT_SCORE).alias("score"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
        F.lit("REVIEW").alias("action"),
    )


def fuse_long(
    scores: DataFrame,
    weights: Mapping[str, float] = FUSION_WEIGHTS,
    item: str = "item_id",
    config: FusionConfig = DEFAULT_FUSION,
) -> DataFrame:
    """Fusion over a long table (item, layer, score) with any set of layers.

    The sum has no fixed order, so it is rounded to 9 digits before the thresholds.
    Layers without a weight are ignored, as in an inner join with the weights.
    """
    table = F.create_map(*[F.lit(x) for layer, w in weights.items() for x in (layer, float(w))])
    weight = F.element_at(table, F.col("layer"))
    total = scores.groupBy(item).agg(F.sum(weight * clamp01(F.col("score"))).alias("__s"))
    risk = clamp01(F.round(F.coalesce("__s", F.lit(0.0)), 9))
    return total.select(item, risk.alias("score")).withColumn("action", score_to_action(F.col("score"), config))


def contributions(config: FusionConfig = DEFAULT_FUSION) -> Column:
    """Layers of a row as array<struct<contribution,ord,layer>>, largest first; equal
    contributions keep the layer order."""
    parts = [
        F.struct(
            (F.lit(float(config.weights[layer])) * clamp01(F.col(layer))).alias("contribution"),
            F.lit(-no).alias("ord"),
            F.lit(layer).alias("layer"),
        )
        for no, layer in enumerate(LAYERS)
    ]
    return F.sort_array(F.array(*parts), asc=False)


def layer_contribution(df: DataFrame, config: FusionConfig = DEFAULT_FUSION, item: str = "item_id") -> DataFrame:
    """(item, layer, contribution, share, rank) per layer. Ranked inside the row: the
    layers of an item already sit together, so nothing is shuffled."""
    ranked = df.select(item, F.col("score").alias("__total"), F.posexplode(contributions(config)).alias("__pos", "c"))
    return ranked.select(
        item,
        "c.layer",
        "c.contribution",
        F.when(F.col("__total") > 0, F.col("c.contribution") / F.col("__total")).otherwise(F.lit(0.0)).alias("share"),
        (F.col("__pos") + 1).alias("rank"),
    )


def action_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("action").agg(F.count(F.lit(1)).alias("n"))

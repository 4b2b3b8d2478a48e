"""Score clamps and the decision rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp_unit(c: Column) -> Column:
    """Into [0, 1]; null, NaN and both infinities become 0."""
    x = c.cast("double")
    # NaN sorts above every number in Spark, so the comparison leaves it out as well.
    return F.when(F.abs(x) < float("inf"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(
        F.lit(0.0)
    )


def clamp01(c: Column) -> Column:
    """Into [0, 1]; null and NaN become 0, +infinity 1, -infinity 0.

    The argument appears once: it may be a long expression.
    """
    x = F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

"""Previous row per key, without gathering a key's rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftgate.plans.scratch import written


def previous_in_key(df: DataFrame, key: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add `name`: `value` of the row before this one within `key` by `order`.

    `order` must tell rows of a key apart. A plain lag would sort all rows of a key in
    one task. Here the table is range-partitioned on (key, order), which splits a heavy
    key, and written; lag runs inside each piece. Across pieces only a piece's first row
    can lack the row before, which is then the last one of the piece before: one row per piece.
    """
    order = list(order)
    ranged = df.repartitionByRange(F.col(key), *[F.col(c) for c in order])
    pieces = written(ranged.withColumn("__piece", F.spark_partition_id()), "pieces")
    last = F.max_by(F.struct(F.col(key).alias("k"), F.col(value).alias("v")), F.struct(key, *order)).alias("last")
    ends = pieces.groupBy("__piece").agg(last, F.min(F.struct(F.col(key).alias("k"))).alias("first"))
    ends = ends.withColumn("before", F.lag("last").over(Window.orderBy("__piece")))
    goes_on = ends.where(F.col("before").isNotNull() & F.col("before.k").eqNullSafe(F.col("first.k")))
    goes_on = goes_on.select("__piece", F.col("first.k").alias("__key"), F.col("before.v").alias("__linked"), F.lit(True).alias("__goes_on"))
    inside = Window.partitionBy("__piece", key).orderBy(*order)
    marked = pieces.withColumn("__before", F.lag(value).over(inside)).withColumn("__first", F.row_number().over(inside) == 1)
    linked = marked.join(F.broadcast(goes_on), "__piece", "left")
    cut = F.col("__first") & F.coalesce("__goes_on", F.lit(False)) & F.col(key).eqNullSafe(F.col("__key"))
    out = linked.withColumn(name, F.when(cut, F.col("__linked")).otherwise(F.col("__before")))
    return out.select(*df.columns, name)

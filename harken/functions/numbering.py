"""Places in an order, without a window over a whole group: buckets that keep the order, their offsets, and places inside a bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(df: DataFrame, keys: list[str], bucket: Column, order: list[str], name: str = "place", most: int | None = None) -> DataFrame:
    """Adds ``name``, the place from 0 of each row among those of equal ``keys`` by (bucket, order).

    Only counts per bucket are ordered per group. With ``most``, rows at that place and later go, and buckets that hold no others are not ordered.
    """
    df = df.withColumn("_bucket", bucket)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    if most is not None:
        sizes = sizes.where(F.col("_offset") < most)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    df = df.join(sizes, [*keys, "_bucket"]).withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1).drop("_bucket", "_offset")
    return df if most is None else df.where(F.col(name) < most)

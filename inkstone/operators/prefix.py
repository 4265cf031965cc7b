"""Running sums without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_sum(df: DataFrame, groups: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Inclusive running sum of `value` within `groups`, ordered by (bucket, *order).

    The window over rows runs within a bucket only; a second one runs over the buckets' sums, of which there are as many as
    buckets, a number that the caller fixes. These are broadcast.
    """
    sums = df.groupBy(*groups, bucket).agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(W.partitionBy(*groups).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("_sum")
    within = F.sum(value).over(W.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("_within", within).join(F.broadcast(before), [*groups, bucket]).withColumn(out, F.col("_before") + F.col("_within")).drop("_before", "_within")

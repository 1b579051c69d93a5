"""Places in an order without one task that sees all rows.

A bounded sample of the order's keys gives boundaries of ranges; each row's range is found in its own row.
Rows are counted by group and range, the counts of a group added up, and rows numbered inside their range
from where it begins. Ties in the first columns are told apart by the others, so a key that holds
many rows is cut into ranges, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the sample for each range.
SAMPLED = 64


def boundaries(df: DataFrame, order: list[str], ranges: int) -> list:
    """At most ``ranges - 1`` keys that cut the rows into about equal parts; a sample of bounded size decides."""
    key = F.struct(*order)
    sample = df.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(SAMPLED * ranges).select("k.*").distinct()
    sample = sample.orderBy(*order).collect()
    return sample[len(sample) // ranges :: max(1, len(sample) // ranges)][: ranges - 1] if len(sample) > ranges else sample[1:]


def numbered(df: DataFrame, order: list[str], group: list[str] = (), place: str = "place", total: str = "total", ranges: int | None = None) -> DataFrame:
    """``df`` plus place (from 1) and total, the row's place in its group by ``order`` and the group's rows. Nulls come
    first; rows that are equal in all columns of the order take any of their places."""
    spark, group = df.sparkSession, list(group)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = boundaries(df, [*group, *order], ranges)
    keys = [*group, *order]
    passed = F.lit(0)
    if cuts:
        kinds = {f.name: f.dataType for f in df.select(*keys).schema}
        table = F.array(*[F.struct(*[F.lit(c[k]).cast(kinds[k]).alias(k) for k in keys]) for c in cuts])
        passed = F.size(F.filter(table, lambda c: c <= F.struct(*keys)))
    held = df.withColumn("_range", passed)
    counts = held.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    parts = counts.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_range", "_n"))).alias("_parts")) if group else counts.agg(F.array_sort(F.collect_list(F.struct("_range", "_n"))).alias("_parts"))
    sums = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["_n"])
    starts = parts.select(*group, sums("_parts").alias(total), F.explode(F.transform("_parts", lambda p: F.struct(p["_range"].alias("_range"), sums(F.filter("_parts", lambda q: q["_range"] < p["_range"])).alias("_before")))).alias("_p"))
    starts = starts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], total, F.col("_p._range").alias("_r"), F.col("_p._before").alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    found = held.withColumn("_inside", inside).join(starts, same)
    return found.select(*df.columns, (F.col("_before") + F.col("_inside")).alias(place), total)

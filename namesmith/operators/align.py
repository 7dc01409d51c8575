"""Row positions, positional alignment, lookups and multisets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage

_LOCAL_BITS = (1 << 33) - 1


def number_rows(df: DataFrame, order_by: list[str], index: str = "position") -> DataFrame:
    """Add a gapless 0-based row number in the order of the (unique) sort columns.

    Rows are range-partitioned, numbered within their partition and staged, so that
    partition numbers are fixed before they are counted; each partition then gets the
    number of rows ahead of it. No single task sees more than its range.
    """
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    fixed = stage(
        ranged.withColumns(
            {"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}
        ),
        "numbered",
    )
    # one row per partition
    sizes = fixed.groupBy("_part").agg(F.count("*").alias("_rows"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_offset")
    )
    position = F.col("_offset") + F.col("_seq").bitwiseAND(_LOCAL_BITS)
    return (
        fixed.join(F.broadcast(offsets), "_part")
        .withColumn(index, position)
        .drop("_part", "_seq", "_offset")
    )


def running_total(
    df: DataFrame, order_by: list[str], amount: str, total: str = "ahead"
) -> DataFrame:
    """Add the sum of ``amount`` over all rows ahead in the order of the (unique) sort columns.

    Two levels: sums of ranges, of which there is one row each, and sums within a range. Made
    for narrow tables, as rows move twice.
    """
    ranged = df.repartitionByRange(*order_by).withColumn("_part", F.spark_partition_id())
    fixed = stage(ranged, "ranges")
    sums = fixed.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    local = fixed.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return local.join(F.broadcast(offsets), "_part").withColumn(
        total, F.col("_offset") + F.col("_within")).drop("_part", "_offset", "_within")


def zip_by_position(
    left: DataFrame,
    right: DataFrame,
    left_order: list[str],
    right_order: list[str],
    strict: bool = False,
) -> DataFrame:
    """Pair rows by position; surplus rows of the longer side are left out.

    With ``strict`` an unequal length is an error instead.
    """
    numbered_left = number_rows(left, left_order)
    numbered_right = number_rows(right, right_order)
    if strict:
        n_left, n_right = numbered_left.count(), numbered_right.count()
        if n_left != n_right:
            raise ValueError(f"sides differ in length: {n_left} and {n_right}")
    return numbered_left.join(numbered_right, "position")


def lookup_join(
    df: DataFrame, table: DataFrame, keys: list[str], unique: bool = False
) -> DataFrame:
    """Left join to a table with one row per key; a repeated key is an error.

    One pass over ``df``: Spark broadcasts the table where its own size limit allows that,
    and else shuffles both sides and splits the partitions of keys that dominate ``df``.
    ``unique`` says that the table is known to repeat no key, which saves the check.
    """
    if not unique:
        table = table.dropna(subset=keys)  # a null key matches nothing
        most = table.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).scalar()
        stop = F.raise_error(F.lit(f"a key of {', '.join(keys)} is repeated"))
        fine = F.coalesce(most, F.lit(0)) <= 1
        values = [c for c in table.columns if c not in keys]
        table = table.select(
            *keys, *[F.when(fine, F.col(c)).otherwise(stop).alias(c) for c in values]
        )
    return df.join(table, keys, "left")


def multiset_intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows common to both sides with ``copies``, the smaller count of the two.

    Copies are counted before the shuffle, so a row repeated without end is one
    record per task.
    """
    cols = left.columns
    a = left.groupBy(*cols).agg(F.count("*").alias("_l"))
    b = right.select(*cols).groupBy(*cols).agg(F.count("*").alias("_r"))
    same = [a[c].eqNullSafe(b[c]) for c in cols]
    on = same[0]
    for term in same[1:]:
        on = on & term
    copies = F.least(F.col("_l"), F.col("_r"))
    return a.join(b, on).select(*[a[c] for c in cols], copies.alias("copies"))


def bag_count(grams: DataFrame, keys: list[str]) -> DataFrame:
    """Occurrences per key columns: a multiset as ``(keys, n)`` rows."""
    return grams.groupBy(*keys).agg(F.count("*").alias("n"))


def union_all(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, matched by column name."""
    first, *rest = tables
    for table in rest:
        first = first.unionByName(table)
    return first

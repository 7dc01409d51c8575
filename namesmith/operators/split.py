"""Seeded shuffles and exact-size splits without a global sort.

A row's place in the shuffle is ``md5(seed:id)``, so it does not depend on how the
data is partitioned. The first ``n`` rows are those up to the ``n``-th smallest key:
one value, found on the id column alone, that every scan task then compares with.
``id`` must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import HOLDOUT_ROWS, SEED, VALIDATION_ROWS
from ..storage import stage

_PREFIX = 4  # hex digits of the key: 65,536 equal buckets


def shuffle_key(seed: int | str = SEED, key: str = "id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _ordered(seed: int | str, key: str) -> Column:
    return F.struct(shuffle_key(seed, key).alias("k"), F.col(key).alias("i"))


def shuffle(df: DataFrame, seed: int = SEED, key: str = "id") -> DataFrame:
    """All rows in shuffled order (a range-partitioned sort)."""
    return df.orderBy(shuffle_key(seed, key), key)


def head(df: DataFrame, n: int = 5, key: str = "id") -> DataFrame:
    """First ``n`` rows by id."""
    return df.orderBy(key).limit(n)


def nth_key(df: DataFrame, n: int, seed: int | str = SEED, key: str = "id") -> DataFrame:
    """One row: the ``n``-th smallest shuffle key, or an error if there are fewer rows.

    Keys are uniform, so they are counted by prefix and only the bucket that holds the
    bound is ranked. A top-k would send up to ``n`` rows of every task to a single one.
    """
    return _bound(df.select(_ordered(seed, key).alias("s")), n, _bucket_of(df, n, seed, key))


def _bucket_of(df: DataFrame, n: int, seed: int | str, key: str) -> tuple[str, int] | None:
    """Prefix of the bucket with the ``n``-th key, and the rows before it.

    At most 65,536 counts are summed up.
    """
    prefix = F.substring(shuffle_key(seed, key), 1, _PREFIX)
    counts = df.groupBy(prefix.alias("p")).agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy("p")))
    hit = upto.where(F.col("upto") >= n).orderBy("p").limit(1).first()
    return hit and (hit["p"], hit["upto"] - hit["c"])


def _bound(keys: DataFrame, n: int, bucket: tuple[str, int] | None) -> DataFrame:
    """The ``n``-th of the keys ``s``, which is in the given bucket; an error without one."""
    start, before = bucket or ("", 0)
    prefix = F.substring("s.k", 1, _PREFIX)
    inside = keys.where(prefix == start if bucket else F.lit(False))
    place = F.row_number().over(Window.partitionBy(prefix).orderBy("s"))
    bound = inside.withColumn("place", place).where(
        F.col("place") == n - before
    )
    return bound.agg(F.max("s").alias("s")).select(
        F.coalesce("s", F.raise_error(F.lit(f"fewer than {n} rows"))).alias("bound")
    )


def take_first(df: DataFrame, n: int, seed: int = SEED, key: str = "id") -> DataFrame:
    """The first ``n`` rows of the shuffle; an error when there are fewer."""
    if n == 0:
        return df.where(F.lit(False))
    return df.where(_ordered(seed, key) <= nth_key(df, n, seed, key).scalar())


def holdout(
    df: DataFrame, n_test: int = HOLDOUT_ROWS, seed: int | str = SEED, key: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """``(rest, held_out)`` with exactly ``n_test`` rows held out."""
    if n_test == 0:
        return df, df.where(F.lit(False))
    bound = nth_key(df, n_test, seed, key)
    inside = _ordered(seed, key) <= bound.scalar()
    return df.where(~inside), df.where(inside)


def complement(df: DataFrame, held_out: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not in ``held_out``."""
    return df.join(held_out.select(key), key, "left_anti")


def second_split(
    held_out: DataFrame, n_val: int = VALIDATION_ROWS, seed: int = SEED, key: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """Cut the held-out rows into ``(test, validation)``.

    The seed is salted: the same seed would repeat the order of the first split.
    """
    return holdout(held_out, n_val, _second(seed), key)


def _second(seed: int | str) -> str:
    return f"{seed}:2"


def tag_splits(
    df: DataFrame,
    n_holdout: int = HOLDOUT_ROWS,
    n_val: int = VALIDATION_ROWS,
    seed: int = SEED,
    key: str = "id",
) -> DataFrame:
    """Add ``split``: train, or for the held-out rows validation or test.

    Both bounds are single values, so the tagging itself is a projection. They are found
    in two scans of the key column: one counts prefixes, the other keeps the keys up to
    the first bound's bucket.
    """
    if n_holdout == 0:
        return df.withColumn("split", F.lit("train"))
    ids = df.select(key)
    bucket = _bucket_of(ids, n_holdout, seed, key)
    near = F.substring(shuffle_key(seed, key), 1, _PREFIX) <= (bucket[0] if bucket else "")
    few = stage(ids.where(near), "split-keys")
    ordered = few.select(_ordered(seed, key).alias("s"))
    first = _literal(_bound(ordered, n_holdout, bucket))
    if n_val == 0:
        return df.withColumn("split", F.when(_ordered(seed, key) > first, "train").otherwise("test"))
    held_out = few.where(_ordered(seed, key) <= first)
    second = _literal(nth_key(held_out, n_val, _second(seed), key))
    return df.withColumn(
        "split",
        F.when(_ordered(seed, key) > first, F.lit("train"))
        .when(_ordered(_second(seed), key) <= second, F.lit("validation"))
        .otherwise(F.lit("test")),
    )


def _literal(bound: DataFrame) -> Column:
    """A bound's one row as a constant."""
    row = bound.first()["bound"]
    return F.struct(F.lit(row["k"]).alias("k"), F.lit(row["i"]).alias("i"))


def ratio_split(
    df: DataFrame,
    train: float = 0.70,
    validation: float = 0.15,
    seed: int = SEED,
    key: str = "id",
) -> DataFrame:
    """Add ``split`` by share: each row decides from its own key, nothing is counted."""
    bucket = F.conv(F.substring(shuffle_key(seed, key), 1, 8), 16, 10).cast("long") % 10_000
    upper = round(train * 10_000), round((train + validation) * 10_000)
    return df.withColumn(
        "split",
        F.when(bucket < upper[0], F.lit("train"))
        .when(bucket < upper[1], F.lit("validation"))
        .otherwise(F.lit("test")),
    )

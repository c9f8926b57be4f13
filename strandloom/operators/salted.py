"""Per-key results when a few keys hold most rows: two-stage salted aggregation.

Stage one aggregates under (key, salt), stage two merges the partial results under the key. Only
keys whose row count exceeds ``heavy_rows`` get more than one salt; the others keep salt 0, so the
long tail of small keys pays nothing. Salts come from a hash of the row and not from a random
number: a task that is run again after an executor is lost assigns the same salts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_ROWS = 50_000
SALTS = 64


#: A key must hold more than one in so many rows to count as heavy: so long is the list of heavy keys at most.
MOST_HEAVY = 10_000


def heavy_keys(df: DataFrame, key: str, heavy_rows: int = HEAVY_ROWS) -> list:
    """Keys with more than ``heavy_rows`` rows and more than a ``MOST_HEAVY``-th of all rows.

    The second condition bounds the list by ``MOST_HEAVY`` keys at every size of the table, so it
    may stand in the plan as a literal list; a lighter key is no burden to the task that gets it.
    """
    least = max(heavy_rows, df.count() // MOST_HEAVY)
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count()
    return [r[0] for r in counts.where(F.col("count") > least).select(key).collect()]


def salted_distinct_counts(
    df: DataFrame,
    key: str,
    values: dict[str, str],
    heavy_rows: int = HEAVY_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """For every ``key`` the number of distinct values of each column of ``values``.

    ``values`` maps output names to input columns. The salt is a hash of the value itself, so equal
    values meet under one salt: distinct counts of the salts are disjoint and simply add up.

    Defined results: rows whose key is null form no group; null values count for nothing, so a
    key with only null values gets 0; repeated rows count once; an empty table gives no rows;
    other columns of ``df`` are ignored whatever their names.
    """
    names = list(values)
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("__key"), *[F.col(values[n]).cast("string").alias(f"__v{i}") for i, n in enumerate(names)]
    )
    long = rows.select(
        "__key",
        F.posexplode(F.array(*[F.col(f"__v{i}") for i in range(len(names))])).alias("__kind", "__value"),
    )
    heavy = heavy_keys(rows.select("__key"), "__key", heavy_rows)
    salt = F.when(F.col("__key").isin(heavy), F.pmod(F.xxhash64("__value"), F.lit(salts))).otherwise(F.lit(0))
    salted = long.withColumn("__salt", salt.cast("int"))
    partial = (
        salted.groupBy("__key", "__salt", "__kind", "__value")
        .agg(F.lit(1).alias("__one"))
        .groupBy("__key", "__salt", "__kind")
        .agg(F.count("__value").alias("__n"))
    )
    merged = partial.groupBy("__key").agg(
        *[F.coalesce(F.sum(F.when(F.col("__kind") == i, F.col("__n"))), F.lit(0)).alias(n) for i, n in enumerate(names)]
    )
    return merged.withColumnRenamed("__key", key)


def salted_aggregate(
    df: DataFrame,
    key: str,
    partials: dict[str, Column],
    merges: dict[str, Column],
    heavy_rows: int = HEAVY_ROWS,
    salts: int = SALTS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Any aggregate that splits into partial results, under a salted key.

    ``partials`` are aggregates over the rows of one (key, salt); ``merges`` are aggregates over
    the columns named in ``partials``. The salt of a heavy row is a hash of the columns ``by``
    (all columns by default). Rows with a null key form the group of the null key.
    """
    cols = list(by) or df.columns
    heavy = heavy_keys(df.select(key), key, heavy_rows)
    salt = F.when(F.col(key).isin(heavy), F.pmod(F.xxhash64(*cols), F.lit(salts))).otherwise(F.lit(0))
    salted = df.withColumn("__salt", salt)
    first = salted.groupBy(key, "__salt").agg(*[c.alias(n) for n, c in partials.items()])
    return first.groupBy(key).agg(*[c.alias(n) for n, c in merges.items()])

"""Pairs that share a bucket, when buckets may be huge: tiles instead of whole buckets.

A bucket of n members is divided into ceil(n / TILE) parts by a hash of the member, and the join
runs over pairs of parts. No task ever holds more than two parts of one bucket at a time; a bucket
of ordinary size is one part and is joined as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a bucket part.
TILE = 1_000


def bucket_pairs(members: DataFrame, bucket: list[str], member: str, tile: int = TILE, apart: bool = False, once: bool = False, least: int = 1, counted: bool = False) -> DataFrame:
    """Distinct pairs (a, b), a < b, of members that share at least ``least`` buckets; if ``counted``, with their number ``shared``.

    ``apart`` promises that no member is in two buckets; the pairs are distinct then as they come.
    ``once`` promises that no member is in a bucket twice and that nothing is null.
    Defined results: rows with a null in the bucket or the member pair with nothing; a member
    that is in a bucket twice is there once; an empty table gives no rows.
    """
    rows = members.select(*bucket, F.col(member).alias("member"))
    rows = rows if once else rows.dropna().distinct()
    sizes = rows.groupBy(*bucket).agg(F.count("*").alias("__n")).where(F.col("__n") > 1)
    held = rows.join(sizes, bucket).withColumn("__parts", F.ceil(F.col("__n") / F.lit(tile)).cast("int"))
    held = held.withColumn("__own", F.pmod(F.xxhash64("member"), F.col("__parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("__parts") - 1)
    left = held.select(
        *bucket, F.col("member").alias("x"), F.col("__own").alias("__i"), F.explode(F.filter(every, lambda p: p >= F.col("__own"))).alias("__j")
    )
    right = held.select(
        *bucket, F.col("member").alias("y"), F.explode(F.filter(every, lambda p: p <= F.col("__own"))).alias("__i"), F.col("__own").alias("__j")
    )
    pairs = left.join(right, [*bucket, "__i", "__j"]).where(
        (F.col("x") != F.col("y")) & ((F.col("__i") != F.col("__j")) | (F.col("x") < F.col("y")))
    )
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    if least > 1 or counted:
        pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
        return pairs if counted else pairs.select("a", "b")
    return pairs if apart else pairs.distinct()


def linked_pairs(links: DataFrame, a: str, b: str, members: DataFrame, of: str, member: str, tile: int = TILE) -> DataFrame:
    """(x, y): every member of class ``a`` with every member of class ``b`` of each link, tile by tile.

    ``links`` has each pair of classes once; ``members`` (``of``, ``member``) has each member once. No
    task holds more than a part of each of two classes for one link.
    Defined results: links of classes without members, and rows with a null, give nothing.
    """
    held = members.select(F.col(of).alias("__c"), F.col(member).alias("__m")).dropna()
    parts = held.groupBy("__c").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("__parts"))
    held = held.join(parts, "__c").select("__c", "__m", F.pmod(F.xxhash64("__m"), F.col("__parts")).cast("int").alias("__part"))
    of_side = lambda c, i: parts.select(F.col("__c").alias(c), F.sequence(F.lit(0), F.col("__parts") - 1).alias(i))
    tiles = links.select(F.col(a).alias("__a"), F.col(b).alias("__b")).join(of_side("__a", "__is"), "__a").join(of_side("__b", "__js"), "__b")
    tiles = tiles.select("__a", "__b", F.explode("__is").alias("__i"), "__js").select("__a", "__b", "__i", F.explode("__js").alias("__j"))
    side = lambda c, i, m: tiles.join(held.select(F.col("__c").alias(c), F.col("__part").alias(i), F.col("__m").alias(m)), [c, i])
    return side("__a", "__i", "x").join(side("__b", "__j", "y"), ["__a", "__b", "__i", "__j"]).select("x", "y")

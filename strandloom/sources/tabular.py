"""Match tables and generic helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.cigar import parse

# The columns of the match table, in order.
PAF = (
    "query string, qlen int, qstart int, qend int, empty string, target string, tlen int, tstart int, tend int, "
    "nident int, alnlen int, bits int, cigar string, fident double, raw int"
)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Matches of a 15-column tab-separated table: places become 0-based and half-open, reverse order means reverse strand."""
    raw = spark.read.csv(path, sep="\t", schema=PAF, mode="FAILFAST")
    forward = (F.col("qstart") <= F.col("qend")) == (F.col("tstart") <= F.col("tend"))
    return raw.select(
        F.col("query").alias("q_name"),
        F.col("qlen").alias("q_len"),
        (F.least("qstart", "qend") - 1).alias("q_start"),
        F.greatest("qstart", "qend").alias("q_end"),
        F.col("target").alias("r_name"),
        F.col("tlen").alias("r_len"),
        (F.least("tstart", "tend") - 1).alias("r_start"),
        F.greatest("tstart", "tend").alias("r_end"),
        F.col("nident").alias("matches"),
        F.col("alnlen").alias("length"),
        F.col("bits").alias("quality"),
        forward.alias("forward"),
        parse(F.col("cigar")).alias("cigar"),
        (1 - F.col("fident")).alias("divergence"),
    )


def read_table_file(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV (with header), JSON-lines or Parquet table by its extension; errors aren't turned into nulls."""
    reader = spark.read.schema(schema) if schema else spark.read
    if ".csv" in path or ".tsv" in path:
        return reader.csv(path, header=True, sep="\t" if ".tsv" in path else ",", mode="FAILFAST")
    if ".json" in path:
        return reader.option("mode", "FAILFAST").json(path)
    return reader.parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=sep)


def schema_json(df: DataFrame) -> str:
    """The schema of a table as JSON."""
    return df.schema.json()

"""FASTA in and out."""

from __future__ import annotations

import bz2
import gzip
import lzma
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.seq import LETTERS
from strandloom.session import ship

SCHEMA = "rec_index bigint, seq_name string, descr string, seq string"

#: Codecs that the text reader knows by the file name; xz is unpacked by a Python function, file by file.
SPLITTABLE = ("", ".gz", ".bz2", ".zst", ".deflate", ".snappy", ".lz4")


class FastaError(ValueError):
    """A file that is no FASTA, or letters outside the alphabet."""


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([lzma.decompress(c.as_py()).decode("utf-8") for c in batch.column(1)], pa.string())], names=["file", "text"]
        )


def read_fasta(spark: SparkSession, paths: Sequence[str], alphabet: str | None = None, gaps: bool = False) -> DataFrame:
    """Records of all files in the order given: rec_index, seq_name, descr, seq.

    The name ends at the first space, what follows is the description (null if empty). Letters are
    upper-cased, lines are trimmed and joined, text before the first header is skipped. Files are
    read record by record ('>' at the start of a line divides records), so a file of any size
    is read by as many tasks as it has splits.

    Raises FastaError for a file with text but without any header, and for letters outside the
    alphabet; a file of blanks only gives no rows.
    """
    ship(spark)
    ordinal = {os.path.basename(p): i for i, p in enumerate(paths)}
    if len(ordinal) != len(paths):
        raise FastaError("two files have the same name")
    plain = [p for p in paths if not p.endswith(".xz")]
    packed = [p for p in paths if p.endswith(".xz")]
    parts = []
    if plain:
        text = spark.read.option("lineSep", "\n>").text(plain).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("record"), F.monotonically_increasing_id().alias("at")
        )
        parts.append(text)
    if packed:
        files = spark.read.format("binaryFile").load(packed).select(F.col("path").alias("file"), "content")
        whole = files.mapInArrow(_unpack, "file string, text string")
        parts.append(whole.select("file", F.posexplode(F.split("text", "\n>")).alias("at", "record")).select("file", F.lit(0).cast("bigint").alias("block"), "record", F.col("at").cast("bigint").alias("at")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    number = F.element_at(F.create_map(*[x for n, i in ordinal.items() for x in (F.lit(n), F.lit(i))]), F.element_at(F.split(F.regexp_replace("file", "%20", " "), "/"), -1))
    rows = rows.withColumn("record", F.regexp_replace("record", "\r", "")).withColumn("file_no", number)
    # a record's place in its file: records of the splits before, and its place in its own split. Only the table
    # of splits is put in order; the records themselves are never sorted or brought together
    splits = rows.groupBy("file_no", "block").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    ahead = F.sum("n").over(Window.partitionBy("file_no").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file_no", "block", "low", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    rows = rows.join(splits, ["file_no", "block"]).withColumn("place", F.col("ahead") + F.col("at") - F.col("low"))
    rows = rows.withColumn("first", F.col("place") == 0)
    # what precedes the first header of a file is skipped; the reader took the '>' of all other headers
    head = F.regexp_replace("record", "(?s)^\\s*>", "")
    starts = ~F.col("first") | F.col("record").rlike("(?s)^\\s*>")
    bad = rows.where(F.col("first") & ~starts & (F.trim(F.regexp_replace("record", "\\s", "")) != ""))
    lonely = bad.join(rows.where(~F.col("first")).select("file_no").distinct(), "file_no", "left_anti").select("file").head()
    if lonely:
        raise FastaError(f"no header line in {lonely[0]}")
    records = rows.where(starts).withColumn("body", F.when(F.col("first"), head).otherwise(F.col("record")))
    line = F.regexp_extract("body", "^[^\n]*", 0)
    name, rest = F.regexp_extract(line, "^[^ ]*", 0), F.trim(F.regexp_replace(line, "^[^ ]* ?", ""))
    seq = F.upper(F.regexp_replace(F.regexp_replace("body", "^[^\n]*", ""), "[ \t\n]*\n[ \t]*|[ \t]+$", ""))
    out = records.select("file_no", "place", name.alias("seq_name"), F.when(rest != "", rest).alias("descr"), seq.alias("seq"))
    # an index over all files: records of the files before, then the place within the file
    counts = {r["file_no"]: (r["n"], r["low"]) for r in out.groupBy("file_no").agg(F.count("*").alias("n"), F.min("place").alias("low")).collect()}
    before, total = {}, 0
    for i in range(len(paths)):
        n, low = counts.get(i, (0, 0))
        before[i], total = total - low, total + n
    offset = F.element_at(F.create_map(*[x for i, n in before.items() for x in (F.lit(i), F.lit(n))]), F.col("file_no"))
    index = offset + F.col("place")
    letters = alphabet if alphabet is not None else LETTERS[:15] + ("\\-" if gaps else "")
    note = F.when(F.col("seq").contains("-"), " (gaps aren't allowed here)").otherwise("")
    error = F.raise_error(F.concat(F.lit("letter outside the alphabet in "), F.col("seq_name"), F.lit(": "), F.regexp_extract("seq", f".{{0,10}}[^{letters}].{{0,10}}", 0), note))
    checked = F.when(F.col("seq").rlike(f"^[{letters}]*$"), F.col("seq")).otherwise(error)
    return out.select(index.cast("bigint").alias("rec_index"), "seq_name", "descr", checked.alias("seq"))


def fasta_lines(records: DataFrame, name: str = "seq_name", descr: str | None = "descr", seq: str = "seq") -> DataFrame:
    """The text of each record, without line wrapping."""
    head = F.concat_ws(" ", F.concat(F.lit(">"), F.col(name)), *([F.col(descr)] if descr else []))
    return records.select(F.concat(head, F.lit("\n"), F.col(seq)).alias("value"))


def write_fasta(records: DataFrame, path: str, order: Sequence[str] = (), compression: str | None = None, **columns) -> None:
    """A folder of FASTA text in the order of the given columns; parts follow each other in that order."""
    ordered = records.orderBy(*order) if order else records
    writer = fasta_lines(ordered, **columns).write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).text(path)


def open_out(path: str):
    """A text file on the driver, packed by its extension; levels come from GZ_, BZ2_, XZ_ and ZST_COMPRESSION."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    level = lambda kind: int(os.environ.get(f"{kind}_COMPRESSION", "2"))
    if path.endswith(".gz"):
        return gzip.open(path, "wt", compresslevel=level("GZ"))
    if path.endswith(".bz2"):
        return bz2.open(path, "wt", compresslevel=max(1, level("BZ2")))
    if path.endswith(".xz"):
        return lzma.open(path, "wt", preset=level("XZ"))
    if path.endswith(".zst"):
        import zstandard

        return zstandard.open(path, "wt", cctx=zstandard.ZstdCompressor(level=level("ZST")))
    return open(path, "w")


def write_file(path: str, text: str) -> None:
    """One text file on the driver."""
    with open_out(path) as f:
        f.write(text)

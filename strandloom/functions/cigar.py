"""CIGAR strings as arrays of (op, len), and their algebra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.tables import EDIT_TYPES


def parse(text: Column) -> Column:
    """ARRAY<STRUCT<op, len>>; blanks and tabs are skipped."""
    clean = F.regexp_replace(text, "[ \t]", "")
    lens, ops = F.regexp_extract_all(clean, F.lit(r"(\d+)[A-Z=]"), F.lit(1)), F.regexp_extract_all(clean, F.lit(r"\d+([A-Z=])"), F.lit(1))
    return F.transform(F.arrays_zip(ops.alias("op"), lens.alias("len")), lambda z: F.struct(z["op"].alias("op"), z["len"].cast("int").alias("len")))


def text(cigar: Column) -> Column:
    return F.array_join(F.transform(cigar, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")


def match_length(cigar: Column) -> Column:
    return F.aggregate(F.filter(cigar, lambda o: o["op"].isin("M", "=", "X")), F.lit(0), lambda a, o: a + o["len"])


def total_length(cigar: Column) -> Column:
    return F.aggregate(cigar, F.lit(0), lambda a, o: a + o["len"])


def has_no_indel(cigar: Column) -> Column:
    return ~F.exists(cigar, lambda o: o["op"].isin("I", "D"))


def invert(cigar: Column) -> Column:
    return F.reverse(cigar)


def swap_sides(cigar: Column) -> Column:
    """Insertions become deletions and the other way round: the roles of query and reference change."""
    op = lambda o: F.when(o["op"] == "I", "D").when(o["op"] == "D", "I").otherwise(o["op"])
    return F.transform(cigar, lambda o: F.struct(op(o).alias("op"), o["len"].alias("len")))


def add_leading(cigar: Column, op: str, n: Column) -> Column:
    """An indel of ``n`` at the start: an indel of the same kind before the first match grows, else a new one is put first."""
    runs = F.aggregate(
        cigar,
        F.struct(F.lit(False).alias("seen"), F.lit(False).alias("done"), F.array().cast("array<struct<op:string,len:int>>").alias("ops")),
        lambda a, o: F.struct(
            (a["seen"] | o["op"].isin("M", "=", "X")).alias("seen"),
            (a["done"] | (~a["seen"] & (o["op"] == op))).alias("done"),
            F.concat(
                a["ops"], F.array(F.struct(o["op"].alias("op"), F.when(~a["seen"] & ~a["done"] & (o["op"] == op), o["len"] + n).otherwise(o["len"]).cast("int").alias("len")))
            ).alias("ops"),
        ),
    )
    first = F.array(F.struct(F.lit(op).alias("op"), n.cast("int").alias("len")))
    return F.when(n <= 0, cigar).when(runs["done"], runs["ops"]).otherwise(F.concat(first, cigar))


def add_trailing(cigar: Column, op: str, n: Column) -> Column:
    return F.reverse(add_leading(F.reverse(cigar), op, n))


def extend(cigar: Column, forward: Column, anchor_left: Column, anchor_right: Column, append_left: Column, append_right: Column) -> Column:
    """A cigar after both sides of a match grew: the anchor's growth deletes, the other's inserts; sides swap if reverse."""
    first = F.when(forward, append_left).otherwise(append_right)
    last = F.when(forward, append_right).otherwise(append_left)
    return add_trailing(add_leading(add_trailing(add_leading(cigar, "D", anchor_left), "D", anchor_right), "I", first), "I", last)


def to_edit(cigar: Column) -> Column:
    """An Edit of the cigar's indels; inserted letters are N."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(EDIT_TYPES["dels"]).alias("dels"), F.array().cast(EDIT_TYPES["inss"]).alias("inss"))
    done = F.aggregate(
        cigar,
        start,
        lambda a, o: F.struct(
            F.when(o["op"] == "I", a["at"]).otherwise(a["at"] + o["len"]).alias("at"),
            F.when(o["op"] == "D", F.concat(a["dels"], F.array(F.struct(a["at"].alias("pos"), o["len"].alias("len"))))).otherwise(a["dels"]).alias("dels"),
            F.when(o["op"] == "I", F.concat(a["inss"], F.array(F.struct(a["at"].alias("pos"), F.repeat(F.lit("N"), o["len"]).alias("seq"))))).otherwise(a["inss"]).alias("inss"),
        ),
    )
    return F.struct(F.array().cast(EDIT_TYPES["subs"]).alias("subs"), done["dels"].alias("dels"), done["inss"].alias("inss"))

"""Node sequences, reconstruction of genomes, core alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.edits import apply_aligned, apply_edit
from strandloom.functions.seq import describe, reverse_complement, rotate_right
from strandloom.operators.stats import strict_core
from strandloom.tables import Graphs


def node_sequences(g: Graphs, aligned: bool = False) -> DataFrame:
    """graph, block, node, seq: own sequences, or rows of the block alignment (Q7)."""
    f = apply_aligned if aligned else apply_edit
    return g.alignments.select("graph_id", "block_id", "node_id", f(F.col("consensus"), F.col("edit")).alias("seq"))


def reconstruct(g: Graphs) -> DataFrame:
    """graph, path, path_name, seq, complete: each genome from its walk.

    Node sequences are put together in walk order, reversed where the node is, and turned right by
    the start of the first node. A path without nodes is an empty sequence. ``complete`` tells whether
    all places had a sequence and the length is the path's own.
    """
    seqs = node_sequences(g).select("node_id", "seq")
    part = F.when(F.col("fwd"), F.col("seq")).otherwise(reverse_complement(F.col("seq")))
    placed = g.walks.join(seqs, "node_id").groupBy("graph_id", "path_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", part.alias("part")))).alias("parts"),
        F.min(F.struct("ord", "pos_start"))["pos_start"].alias("offset"),
    )
    whole = placed.select("graph_id", "path_id", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("joined"), F.size("parts").alias("n"), "offset")
    out = g.paths.join(whole, ["graph_id", "path_id"], "left")
    seq = F.coalesce(rotate_right(F.col("joined"), F.col("offset").cast("int")), F.lit(""))
    return out.select(
        "graph_id", "path_id", "path_name", seq.alias("seq"),
        ((F.coalesce("n", F.lit(0)) == F.coalesce(F.size("nodes"), F.lit(0))) & (F.length(seq) == F.col("tot_len"))).alias("complete"),
    )


def compare_genomes(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys at which two tables of sequences differ: full outer join on the key."""
    a = left.select(*key, F.col("seq").alias("seq_left"))
    b = right.select(*key, F.col("seq").alias("seq_right"))
    joined = a.join(b, key, "full_outer")
    return joined.where(~F.col("seq_left").eqNullSafe(F.col("seq_right"))).select(
        *key, F.col("seq_left").isNull().alias("only_right"), F.col("seq_right").isNull().alias("only_left")
    )


def block_sequences(g: Graphs, aligned: bool = True) -> DataFrame:
    """Records of the per-block export: block, record name, JSON description, sequence (K4)."""
    nodes = g.nodes.select("node_id", "path_id", F.coalesce("strand", F.lit("+")).alias("strand"), "pos_start", "pos_end")
    named = node_sequences(g, aligned).join(nodes, "node_id").join(g.paths.select("path_id", "path_name"), "path_id")
    desc = describe(F.col("path_name"), F.col("block_id"), F.col("pos_start"), F.col("pos_end"), F.col("strand"))
    return named.select("graph_id", "block_id", F.col("node_id").alias("name"), desc.alias("description"), "seq")


def core_alignment(g: Graphs, core: DataFrame | None = None, guide: dict[int, str] | None = None, aligned: bool = True) -> DataFrame:
    """graph, path, path_name, seq: core blocks of every path in the order and direction of a guide path.

    The guide of a graph is its least path id unless ``guide`` names one. A block that the guide holds
    in reverse is reversed for all paths. Graphs without core blocks give empty sequences.
    """
    core = strict_core(g) if core is None else core
    walks = g.walks
    if guide:
        spark = core.sparkSession
        guides = spark.createDataFrame(list(guide.items()), "graph_id bigint, path_id string")
    else:
        guides = walks.groupBy("graph_id").agg(F.min("path_id").alias("path_id"))
    on_guide = (
        walks.join(guides, ["graph_id", "path_id"])
        .select("graph_id", "block_id", "ord", F.col("fwd").alias("guide_fwd"))
        .join(core, ["graph_id", "block_id"], "left_semi")
    )
    seqs = node_sequences(g, aligned).select("node_id", "seq")
    rows = walks.select("graph_id", "path_id", "block_id", "node_id").join(on_guide, ["graph_id", "block_id"]).join(seqs, "node_id")
    part = F.when(F.col("guide_fwd"), F.col("seq")).otherwise(reverse_complement(F.col("seq")))
    joined = rows.groupBy("graph_id", "path_id").agg(F.array_sort(F.collect_list(F.struct("ord", part.alias("part")))).alias("parts"))
    joined = joined.select("graph_id", "path_id", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("seq"))
    return g.paths.join(joined, ["graph_id", "path_id"], "left").select("graph_id", "path_id", "path_name", F.coalesce("seq", F.lit("")).alias("seq"))


def shared_segments(g: Graphs, min_len: int = 0, paths: tuple[str, str] | None = None) -> DataFrame:
    """Dotplot geometry: pairs of places of two paths of a graph with one block.

    ``paths`` names the two paths of one plot; without it every two paths of a graph are paired, which
    gives a row for every two places of a block. Circular places that wrap the origin are divided into
    two in proportion before they are paired. A name that is no path of the tables gives no rows.
    """
    lens = g.block_lengths.where(F.col("len") >= min_len)
    dup = g.walks.groupBy("graph_id", "path_id", "block_id").agg(F.count("*").alias("n")).where("n > 1").select("graph_id", "block_id").distinct()
    shown = g.paths.select("path_id", "tot_len")
    if paths:
        shown = shown.where(F.col("path_id").isin(*paths))
    places = g.walks.join(shown, "path_id").join(lens, ["graph_id", "block_id"])
    wraps = F.col("pos_end") < F.col("pos_start")
    whole = F.struct(F.col("pos_start").alias("start"), F.col("pos_end").alias("end"), F.lit(0.0).alias("from"), F.lit(1.0).alias("to"))
    size = F.col("tot_len") - F.col("pos_start") + F.col("pos_end")
    share = (F.col("tot_len") - F.col("pos_start")) / F.when(size > 0, size)
    cut = F.array(
        F.struct(F.col("pos_start").alias("start"), F.col("tot_len").alias("end"), F.lit(0.0).alias("from"), share.alias("to")),
        F.struct(F.lit(0).cast("bigint").alias("start"), F.col("pos_end").alias("end"), share.alias("from"), F.lit(1.0).alias("to")),
    )
    pieces = places.select("graph_id", "path_id", "block_id", "node_id", "fwd", F.explode(F.when(wraps, cut).otherwise(F.array(whole))).alias("s"))
    side = lambda x: pieces.select(
        "graph_id", "block_id", F.col("path_id").alias(f"path_{x}"), F.col("node_id").alias(f"node_{x}"), F.col("fwd").alias(f"fwd_{x}"), F.col("s").alias(f"s_{x}")
    )
    pairs = side("a").join(side("b"), ["graph_id", "block_id"]).where(F.col("path_a") < F.col("path_b"))
    marked = pairs.join(dup.withColumn("duplicated", F.lit(True)), ["graph_id", "block_id"], "left")
    return marked.select(
        "graph_id", "block_id", "path_a", "path_b", "node_a", "node_b",
        F.col("s_a.start").alias("start_a"), F.col("s_a.end").alias("end_a"), F.col("s_b.start").alias("start_b"), F.col("s_b.end").alias("end_b"),
        (F.col("fwd_a") == F.col("fwd_b")).alias("same_strand"), F.coalesce("duplicated", F.lit(False)).alias("duplicated"),
    )


def junction_bars(js: DataFrame, lengths: DataFrame) -> DataFrame:
    """Cumulative bars of each isolate's junction: place, block, start, end (Q17)."""
    steps = js.select("graph_id", "edge", "path_id", F.posexplode("center").alias("place", "s")).select(
        "graph_id", "edge", "path_id", "place", F.col("s.block_id").alias("block_id"), F.col("s.fwd").alias("fwd")
    )
    order = Window.partitionBy("graph_id", "edge", "path_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sized = steps.join(lengths, ["graph_id", "block_id"])
    end = F.sum("len").over(order)
    return sized.select("graph_id", "edge", "path_id", "place", "block_id", "fwd", (end - F.col("len")).alias("start"), end.alias("end"))

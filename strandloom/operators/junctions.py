"""Junctions between consecutive backbone blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.operators.stats import stats_with_paths
from strandloom.operators.walks import along_path, oriented, text_canonical
from strandloom.tables import Graphs

CORE_LENGTH = 500


def backbone(g: Graphs, min_len: int = CORE_LENGTH, predicate: Column | None = None) -> DataFrame:
    """Blocks of the backbone: core ones of ``min_len`` and more letters, or those that ``predicate`` selects."""
    chosen = F.col("core") if predicate is None else predicate
    return stats_with_paths(g).where(chosen & (F.col("len") >= min_len)).select("graph_id", "block_id", "len")


def split_walks(walks: DataFrame, core: DataFrame) -> DataFrame:
    """Walks cut at core blocks: graph, path, idx, left, center, right.

    A running count of core blocks numbers the pieces. On circular walks the piece before the first
    core block belongs after the last one. Linear walks have a piece with one flank at each end.
    """
    marks = core.select("graph_id", "block_id", F.lit(True).alias("is_core"))
    m = walks.join(marks, ["graph_id", "block_id"], "left").withColumn("is_core", F.coalesce("is_core", F.lit(False)))
    run = F.sum(F.col("is_core").cast("int")).over(along_path())
    total = F.sum(F.col("is_core").cast("int")).over(Window.partitionBy("graph_id", "path_id"))
    m = m.withColumns({"idx": run, "n_core": total})
    wraps = F.col("circular") & (F.col("idx") == 0) & (F.col("n_core") > 0)
    m = m.withColumns(
        {"late": wraps.cast("int"), "idx": F.when(wraps, F.col("n_core")).otherwise(F.col("idx"))}
    )
    oriented_block = F.struct("block_id", "fwd")
    pieces = m.groupBy("graph_id", "path_id", "circular", "n_core", "idx").agg(
        F.max(F.when(F.col("is_core"), oriented_block)).alias("left"),
        F.transform(
            F.array_sort(F.collect_list(F.when(~F.col("is_core"), F.struct("late", "ord", "block_id", "fwd")))),
            lambda s: F.struct(s["block_id"].alias("block_id"), s["fwd"].alias("fwd")),
        ).alias("center"),
    )
    along = Window.partitionBy("graph_id", "path_id").orderBy("idx")
    first_core = F.first("left", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return pieces.withColumn(
        "right", F.coalesce(F.lead("left").over(along), F.when(F.col("circular"), first_core))
    ).select("graph_id", "path_id", "n_core", "idx", "left", "center", "right")


def junctions(walks: DataFrame, core: DataFrame) -> DataFrame:
    """Junctions with both flanks, co-oriented: graph, edge, path, idx, natural, center, center_key.

    Graphs in which some path has fewer than two core blocks have no junctions; ``refused_graphs`` names them. If an edge repeats
    in a path its last junction counts. Centers are read in the direction of the canonical edge.
    """
    split = split_walks(walks, core)
    poor = split.where(F.col("n_core") < 2).select("graph_id").distinct()
    whole = split.join(poor, "graph_id", "left_anti").where(F.col("left").isNotNull() & F.col("right").isNotNull())
    keyed = text_canonical(whole)
    flipped = F.transform(F.reverse("center"), lambda s: F.struct(s["block_id"].alias("block_id"), (~s["fwd"]).alias("fwd")))
    keyed = keyed.withColumn("center", F.when(F.col("natural"), F.col("center")).otherwise(flipped))
    keyed = keyed.withColumn("center_key", F.array_join(F.transform("center", lambda s: oriented(s["block_id"], s["fwd"])), "~"))
    last = keyed.groupBy("graph_id", "edge", "path_id").agg(F.max(F.struct("idx", "natural", "center", "center_key", "left", "right")).alias("j"))
    return last.select("graph_id", "edge", "path_id", "j.idx", "j.natural", "j.center", "j.center_key", "j.left", "j.right")


def refused_graphs(walks: DataFrame, core: DataFrame) -> DataFrame:
    """graph, fewest: graphs that have no junctions because a path of theirs holds fewer than two core blocks, and the least number."""
    marks = core.select("graph_id", "block_id", F.lit(1).alias("is_core"))
    held = walks.join(marks, ["graph_id", "block_id"], "left").groupBy("graph_id", "path_id").agg(F.count("is_core").alias("n_core"))
    return held.groupBy("graph_id").agg(F.min("n_core").alias("fewest")).where("fewest < 2")


def junction_stats(js: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per edge (A12): isolates, non-empty ones, categories, majority, flags, flank and accessory lengths."""
    per_category = js.groupBy("graph_id", "edge", "center_key").agg(F.count("*").alias("n"))
    stats = per_category.groupBy("graph_id", "edge").agg(
        F.sum("n").alias("n_isolates"),
        F.sum(F.when(F.col("center_key") != "", F.col("n")).otherwise(0)).alias("n_non_empty"),
        F.count("*").alias("n_categories"),
        F.max("n").alias("n_majority_category"),
    )
    # the parts of an edge's text: ids hold no underscore followed by another
    part = lambda i: F.regexp_replace(F.element_at(F.split("edge", "__"), i), "_[fr]$", "")
    stats = stats.withColumns({"left_block": part(1), "right_block": part(2)})
    length = lambda side: lengths.select("graph_id", F.col("block_id").alias(f"{side}_block"), F.col("len").alias(f"{side}_core_length"))
    accessory = (
        js.select("graph_id", "edge", F.explode("center.block_id").alias("block_id"))
        .distinct()
        .join(lengths, ["graph_id", "block_id"])
        .groupBy("graph_id", "edge")
        .agg(F.sum("len").alias("accessory_length"))
    )
    joined = (
        stats.join(length("left"), ["graph_id", "left_block"])
        .join(length("right"), ["graph_id", "right_block"])
        .join(accessory, ["graph_id", "edge"], "left")
    )
    return joined.select(
        "graph_id",
        "edge",
        "n_isolates",
        "n_non_empty",
        "n_categories",
        "n_majority_category",
        (F.col("n_categories") == 1).alias("is_transitive"),
        ((F.col("n_isolates") > 1) & (F.col("n_majority_category") == F.col("n_isolates") - 1)).alias("is_singleton"),
        "left_core_length",
        "right_core_length",
        F.coalesce("accessory_length", F.lit(0)).alias("accessory_length"),
    )


def junction_positions(js: DataFrame, walks: DataFrame) -> DataFrame:
    """Positions of both flanks of each junction in the order of the path, and its direction (Q13)."""
    place = walks.groupBy("graph_id", "path_id", "block_id").agg(F.max(F.struct("ord", "pos_start", "pos_end")).alias("p"))
    side = lambda s: place.select(
        "graph_id", "path_id", F.col("block_id").alias(f"{s}_block"), F.col("p.pos_start").alias(f"{s}_start"), F.col("p.pos_end").alias(f"{s}_end")
    )
    keyed = js.select("graph_id", "edge", "path_id", "natural", F.col("left.block_id").alias("left_block"), F.col("right.block_id").alias("right_block"))
    return (
        keyed.join(side("left"), ["graph_id", "path_id", "left_block"])
        .join(side("right"), ["graph_id", "path_id", "right_block"])
        .select("graph_id", "edge", "path_id", "left_start", "left_end", "right_start", "right_end", F.col("natural").alias("strand"))
    )


def junction_sequences(js: DataFrame, sequences: DataFrame, walks: DataFrame) -> DataFrame:
    """Spanning sequence of each junction, flanks included, in the direction of its edge (Q14).

    ``sequences`` has (node_id, seq) of nodes read forward along their block. Nodes are found by
    path and place, so only those of the junction's own stretch are joined.
    """
    from strandloom.functions.seq import reverse_complement

    core_of = js.select("graph_id", "path_id", "edge", "natural", F.col("left.block_id").alias("lb"), F.col("right.block_id").alias("rb"))
    n = F.count("*").over(Window.partitionBy("graph_id", "path_id"))
    dense = F.row_number().over(along_path()) - 1
    pos = walks.select("graph_id", "path_id", dense.alias("ord"), "block_id", "fwd", "node_id", n.alias("n"))
    first = pos.select("graph_id", "path_id", F.col("block_id").alias("lb"), F.col("ord").alias("lo"))
    last = pos.select("graph_id", "path_id", F.col("block_id").alias("rb"), F.col("ord").alias("ro"), "n")
    ends = core_of.join(first, ["graph_id", "path_id", "lb"]).join(last, ["graph_id", "path_id", "rb"])
    span = F.when(F.col("ro") >= F.col("lo"), F.col("ro") - F.col("lo")).otherwise(F.col("ro") - F.col("lo") + F.col("n"))
    places = ends.select("graph_id", "path_id", "edge", "natural", F.posexplode(F.transform(F.sequence(F.lit(0), span), lambda i: F.pmod(F.col("lo") + i, F.col("n")))).alias("at", "ord"))
    read = places.join(pos.select("graph_id", "path_id", "ord", "node_id", "fwd"), ["graph_id", "path_id", "ord"]).join(sequences.select("node_id", "seq"), "node_id")
    forward = F.col("fwd") == F.col("natural")
    part = F.when(forward, F.col("seq")).otherwise(reverse_complement(F.col("seq")))
    at = F.when(F.col("natural"), F.col("at")).otherwise(-F.col("at"))
    joined = read.groupBy("graph_id", "edge", "path_id").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), part.alias("part")))).alias("parts"))
    return joined.select("graph_id", "edge", "path_id", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("seq"))


def consensus_edges(walks: DataFrame, core: DataFrame) -> DataFrame:
    """Edges of core walks that more than half of the isolates take."""
    from strandloom.operators.walks import filter_walks, steps

    edges = text_canonical(steps(filter_walks(walks, core), wrap_single=False)).select("graph_id", "path_id", "edge").distinct()
    n = walks.groupBy("graph_id").agg(F.countDistinct("path_id").alias("n"))
    counted = edges.groupBy("graph_id", "edge").agg(F.count("*").alias("n_isolates")).join(n, "graph_id")
    return counted.where(F.col("n_isolates") > F.col("n") / 2).select("graph_id", "edge", "n_isolates")


def context_links(js: DataFrame, scaffold: DataFrame, stats: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Segments and links of the junction-context graph over the chosen edges.

    ``scaffold`` has (graph_id, edge): consensus edges, all edges, or those of one isolate. Junctions
    are labelled J0, J1, ... in the order of their edges; an accessory block is a segment of its
    junction. Segments: graph_id, segment, depth; links: graph_id, left, right, distinct. Given the
    block statistics, the core blocks of the edges are segments too, with their depth in the whole graph.
    """
    chosen = js.join(scaffold.select("graph_id", "edge").distinct(), ["graph_id", "edge"], "left_semi")
    labels = chosen.select("graph_id", "edge").distinct()
    labels = labels.withColumn("label", F.concat(F.lit("J"), F.row_number().over(Window.partitionBy("graph_id").orderBy("edge")) - 1))
    labelled = chosen.join(labels, ["graph_id", "edge"])
    ends = F.split("edge", "__")
    side = lambda i: F.struct(F.regexp_replace(ends[i], "_[fr]$", "").alias("segment"), ends[i].endswith("_f").alias("fwd"))
    inner = F.transform("center", lambda s: F.struct(F.concat_ws("_", F.col("label"), s["block_id"]).alias("segment"), s["fwd"].alias("fwd")))
    full = labelled.withColumn("steps", F.concat(F.array(side(0)), inner, F.array(side(1))))
    segments = full.select("graph_id", F.explode(inner).alias("s")).groupBy("graph_id", F.col("s.segment").alias("segment")).agg(F.count("*").alias("depth"))
    if stats is not None:
        ends_of = full.select("graph_id", F.explode(F.array(side(0)["segment"], side(1)["segment"])).alias("block_id")).distinct()
        core = ends_of.join(stats.select("graph_id", "block_id", F.col("count").alias("depth")), ["graph_id", "block_id"])
        segments = segments.unionByName(core.select("graph_id", F.col("block_id").alias("segment"), "depth"))
    links = full.select(
        "graph_id", F.explode(F.arrays_zip(F.slice("steps", 1, F.size("steps") - 1).alias("a"), F.slice("steps", 2, F.size("steps")).alias("b"))).alias("z")
    ).select("graph_id", F.col("z.a").alias("left"), F.col("z.b").alias("right")).distinct()
    return segments, links

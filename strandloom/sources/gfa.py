"""GFA text of graphs (K6-K8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.junctions import context_links
from strandloom.operators.stats import block_stats
from strandloom.operators.walks import filter_walks, graph_links
from strandloom.tables import Graphs, id_number


def segments(g: Graphs) -> DataFrame:
    """Depth, length and the duplicated mark of every block, from the whole graph."""
    return block_stats(g).select("graph_id", "block_id", F.col("count").alias("depth"), "len", "duplicated")


def filtered(g: Graphs, min_len: int = 0, max_len: int | None = None, min_depth: int = 0, max_depth: int | None = None, no_duplicated: bool = False) -> tuple[DataFrame, DataFrame]:
    """(segments, walks) that pass the bounds, which are inclusive: walks are filtered first, segments are those still walked (K7)."""
    s = segments(g)
    keep = (F.col("len") >= min_len) & (F.col("depth") >= min_depth)
    if max_len is not None:
        keep &= F.col("len") <= max_len
    if max_depth is not None:
        keep &= F.col("depth") <= max_depth
    if no_duplicated:
        keep &= ~F.col("duplicated")
    kept = s.where(keep)
    walks = filter_walks(g.walks, kept)
    used = walks.select("graph_id", "block_id").distinct()
    return kept.join(used, ["graph_id", "block_id"]), walks


def gfa_lines(g: Graphs, sequences: bool = True, **bounds) -> DataFrame:
    """graph_id, section, rank, value: all lines of each graph's GFA; sections 0 header, 1 S, 2 L, 3 P.

    Comment lines head the sections that aren't empty. Links are counted over the filtered walks.
    """
    segs, walks = filtered(g, **bounds)
    consensus = g.blocks.select("graph_id", "block_id", "consensus")
    sign = lambda c: F.when(c, "+").otherwise("-")
    n = id_number
    s = segs.join(consensus, ["graph_id", "block_id"]).select(
        "graph_id", F.lit(1).alias("section"), F.struct(n("block_id").alias("a"), F.lit(None).cast("decimal(20,0)").alias("b"), F.lit("").alias("t")).alias("rank"),
        F.concat_ws("\t", F.lit("S"), "block_id", F.col("consensus") if sequences else F.lit("*"), F.format_string("RC:i:%d", F.col("depth") * F.col("len")),
                    F.format_string("LN:i:%d", "len"), F.when(F.col("duplicated"), "TP:Z:duplicated")).alias("value"),
    )
    # forward sorts before reverse, as '+' does before '-'
    links = graph_links(walks).select(
        "graph_id", F.lit(2).alias("section"), F.struct(n("block_1").alias("a"), n("block_2").alias("b"), F.concat(sign(F.col("fwd_1")), sign(F.col("fwd_2"))).alias("t")).alias("rank"),
        F.concat_ws("\t", F.lit("L"), "block_1", sign(F.col("fwd_1")), "block_2", sign(F.col("fwd_2")), F.lit("*"), F.format_string("RC:i:%d", "count")).alias("value"),
    )
    steps = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat("block_id", sign(F.col("fwd"))).alias("s")))), lambda x: x["s"]), ",")
    p = walks.groupBy("graph_id", "path_id").agg(steps.alias("steps")).join(g.paths.select("path_id", "path_name", "circular"), "path_id").select(
        "graph_id", F.lit(3).alias("section"), F.struct(n("path_id").alias("a"), F.lit(None).cast("decimal(20,0)").alias("b"), F.lit("").alias("t")).alias("rank"),
        F.concat_ws("\t", F.lit("P"), F.coalesce("path_name", "path_id"), "steps", F.lit("*"), F.when(F.col("circular"), "TP:Z:circular")).alias("value"),
    )
    body = s.unionByName(links).unionByName(p)
    title = F.when(F.col("section") == 1, "# blocks").when(F.col("section") == 2, "# edges").otherwise("# paths")
    least = lambda section: F.struct(F.lit(-1).cast("decimal(20,0)").alias("a"), F.lit(None).cast("decimal(20,0)").alias("b"), F.lit("").alias("t"))
    comments = body.select("graph_id", "section").distinct().select("graph_id", "section", least(1).alias("rank"), title.alias("value"))
    header = g.paths.select("graph_id").distinct().select("graph_id", F.lit(0).alias("section"), least(0).alias("rank"), F.lit("H\tVN:Z:1.0").alias("value"))
    return body.unionByName(comments).unionByName(header)


def write_gfa(g: Graphs, path: str, **options) -> None:
    """One folder per graph, its lines in order; the graphs are written side by side."""
    lines = gfa_lines(g, **options).repartition("graph_id").sortWithinPartitions("graph_id", "section", "rank")
    lines.select("graph_id", "value").write.mode("overwrite").partitionBy("graph_id").text(path)


def minimal_gfa_lines(segs: DataFrame, links: DataFrame, length: Column | None = None) -> DataFrame:
    """section, value: GFA without sequences of a (segment, len[, depth]) and a (left, right) table (K8), graph by graph if they have a graph_id.

    ``length`` is any expression of ``len``; what it gives is rounded and at least 1.
    """
    size = F.greatest(F.lit(1), F.round(length if length is not None else F.col("len")).cast("bigint"))
    depth = [F.format_string("DP:f:%s", F.col("depth").cast("double").cast("string"))] if "depth" in segs.columns else []
    keep = ["graph_id"] if "graph_id" in segs.columns else []
    s = segs.select(*keep, F.lit(1).alias("section"), F.concat_ws("\t", F.lit("S"), "segment", F.lit("*"), F.format_string("LN:i:%d", size), *depth).alias("value"))
    sign = lambda c: F.when(c, "+").otherwise("-")
    side = lambda c: [F.col(f"{c}.segment"), sign(F.col(f"{c}.fwd"))]
    lk = links.select(*keep, F.lit(2).alias("section"), F.concat_ws("\t", F.lit("L"), *side("left"), *side("right"), F.lit("0M")).alias("value"))
    header = segs.select(*keep).distinct() if keep else segs.sparkSession.range(1)
    return header.select(*keep, F.lit(0).alias("section"), F.lit("H\tVN:Z:1.0").alias("value")).unionByName(s).unionByName(lk)


def context_lines(js: DataFrame, stats: DataFrame, scaffold: DataFrame | None = None) -> DataFrame:
    """graph_id, section, value: the junction-context graph of every graph as GFA (Q15).

    Segments are the accessory blocks of each junction and the core blocks at their ends, with their
    lengths and depths; links join what stands next to each other. ``scaffold`` restricts the edges.
    """
    segs, links = context_links(js, js if scaffold is None else scaffold, stats)
    block = F.regexp_replace("segment", "^J[0-9]+_", "")
    sized = segs.withColumn("block_id", block).join(stats.select("graph_id", "block_id", "len"), ["graph_id", "block_id"])
    return minimal_gfa_lines(sized.select("graph_id", "segment", "len", "depth"), links)

"""Counts and statistics of blocks and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.session import cut_lineage
from strandloom.tables import Graphs


def block_depth(g: Graphs) -> DataFrame:
    """Number of nodes of each block (A1)."""
    return g.walks.groupBy("graph_id", "block_id").agg(F.count("*").alias("depth"))


def block_stats(g: Graphs) -> DataFrame:
    """Count, strains, duplicated, core and length of each block.

    A block is duplicated if some path holds it twice; it is core if it is not and all paths that
    have nodes hold it. Two aggregation levels instead of count distinct: the first one, by path,
    is combined on the map side and spreads a frequent block over as many keys as it has paths.
    """
    return stats_with_paths(g).drop("n_paths")


def stats_with_paths(g: Graphs) -> DataFrame:
    """The same with ``n_paths``, the number of paths of the graph that have nodes."""
    per_path = g.walks.groupBy("graph_id", "block_id", "path_id").agg(F.count("*").alias("n"))
    stats = per_path.groupBy("graph_id", "block_id").agg(F.sum("n").alias("count"), F.count("*").alias("n_strains"))
    strains = g.walks.select("graph_id", "path_id").distinct().groupBy("graph_id").agg(F.count("*").alias("n_paths"))
    stats = stats.join(strains, "graph_id").withColumn("duplicated", F.col("count") > F.col("n_strains"))
    stats = stats.withColumn("core", ~F.col("duplicated") & (F.col("n_strains") == F.col("n_paths")))
    return stats.join(g.block_lengths, ["graph_id", "block_id"]).select(
        "graph_id", "block_id", "count", "n_strains", "duplicated", "core", "len", "n_paths"
    )


def strict_core(g: Graphs) -> DataFrame:
    """Blocks that every path of the graph holds exactly once, paths without nodes included."""
    per_path = g.walks.groupBy("graph_id", "block_id", "path_id").agg(F.count("*").alias("n"))
    stats = per_path.groupBy("graph_id", "block_id").agg(F.sum("n").alias("count"), F.count("*").alias("n_strains"))
    total = g.paths.groupBy("graph_id").agg(F.count("*").alias("n_paths"))
    return stats.join(total, "graph_id").where(
        (F.col("n_strains") == F.col("n_paths")) & (F.col("count") == F.col("n_paths"))
    ).select("graph_id", "block_id")


def block_counts(g: Graphs) -> DataFrame:
    """Block by path counts in long form (A4, Q2)."""
    return g.walks.groupBy("graph_id", "block_id", "path_id").agg(F.count("*").alias("count"))


def block_count_matrix(g: Graphs, graph_id: int) -> DataFrame:
    """The wide form of one graph: a column per path name, 0 where the block is absent."""
    named = block_counts(g).where(F.col("graph_id") == graph_id).join(g.paths.select("path_id", "path_name"), "path_id")
    names = [r[0] for r in g.paths.where((F.col("graph_id") == graph_id) & F.col("path_name").isNotNull()).select("path_name").distinct().orderBy("path_name").collect()]
    return named.groupBy("block_id").pivot("path_name", names).agg(F.sum("count")).na.fill(0)


def pairwise_content(g: Graphs) -> DataFrame:
    """Shared and different base pairs of every ordered pair of paths of a graph.

    Shared lengths come from a join of presences on the block; the difference is what both hold
    less twice the shared. Paths that share nothing, and a path with itself, are pairs as well.
    """
    held = cut_lineage(g.walks.select("graph_id", "path_id", "block_id").distinct().join(g.block_lengths, ["graph_id", "block_id"]))
    total = held.groupBy("graph_id", "path_id").agg(F.sum("len").alias("total"))
    a = held.select("graph_id", "block_id", F.col("path_id").alias("path_i"), "len")
    b = held.select("graph_id", "block_id", F.col("path_id").alias("path_j"))
    shared = a.join(b, ["graph_id", "block_id"]).groupBy("graph_id", "path_i", "path_j").agg(F.sum("len").alias("shared"))
    pairs = total.select("graph_id", F.col("path_id").alias("path_i"), F.col("total").alias("total_i")).join(
        total.select("graph_id", F.col("path_id").alias("path_j"), F.col("total").alias("total_j")), "graph_id"
    )
    pairs = pairs.join(shared, ["graph_id", "path_i", "path_j"], "left").na.fill(0, ["shared"])
    return pairs.select(
        "graph_id", "path_i", "path_j", "shared", (F.col("total_i") + F.col("total_j") - 2 * F.col("shared")).alias("diff")
    )


def pangenome_size(g: Graphs) -> DataFrame:
    """Blocks, total and core length of each graph (Q8)."""
    s = block_stats(g)
    return s.groupBy("graph_id").agg(
        F.count("*").alias("n_blocks"),
        F.sum("len").alias("pangenome_len"),
        F.coalesce(F.sum(F.when(F.col("core"), F.col("len"))), F.lit(0)).alias("core_len"),
        F.count(F.when(F.col("core"), 1)).alias("n_core"),
    )


def frequency_spectrum(g: Graphs) -> DataFrame:
    """Length and number of blocks by the number of strains that hold them (Q8)."""
    return block_stats(g).groupBy("graph_id", "n_strains").agg(F.sum("len").alias("len"), F.count("*").alias("n_blocks"))


def strains(g: Graphs) -> DataFrame:
    """Names of the paths (Q1)."""
    return g.paths.select("graph_id", "path_id", "path_name")


def path_dictionary(g: Graphs) -> DataFrame:
    """The walk of each path as an ordered array of (block, strand) (Q4)."""
    steps = F.collect_list(F.struct("ord", "block_id", "fwd"))
    return g.walks.groupBy("graph_id", "path_id").agg(
        F.transform(F.array_sort(steps), lambda s: F.struct(s["block_id"].alias("block_id"), s["fwd"].alias("fwd"))).alias("walk")
    )


def duplicate_names(g: Graphs) -> DataFrame:
    """Path names that a graph uses more than once."""
    named = g.paths.where(F.col("path_name").isNotNull())
    return named.groupBy("graph_id", "path_name").agg(F.count("*").alias("n")).where("n > 1")


def project(g: Graphs, names: list[str] | DataFrame) -> DataFrame:
    """Paths with one of the names, a list or a table of path_name; unknown names are ignored, unnamed paths are left out (F8)."""
    named = g.paths.where(F.col("path_name").isin(names)) if isinstance(names, list) else g.paths.join(names, "path_name", "left_semi")
    return named.select("graph_id", "path_id", "path_name")


def longest_block(g: Graphs) -> DataFrame:
    """The longest block of each graph; ties: the least id."""
    order = Window.partitionBy("graph_id").orderBy(F.col("len").desc(), "block_id")
    return g.block_lengths.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")

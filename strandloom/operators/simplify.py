"""Transitive edges contracted set at a time; graphs restricted to some paths.

Transitive edges give every end of a block at most one neighbour, so they form chains and cycles.
Oriented blocks are ranked along their chain by pointer jumping (log n rounds for a chain of n), a
cycle is cut before its least block, and each chain is put together at once: the chain is read in
the direction in which its longest block (ties: the least id) is forward, and keeps that block's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.edits import reverse_edit, shift_edit
from strandloom.functions.seq import reverse_complement
from strandloom.operators.components import connected_components
from strandloom.operators.walks import along_path, transitive_edges
from strandloom.session import cut_lineage
from strandloom.tables import EDIT_TYPE, EDIT_TYPES, Graphs


def chains(g: Graphs, edges: DataFrame) -> DataFrame:
    """graph, block, chain (its anchor block), place from 0, fwd (direction of the block in the chain)."""
    e = edges.select("graph_id", "block_1", "fwd_1", "block_2", "fwd_2")
    blocks = e.select("graph_id", F.col("block_1").alias("vertex")).unionByName(e.select("graph_id", F.col("block_2").alias("vertex"))).distinct()
    parts = connected_components(blocks, e.select("graph_id", F.col("block_1").alias("a"), F.col("block_2").alias("b")), ["graph_id"])
    parts = parts.select("graph_id", F.col("vertex").alias("block_id"), "component")
    node = lambda b, f: F.struct(F.col(b).alias("block_id"), f.alias("fwd"))
    arcs = e.select("graph_id", node("block_1", F.col("fwd_1")).alias("x"), node("block_2", F.col("fwd_2")).alias("y")).unionByName(
        e.select("graph_id", node("block_2", ~F.col("fwd_2")).alias("x"), node("block_1", ~F.col("fwd_1")).alias("y"))
    ).distinct()
    nodes = parts.select("graph_id", "component", F.explode(F.array(node("block_id", F.lit(True)), node("block_id", F.lit(False)))).alias("x"))
    linked = nodes.join(arcs, ["graph_id", "x"], "left")
    # a component all of whose ends have a next one is a cycle: it is cut before its least block
    whole = linked.groupBy("graph_id", "component").agg((F.count("y") == F.count("*")).alias("cycle"))
    linked = linked.join(whole, ["graph_id", "component"])
    least = F.col("component")
    cut = F.col("cycle") & (((F.col("y.block_id") == least) & F.col("y.fwd")) | ((F.col("x.block_id") == least) & ~F.col("x.fwd")))
    linked = linked.select("graph_id", "component", "x", F.when(~cut, F.col("y")).alias("nxt"))
    ranked = cut_lineage(linked.withColumns({"end": F.coalesce("nxt", "x"), "rank": F.when(F.col("nxt").isNotNull(), 1).otherwise(0)}))
    for _ in range(64):  # ranks double: 2^64 blocks
        hop = ranked.select("graph_id", F.col("x").alias("nxt"), F.col("nxt").alias("further"), F.col("end").alias("far_end"), F.col("rank").alias("more"))
        ranked = cut_lineage(
            ranked.join(hop, ["graph_id", "nxt"], "left").select(
                "graph_id", "component", "x", F.col("further").alias("nxt"), F.coalesce("far_end", "end").alias("end"), (F.col("rank") + F.coalesce("more", F.lit(0))).alias("rank")
            )
        )
        if not ranked.where(F.col("nxt").isNotNull()).limit(1).count():
            break
    else:
        raise RuntimeError("a chain has no end")
    # each component is ranked twice, once in each direction; the direction of its anchor decides
    sized = ranked.select("graph_id", "component", "end", "rank", F.col("x.block_id").alias("block_id"), F.col("x.fwd").alias("fwd")).join(g.block_lengths, ["graph_id", "block_id"])
    # structs order by length, then by the least id: ids are compared as numbers in reverse
    best = sized.groupBy("graph_id", "component").agg(F.max_by("block_id", F.struct("len", -F.col("block_id").cast("decimal(20,0)"))).alias("chain"))
    sized = sized.join(best, ["graph_id", "component"])
    right = sized.where((F.col("block_id") == F.col("chain")) & F.col("fwd")).select("graph_id", "component", "end")
    kept = sized.join(right, ["graph_id", "component", "end"])
    place = F.max("rank").over(Window.partitionBy("graph_id", "component")) - F.col("rank")
    return kept.select("graph_id", "block_id", "chain", place.alias("place"), "fwd", "len")


def contract(g: Graphs) -> Graphs:
    """The graph with all transitive edges contracted; reconstructed genomes stay the same.

    A node without an Edit, whose letters are unknown, is a deletion in the node that it becomes part of.
    """
    edges = cut_lineage(transitive_edges(g.walks))
    if edges.isEmpty():
        return g
    ch = cut_lineage(chains(g, edges))
    before = Window.partitionBy("graph_id", "chain").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    ch = ch.withColumn("offset", F.coalesce(F.sum("len").over(before), F.lit(0)).cast("int"))
    key = ["graph_id", "block_id"]
    # consensus
    piece = F.when(F.col("fwd"), F.col("consensus")).otherwise(reverse_complement(F.col("consensus")))
    joined = g.blocks.select(*key, "consensus").join(ch, key).groupBy("graph_id", F.col("chain").alias("block_id")).agg(F.array_sort(F.collect_list(F.struct("place", piece.alias("piece")))).alias("p"))
    merged = joined.select("graph_id", "block_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("consensus"))
    blocks = g.blocks.select(*key, "consensus").join(ch.select(*key), key, "left_anti").unionByName(merged)
    # occurrences: steps of one passage along a chain differ from their place by the same number
    n = F.count("*").over(Window.partitionBy("graph_id", "path_id"))
    steps = g.walks.withColumn("ord", F.row_number().over(along_path()) - 1).withColumn("n", n)
    on = steps.join(ch.select(*key, "chain", "place", "offset", F.col("fwd").alias("chain_fwd"), "len"), key)
    along = F.col("fwd") == F.col("chain_fwd")
    passage = F.when(along, F.pmod(F.col("ord") - F.col("place"), F.col("n"))).otherwise(F.pmod(F.col("ord") + F.col("place"), F.col("n")))
    on = on.withColumns({"along": along, "passage": passage})
    by = ["graph_id", "path_id", "chain", "along", "passage"]
    is_anchor = F.col("block_id") == F.col("chain")
    firsts = on.groupBy(*by).agg(
        F.max(F.when(is_anchor, F.col("node_id"))).alias("new_node"),
        F.max(F.when(is_anchor, F.col("ord"))).alias("new_ord"),
        F.min(F.struct("place", "pos_start", "pos_end")).alias("low"),
        F.max(F.struct("place", "pos_start", "pos_end")).alias("high"),
    )
    firsts = firsts.withColumns(
        {
            "pos_start": F.when(F.col("along"), F.col("low.pos_start")).otherwise(F.col("high.pos_start")),
            "pos_end": F.when(F.col("along"), F.col("high.pos_end")).otherwise(F.col("low.pos_end")),
        }
    )
    firsts = cut_lineage(firsts.select(*by, "new_node", "new_ord", "pos_start", "pos_end"))
    # edits
    members = on.select(*by, "node_id", "offset", "chain_fwd", "place", "len").join(firsts.select(*by, "new_node"), by)
    al = members.select("graph_id", "node_id", "new_node", F.col("chain").alias("__chain"), "offset", "chain_fwd", "place", "len").join(g.alignments.select("node_id", "edit"), "node_id", "left")
    # a node without an Edit has no letters: it is a gap beside others, and stays without if all of them are
    gap = F.struct(
        F.array().cast(EDIT_TYPES["subs"]).alias("subs"), F.array(F.struct(F.lit(0).alias("pos"), F.col("len").alias("len"))).cast(EDIT_TYPES["dels"]).alias("dels"), F.array().cast(EDIT_TYPES["inss"]).alias("inss")
    ).cast(EDIT_TYPE)
    al = al.withColumns({"known": F.col("edit").isNotNull(), "edit": F.coalesce(F.col("edit").cast(EDIT_TYPE), gap)})
    turned = F.when(F.col("chain_fwd"), F.col("edit")).otherwise(reverse_edit(F.col("len"), F.col("edit")))
    moved = al.withColumn("turned", turned).withColumn("moved", shift_edit(F.col("turned"), F.col("offset")))
    gathered = moved.groupBy("graph_id", F.col("__chain").alias("block_id"), F.col("new_node").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("place", "moved"))).alias("m"), F.max("known").alias("known")).where("known")
    flat = lambda k: F.flatten(F.transform("m", lambda x: x["moved"][k]))
    # insertions that meet at a border are one, in chain order
    inss = F.aggregate(
        flat("inss"), F.array().cast(EDIT_TYPES["inss"]),
        lambda a, x: F.when(
            F.size(a) > 0,
            F.when(F.element_at(F.concat(F.array(F.struct(F.lit(-1).alias("pos"), F.lit("").alias("seq"))), a), -1)["pos"] == x["pos"],
                   F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(x["pos"].alias("pos"), F.concat(F.element_at(F.concat(F.array(F.struct(F.lit(-1).alias("pos"), F.lit("").alias("seq"))), a), -1)["seq"], x["seq"]).alias("seq")))))
            .otherwise(F.concat(a, F.array(x)))
        ).otherwise(F.array(x)).cast(EDIT_TYPES["inss"]),
    )
    new_edits = gathered.select("graph_id", "block_id", "node_id", F.struct(flat("subs").alias("subs"), flat("dels").alias("dels"), inss.alias("inss")).alias("edit"))
    old = g.alignments.join(ch.select(*key), key, "left_anti").select("graph_id", "block_id", "node_id", "edit")
    same_type = lambda df: df.select("graph_id", "block_id", "node_id", F.col("edit").cast(EDIT_TYPE).alias("edit"))
    edits = same_type(old).unionByName(same_type(new_edits))
    # nodes and walks
    gone = members.select("node_id").distinct()
    new_nodes = firsts.select(F.col("new_node").alias("node_id"), "graph_id", F.col("chain").alias("block_id"), "path_id", F.when(F.col("along"), "+").otherwise("-").alias("strand"), "pos_start", "pos_end")
    nodes = g.nodes.join(gone, "node_id", "left_anti").unionByName(new_nodes)
    kept = steps.select("graph_id", "path_id", "ord", "node_id").join(gone, "node_id", "left_anti").unionByName(firsts.select("graph_id", "path_id", F.col("new_ord").alias("ord"), F.col("new_node").alias("node_id")))
    lists = kept.groupBy("graph_id", "path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id"))), lambda x: x["node_id"]).alias("nodes"))
    paths = g.paths.drop("nodes").join(lists, ["graph_id", "path_id"], "left").withColumn("nodes", F.coalesce("nodes", F.array().cast("array<string>")))
    return bundle(nodes, paths, blocks, edits)


def bundle(nodes: DataFrame, paths: DataFrame, blocks: DataFrame, edits: DataFrame) -> Graphs:
    """Graphs of parts that are already clean; each part is stored once."""
    nodes, blocks, edits = cut_lineage(nodes), cut_lineage(blocks.select("graph_id", "block_id", "consensus")), cut_lineage(edits)
    paths = cut_lineage(paths.select("path_id", "graph_id", "nodes", "tot_len", "circular", "path_name", "descr"))
    g = Graphs(nodes, paths.withColumn("loaded_at", F.lit(None).cast("timestamp_ntz")), blocks)
    g.__dict__["nodes"], g.__dict__["paths"] = nodes, paths
    g.__dict__["alignments"] = edits.join(blocks, ["graph_id", "block_id"]).select("graph_id", "block_id", "node_id", "consensus", "edit")
    return g


def keep_paths(g: Graphs, paths: DataFrame) -> Graphs:
    """The graph of some paths only: nodes, edits and emptied blocks of the others are gone."""
    kept = g.paths.join(paths.select("path_id").distinct(), "path_id", "left_semi")
    nodes = g.nodes.join(kept.select("path_id"), "path_id", "left_semi")
    edits = g.alignments.join(nodes.select("node_id"), "node_id", "left_semi").select("graph_id", "block_id", "node_id", "edit")
    blocks = g.blocks.join(nodes.select("graph_id", "block_id").distinct(), ["graph_id", "block_id"], "left_semi")
    return bundle(nodes.select("node_id", "graph_id", "block_id", "path_id", "strand", "pos_start", "pos_end"), kept, blocks, edits)


def simplify(g: Graphs, names: list[str]) -> Graphs:
    """The graph of the named paths with transitive edges contracted."""
    return contract(keep_paths(g, g.paths.where(F.col("path_name").isin(names))))

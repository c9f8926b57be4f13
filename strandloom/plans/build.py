"""Graphs built from genomes: guide tree, merge waves, self-merge passes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from strandloom.functions.edits import apply_edit, is_empty, is_unaligned, new_position, node_interval, reconcile_substitution, slice_edit
from strandloom.functions.seq import content_id, reverse_complement
from strandloom.operators import tree as tr
from strandloom.operators.align import ATTEMPTS, EXTRA_BAND, apply, mean_shift, realign
from strandloom.operators.consensus import new_consensus
from strandloom.operators.matches import anchors, block_intervals, candidates, greedy, hits_of_blocks, refine_intervals, split_matches
from strandloom.operators.matching import find_matches
from strandloom.operators.sequences import compare_genomes, reconstruct
from strandloom.operators.simplify import bundle, contract
from strandloom.operators.sketch import sketch, sketch_distances
from strandloom.session import cut_lineage, ship
from strandloom.tables import EDIT_TYPE, Graphs


@dataclass
class Options:
    """Parameters of a build and their defaults."""

    length: int = 100
    alpha: float = 100.0
    beta: float = 10.0
    sensitivity: str = "10"
    circular: bool = False
    max_self_map: int = 100
    guide_tree: str | None = None
    verify: bool = False
    word: int | None = None
    extra_band: int = EXTRA_BAND
    attempts: int = ATTEMPTS


def singletons(records: DataFrame, circular: bool) -> Graphs:
    """One graph per record: one block, one node, one path (G1)."""
    r = records.select(F.col("rec_index").cast("bigint").alias("graph_id"), F.col("rec_index").cast("string").alias("id"), "seq_name", "descr", F.upper("seq").alias("seq"))
    end = F.lit(0).cast("bigint") if circular else F.length("seq").cast("bigint")
    nodes = r.select(F.col("id").alias("node_id"), "graph_id", F.col("id").alias("block_id"), F.col("id").alias("path_id"), F.lit("+").alias("strand"), F.lit(0).cast("bigint").alias("pos_start"), end.alias("pos_end"))
    paths = r.select(
        F.col("id").alias("path_id"), "graph_id", F.array("id").alias("nodes"), F.length("seq").cast("bigint").alias("tot_len"), F.lit(circular).alias("circular"), F.col("seq_name").alias("path_name"), "descr"
    )
    blocks = r.select("graph_id", F.col("id").alias("block_id"), F.col("seq").alias("consensus"))
    empty = F.struct(*[F.array().cast(t).alias(k) for k, t in (("subs", "array<struct<pos:int,alt:string>>"), ("dels", "array<struct<pos:int,len:int>>"), ("inss", "array<struct<pos:int,seq:string>>"))])
    edits = r.select("graph_id", F.col("id").alias("block_id"), F.col("id").alias("node_id"), empty.alias("edit"))
    return bundle(nodes, paths, blocks, edits)


#: Genomes up to which the guide tree is computed; its matrix has the square of their number, and it is joined in cubic time.
MOST_GENOMES = 3_000


def guide_tree(records: DataFrame, k: int = 15, w: int = 100) -> tr.Clade:
    """The neighbor-joining tree of sketch distances; leaves are record indexes. More genomes need a given tree."""
    names = [r[0] for r in records.select("rec_index").orderBy("rec_index").limit(MOST_GENOMES + 1).collect()]
    if len(names) > MOST_GENOMES:
        raise ValueError(f"more than {MOST_GENOMES} genomes: give a guide tree")
    pairs = sketch_distances(sketch(records, "rec_index", "seq", k, w), "rec_index")
    return tr.neighbor_joining(tr.distance_matrix(pairs, names), [str(n) for n in names])


def _remap(g: Graphs, mapping: dict[int, int]) -> Graphs:
    """Graphs renumbered, so that those with one number become one; their keys must be disjoint."""
    spark = g.blocks.sparkSession
    m = spark.createDataFrame(list(mapping.items()), "graph_id bigint, to bigint")
    move = lambda df: df.join(F.broadcast(m), "graph_id", "left").withColumn("graph_id", F.coalesce("to", "graph_id")).drop("to")
    nodes = move(g.nodes).select("node_id", "graph_id", "block_id", "path_id", "strand", "pos_start", "pos_end")
    return bundle(nodes, move(g.paths), move(g.blocks), move(g.alignments.select("graph_id", "block_id", "node_id", "edit")))


def assert_disjoint(g: Graphs) -> None:
    """An error where two merged graphs share an id."""
    for df, key in ((g.blocks, "block_id"), (g.nodes, "node_id"), (g.paths, "path_id")):
        twice = df.groupBy("graph_id", key).count().where("count > 1").head()
        if twice:
            raise ValueError(f"{key} {twice[key]} occurs in both graphs")


def accepted_matches(g: Graphs, o: Options) -> DataFrame:
    """Matches that a pass merges: found, divided at long indels, of negative energy, not overlapping."""
    found = find_matches(g.blocks, o.length, o.sensitivity, o.word)
    parts = split_matches(found, o.length)
    good = candidates(parts, o.alpha, o.beta)
    # names must tell blocks of different graphs apart
    named = good.withColumns({"q_name": F.concat_ws("|", "graph_id", "q_name"), "r_name": F.concat_ws("|", "graph_id", "r_name")})
    return cut_lineage(greedy(cut_lineage(named)))


def _realigned(rows: DataFrame, o: Options) -> DataFrame:
    """(graph, block, node, consensus, seq, band, expected) -> (graph, block, node, edit) by banded alignment.

    The band lies where the indels of the expected edit put it (X12); without one it is ``band`` wide on both sides.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("graph_id", pa.int64()), ("block_id", pa.string()), ("node_id", pa.string()),
             ("edit", pa.struct([("subs", pa.list_(pa.struct([("pos", pa.int32()), ("alt", pa.string())]))), ("dels", pa.list_(pa.struct([("pos", pa.int32()), ("len", pa.int32())]))),
                                 ("inss", pa.list_(pa.struct([("pos", pa.int32()), ("seq", pa.string())])))]))]
        )
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                n, shift, band = len(r["consensus"]), 0, max(r["band"], abs(len(r["consensus"]) - len(r["seq"])))
                if r["expected"]:
                    shift, band = mean_shift(n, [(d["pos"], d["len"]) for d in r["expected"]["dels"]], [(i["pos"], i["seq"]) for i in r["expected"]["inss"]])
                edit = realign(r["consensus"], r["seq"], shift, band, o.extra_band, o.attempts)
                if apply(r["consensus"], edit) != r["seq"]:
                    raise AssertionError(f"alignment of node {r['node_id']} doesn't give its sequence")
                out.append({"graph_id": r["graph_id"], "block_id": r["block_id"], "node_id": r["node_id"], "edit": edit})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    expected = F.col("expected") if "expected" in rows.columns else F.lit(None).cast(EDIT_TYPE)
    return rows.select("graph_id", "block_id", "node_id", "consensus", "seq", "band", expected.alias("expected")).mapInArrow(run, f"graph_id bigint, block_id string, node_id string, edit {EDIT_TYPE}")


def reweave(g: Graphs, matches: DataFrame, o: Options) -> Graphs:
    """The graph after the matches are merged: blocks sliced, halves joined, walks respelled."""
    key = F.concat_ws("|", "graph_id", "block_id")
    depth = g.alignments.groupBy("graph_id", "block_id").agg(F.count("*").alias("depth"))
    blocks = g.blocks.join(depth, ["graph_id", "block_id"], "left").select(key.alias("name"), F.coalesce("depth", F.lit(0)).alias("depth"), "consensus")
    hits = cut_lineage(hits_of_blocks(anchors(matches, blocks)))
    lengths = blocks.join(hits.select(F.col("block").alias("name")).distinct(), "name", "left_semi").select(F.col("name").alias("block"), F.length("consensus").alias("len"))
    refined = refine_intervals(block_intervals(hits.select("block", "start", "end"), lengths), o.length)
    marks = hits.withColumnRenamed("start", "hit_start").drop("end")
    iv = refined.withColumn("hit_start", F.when(F.col("aligned"), F.col("start") + F.col("extend_left"))).join(marks, ["block", "hit_start"], "left")
    gap = F.aggregate(F.filter("cigar", lambda c: c["op"].isin("I", "D")), F.lit(0), lambda a, c: a + c["len"])
    iv = cut_lineage(
        iv.select(
            F.split("block", r"\|")[0].cast("bigint").alias("graph_id"),
            F.split("block", r"\|")[1].alias("block_id"),
            "start",
            "end",
            F.coalesce("new_block", content_id(F.col("block"), F.col("start"), F.col("end"))).alias("new_block"),
            F.col("new_block").isNotNull().alias("merged"),
            F.coalesce("is_anchor", F.lit(True)).alias("is_anchor"),
            F.coalesce("forward", F.lit(True)).alias("forward"),
            (F.coalesce(gap, F.lit(0)) + F.col("extend_left") + F.col("extend_right")).cast("int").alias("band"),
        )
    )
    # slices: block x interval x node
    al = g.alignments.join(g.nodes.drop("block_id", "graph_id"), "node_id").join(g.paths.select("path_id", "tot_len", "circular"), "path_id")
    s = al.join(iv, ["graph_id", "block_id"])
    n = F.length("consensus")
    low, high = node_interval(F.col("edit"), F.col("start"), F.col("end"), n)
    fwd = F.coalesce(F.col("strand") == "+", F.lit(True))
    # a circular node that starts where it ends spans the whole path
    whole_end = F.when((F.col("pos_start") == F.col("pos_end")) & F.col("circular"), F.col("pos_start") + F.col("tot_len")).otherwise(F.col("pos_end"))
    ps, pe = new_position(F.col("pos_start"), whole_end, low.cast("bigint"), high.cast("bigint"), fwd, F.col("tot_len"), F.col("circular"))
    s = s.withColumns({"part": slice_edit(F.col("edit"), F.col("start"), F.col("end"), n), "cons": F.col("consensus").substr(F.col("start") + 1, F.col("end") - F.col("start")), "ps": ps, "pe": pe})
    s = s.where(~is_empty(F.length("cons"), F.col("part")))
    # the half that isn't the anchor is read in the anchor's direction
    keeps = F.col("is_anchor") | F.col("forward")
    strand = F.when(fwd == keeps, "+").otherwise("-")
    s = s.withColumns({"new_strand": strand, "new_node": content_id(F.col("new_block"), F.col("path_id"), strand, F.col("ps"), F.col("pe"), F.col("node_id")), "fwd": fwd, "keeps": keeps})
    s = cut_lineage(s.select("graph_id", "node_id", "path_id", "start", "new_block", "merged", "is_anchor", "keeps", "fwd", "band", "part", "cons", "ps", "pe", "new_strand", "new_node"))
    touched = iv.select("graph_id", "block_id").distinct()
    # consensus of new blocks: the anchor's slice
    new_blocks = g.blocks.select("graph_id", "block_id", "consensus").join(iv.where("is_anchor"), ["graph_id", "block_id"])
    new_blocks = new_blocks.select("graph_id", F.col("new_block").alias("block_id"), F.col("consensus").substr(F.col("start") + 1, F.col("end") - F.col("start")).alias("consensus"))
    blocks_all = cut_lineage(g.blocks.select("graph_id", "block_id", "consensus").join(touched, ["graph_id", "block_id"], "left_anti").unionByName(new_blocks))
    # edits: slices of anchors stay, the others are aligned to the anchor
    stay = s.where("is_anchor").select("graph_id", F.col("new_block").alias("block_id"), F.col("new_node").alias("node_id"), F.col("part").alias("edit"))
    own = apply_edit(F.col("cons"), F.col("part"))
    todo = s.where("not is_anchor").select("graph_id", F.col("new_block").alias("block_id"), F.col("new_node").alias("node_id"), F.when(F.col("keeps"), own).otherwise(reverse_complement(own)).alias("seq"), "band")
    solved = _realigned(todo.join(blocks_all, ["graph_id", "block_id"]), o)
    cast = lambda df: df.select("graph_id", "block_id", "node_id", F.col("edit").cast(EDIT_TYPE).alias("edit"))
    old = g.alignments.join(touched, ["graph_id", "block_id"], "left_anti")
    edits = cast(old).unionByName(cast(stay)).unionByName(cast(solved))
    # nodes and walks
    new_nodes = s.select(F.col("new_node").alias("node_id"), "graph_id", F.col("new_block").alias("block_id"), "path_id", F.col("new_strand").alias("strand"), F.col("ps").alias("pos_start"), F.col("pe").alias("pos_end"))
    gone = g.nodes.join(touched, ["graph_id", "block_id"], "left_semi").select("node_id")
    nodes = g.nodes.join(gone, "node_id", "left_anti").unionByName(new_nodes)
    within = F.when(F.col("fwd"), F.col("start")).otherwise(-F.col("start"))
    respelled = g.path_nodes.join(s.select("node_id", within.alias("within"), "new_node"), "node_id").select("graph_id", "path_id", "ord", "within", F.col("new_node").alias("node_id"))
    same = g.path_nodes.join(gone, "node_id", "left_anti").select("graph_id", "path_id", "ord", F.lit(0).alias("within"), "node_id")
    lists = respelled.unionByName(same).groupBy("graph_id", "path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "within", "node_id"))), lambda x: x["node_id"]).alias("nodes"))
    paths = g.paths.drop("nodes").join(lists, ["graph_id", "path_id"], "left").withColumn("nodes", F.coalesce("nodes", F.array().cast("array<string>")))
    return bundle(nodes, paths, blocks_all, edits)


def detach_unaligned(g: Graphs) -> Graphs:
    """Nodes of which no letter is aligned become blocks of their own, forward."""
    lost = g.alignments.where(is_unaligned(F.length("consensus"), F.col("edit"))).select("graph_id", "block_id", "node_id", apply_edit(F.col("consensus"), F.col("edit")).alias("seq"))
    # a block of which no other node is left would be emptied: it stays
    lost = cut_lineage(lost.where(F.length("seq") > 0))
    if lost.isEmpty():
        return g
    strands = lost.join(g.nodes.select("node_id", "strand"), "node_id")
    own = strands.select("graph_id", "node_id", F.when(F.col("strand") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("consensus"))
    own = cut_lineage(own.withColumn("block_id", content_id(F.col("node_id"), F.col("consensus"))))
    gone = lost.select("node_id")
    kept = g.alignments.join(gone, "node_id", "left_anti").select("graph_id", "block_id", "node_id", "edit")
    plain = F.struct(F.array().cast("array<struct<pos:int,alt:string>>").alias("subs"), F.array().cast("array<struct<pos:int,len:int>>").alias("dels"), F.array().cast("array<struct<pos:int,seq:string>>").alias("inss"))
    edits = kept.withColumn("edit", F.col("edit").cast(EDIT_TYPE)).unionByName(own.select("graph_id", "block_id", "node_id", plain.cast(EDIT_TYPE).alias("edit")))
    blocks = g.blocks.select("graph_id", "block_id", "consensus").unionByName(own.select("graph_id", "block_id", "consensus"))
    blocks = blocks.join(edits.select("graph_id", "block_id").distinct(), ["graph_id", "block_id"], "left_semi")
    moved = g.nodes.join(own.select("node_id", F.col("block_id").alias("own")), "node_id", "left").select(
        "node_id", "graph_id", F.coalesce("own", "block_id").alias("block_id"), "path_id", F.when(F.col("own").isNotNull(), "+").otherwise(F.col("strand")).alias("strand"), "pos_start", "pos_end"
    )
    return bundle(moved, g.paths, blocks, edits)


def reconsensus(g: Graphs, o: Options | None = None) -> Graphs:
    """Blocks whose majority differs from their consensus get a new one, and their nodes new edits."""
    fresh = cut_lineage(new_consensus(g).where(F.length("consensus") > 0))
    if fresh.isEmpty():
        return g
    key = ["graph_id", "block_id"]
    typed = lambda df: df.select(*key, "node_id", F.col("edit").cast(EDIT_TYPE).alias("edit"))
    # only substitutions: edits are mended one by one; indels move letters, so nodes are aligned anew
    mend = g.alignments.join(fresh.where("kind = 'substitution'").select(*key, "subs"), key)
    old = lambda s: F.substr("consensus", s["pos"] + 1, F.lit(1))
    mended = mend.withColumn("edit", F.aggregate("subs", F.col("edit").cast(EDIT_TYPE), lambda e, s: reconcile_substitution(e, s["pos"], old(s), s["alt"]).cast(EDIT_TYPE)))
    seqs = g.alignments.select(
        *key, "node_id", apply_edit(F.col("consensus"), F.col("edit")).alias("seq"), F.aggregate("edit.dels", F.lit(0), lambda a, d: a + d["len"]).alias("band"), F.col("edit").cast(EDIT_TYPE).alias("expected")
    )
    solved = _realigned(seqs.join(fresh.where("kind = 'indel'").select(*key, "consensus"), key), o or Options())
    kept = g.alignments.join(fresh.select(*key), key, "left_anti")
    blocks = g.blocks.select(*key, "consensus").join(fresh.select(*key), key, "left_anti").unionByName(fresh.select(*key, "consensus"))
    return bundle(g.nodes, g.paths, blocks, typed(kept).unionByName(typed(mended)).unionByName(typed(solved)))


def self_merge(g: Graphs, o: Options) -> Graphs:
    """Passes of matching and merging until no match is accepted."""
    for _ in range(o.max_self_map + 1):
        matches = accepted_matches(g, o)
        if matches.isEmpty():
            break
        g = contract(reconsensus(detach_unaligned(reweave(g, matches, o)), o))
    return g


def merge(left: Graphs, right: Graphs, o: Options, graph_id: int = 0) -> Graphs:
    """One graph of two."""
    both = bundle(*[a.unionByName(b) for a, b in ((left.nodes, right.nodes), (left.paths, right.paths), (left.blocks.select("graph_id", "block_id", "consensus"), right.blocks.select("graph_id", "block_id", "consensus")), (left.alignments.select("graph_id", "block_id", "node_id", F.col("edit").cast(EDIT_TYPE).alias("edit")), right.alignments.select("graph_id", "block_id", "node_id", F.col("edit").cast(EDIT_TYPE).alias("edit"))))])
    ids = [r[0] for r in both.paths.select("graph_id").distinct().collect()]
    joined = _remap(both, {i: graph_id for i in ids})
    assert_disjoint(joined)
    return self_merge(joined, o)


def build(records: DataFrame, o: Options | None = None) -> Graphs:
    """The graph of all records, merged along a guide tree; all merges of one height run at once.

    ``records`` has rec_index, seq_name, descr, seq. One record gives its singleton graph. With
    ``verify`` an error is raised unless every genome can be read back.
    """
    o = o or Options()
    records = cut_lineage(records.where(F.length("seq") > 0).select("rec_index", "seq_name", "descr", F.upper("seq").alias("seq")))
    g = singletons(records, o.circular)
    if o.guide_tree:
        names = {r["seq_name"]: str(r["rec_index"]) for r in records.select("seq_name", "rec_index").collect()}
        root = tr.attach(tr.parse_newick(o.guide_tree), list(names))
        stack = [root]
        while stack:
            c = stack.pop()
            c.name = names.get(c.name) if not c.children else None
            stack.extend(c.children)
    else:
        root = guide_tree(records)
    at = {id(c): int(c.name) for c in _leaves(root)}
    for wave in tr.waves(root):
        mapping = {}
        for node in wave:
            a, b = (at[id(c)] for c in node.children)
            at[id(node)] = min(a, b)
            mapping[max(a, b)] = min(a, b)
        g = self_merge(_remap(g, mapping), o)
    if o.verify:
        wrong = verify(g, records).head()
        if wrong:
            raise AssertionError(f"genome {wrong['path_id']} can't be read back")
    return g


def _leaves(root: tr.Clade) -> list[tr.Clade]:
    stack, out = [root], []
    while stack:
        c = stack.pop()
        out += [] if c.children else [c]
        stack.extend(c.children)
    return out


def verify(g: Graphs, records: DataFrame) -> DataFrame:
    """Genomes that differ from their records."""
    back = reconstruct(g).select("path_id", "seq")
    return compare_genomes(back, records.select(F.col("rec_index").cast("string").alias("path_id"), F.upper("seq").alias("seq")), ["path_id"])




"""Statistics, walks, junctions and synteny on small graphs with known answers."""

import pytest
from pyspark.sql import functions as F

from strandloom.operators import junctions, quality, sequences, simplify, stats, synteny, walks
from strandloom.sources import gfa

from .conftest import rows

JUNCTION = (
    {"s1": "100+ 500+ 600+ 200+ 300+ 400+", "s2": "100+ 500+ 200+ 700+ 300+ 400+", "s3": "100+ 600- 300+ 200+ 700+ 400+"},
    {"100": 1000, "200": 800, "300": 600, "400": 700, "500": 200, "600": 150, "700": 300},
)
LINEAR = (
    {"s1": "500+ 100+ 600+ 200+ 300+", "s2": "100+ 700+ 200+ 300+ 500+"},
    {"100": 1000, "200": 800, "300": 600, "500": 200, "600": 150, "700": 300},
)
INVERSION = (
    {"s1": "10+ 50+ 80+ 20+ 60+ 30+ 70+ 90- 40+", "s2": "40- 90+ 70- 30- 60- 20- 80- 50- 10-", "s3": "10+ 50+ 20+ 60+ 70- 30- 40+"},
    {"10": "ACGTTGCAACCA", "20": "TTGGAACCGGTTAC", "30": "GATTACAGGCT", "40": "CCAGTACGTGACATCA", "50": "ACACGTGTACGTA",
     "60": "TGTCATGCAATGCAT", "70": "GGATCCGAATTCAGTCA", "80": "ACGTGA", "90": "TTCAGGCA"},
)


def _stats(g, min_len):
    js = junctions.junctions(g.walks, junctions.backbone(g, min_len))
    table = junctions.junction_stats(js, g.block_lengths)
    return {r["edge"]: tuple(r)[2:6] + (r["accessory_length"],) for r in table.collect()}


def test_junction_statistics(make_graph):
    g = make_graph(*JUNCTION)
    assert _stats(g, 500) == {
        "100_f__200_f": (2, 2, 2, 1, 350),
        "100_f__300_f": (1, 1, 1, 1, 150),
        "100_r__400_r": (3, 0, 1, 3, 0),
        "200_f__300_f": (2, 1, 2, 1, 300),
        "200_f__400_f": (1, 1, 1, 1, 300),
        "200_r__300_r": (1, 0, 1, 1, 0),
        "300_f__400_f": (2, 0, 1, 2, 0),
    }


def test_linear_junctions_leave_out_the_ends(make_graph):
    assert _stats(make_graph(*LINEAR, circular=False), 500) == {"100_f__200_f": (2, 2, 2, 1, 450), "200_f__300_f": (2, 0, 1, 2, 0)}


def test_inversion_junctions(make_graph):
    found = _stats(make_graph(*INVERSION), 10)
    assert sorted((s[0] for s in found.values()), reverse=True) == [3, 3, 3, 3, 3, 2, 2, 1, 1]


def test_junction_sequences_span_their_flanks(make_graph):
    g = make_graph(*INVERSION)
    js = junctions.junctions(g.walks, junctions.backbone(g, 10))
    found = {(r["edge"], r["path_id"]): r["seq"] for r in junctions.junction_sequences(js, sequences.node_sequences(g), g.walks).collect()}
    genomes = {r["path_id"]: r["seq"] for r in sequences.reconstruct(g).collect()}
    assert len(found) == js.count()
    flip = str.maketrans("ACGT", "TGCA")
    for (_, path), seq in found.items():
        doubled = genomes[path] * 2
        assert seq in doubled or seq.translate(flip)[::-1] in doubled


def test_too_few_backbone_blocks_give_no_junctions(make_graph):
    g = make_graph({"s1": "1+ 2+", "s2": "1+ 3+"}, {"1": 600, "2": 600, "3": 600})
    assert junctions.junctions(g.walks, junctions.backbone(g, 500)).count() == 0


def test_context_depths(make_graph):
    g = make_graph({"s1": "100+ 500+ 500+ 200+", "s2": "100+ 500+ 200+"}, {"100": 1000, "200": 800, "500": 200})
    js = junctions.junctions(g.walks, junctions.backbone(g, 500))
    segments, links = junctions.context_links(js, js, stats.block_stats(g))
    assert {r["segment"].split("_")[-1]: r["depth"] for r in segments.where("not segment like 'J1%'").collect()} == {"100": 2, "200": 2, "500": 3}
    assert links.count() == 4


@pytest.mark.parametrize(
    ("graph", "circular", "min_len", "units"),
    [
        (JUNCTION, True, 500, {("100", "400"): 1700, ("200",): 800, ("300",): 600}),
        (LINEAR, False, 500, {("100", "200", "300"): 2400}),
        (INVERSION, True, 10, {("10", "20", "40", "50", "60"): 70, ("30", "70"): 28}),
    ],
)
def test_synteny_units(make_graph, graph, circular, min_len, units):
    g = make_graph(*graph, circular=circular)
    core = junctions.backbone(g, min_len)
    table = synteny.synteny_units(g, core)
    got = {}
    for r in table.collect():
        got.setdefault((r["label"], r["unit_len"]), []).append(r["block_id"])
    assert {tuple(sorted(b)): n for (_, n), b in got.items()} == units


def test_unit_walks_are_rotated_alike(make_graph):
    g = make_graph(*INVERSION)
    core = junctions.backbone(g, 10)
    found = {}
    for r in synteny.unit_walks(g, synteny.synteny_units(g, core), core, rotate=True).orderBy("ord").collect():
        found.setdefault(r["path_id"], []).append((r["label"], r["fwd"]))
    assert found["1"] == found["2"] == [("MSU_0", True), ("MSU_1", True)]
    assert found["3"] == [("MSU_0", True), ("MSU_1", False)]


def test_rotation_needs_circular_paths(make_graph):
    g = make_graph(*LINEAR, circular=False)
    core = junctions.backbone(g, 500)
    with pytest.raises(ValueError, match="circular"):
        synteny.unit_walks(g, synteny.synteny_units(g, core), core, rotate=True)


def test_block_stats_of_a_tandem(make_graph):
    g = make_graph({"s1": "100+ 500+ 500+ 200+", "s2": "100+ 500+ 200+"}, {"100": 1000, "200": 800, "500": 200})
    assert rows(stats.block_stats(g), "block_id", "count", "n_strains", "duplicated", "core") == [
        ("100", 2, 2, False, True), ("200", 2, 2, False, True), ("500", 3, 2, True, False),
    ]


def test_wrap_edges_of_single_places(make_graph):
    g = make_graph({"s1": "7+"}, {"7": 10})
    assert walks.graph_links(g.walks).count() == 1  # the export closes a walk of one place
    assert walks.edge_counts(g.walks).count() == 0  # the walk algebra doesn't


def test_gfa_text(make_graph):
    blocks = {"1": "ACCTATCGTGATCGTTCGAT", "2": "CTGCAAGTCTGATCTAGTTA", "3": "AGGCTACGAT", "4": "CTTCAGCAAG"}
    g = make_graph({"A": "1+ 2- 3+", "B": "2+ 1- 3+ 4+"}, blocks)
    lines = [r["value"] for r in gfa.gfa_lines(g).orderBy("section", "rank").collect()]
    assert lines == [
        "H\tVN:Z:1.0", "# blocks",
        "S\t1\tACCTATCGTGATCGTTCGAT\tRC:i:40\tLN:i:20", "S\t2\tCTGCAAGTCTGATCTAGTTA\tRC:i:40\tLN:i:20",
        "S\t3\tAGGCTACGAT\tRC:i:20\tLN:i:10", "S\t4\tCTTCAGCAAG\tRC:i:10\tLN:i:10", "# edges",
        "L\t1\t+\t2\t-\t*\tRC:i:2", "L\t1\t-\t3\t+\t*\tRC:i:1", "L\t1\t-\t3\t-\t*\tRC:i:1", "L\t2\t-\t3\t+\t*\tRC:i:1",
        "L\t2\t-\t4\t-\t*\tRC:i:1", "L\t3\t+\t4\t+\t*\tRC:i:1", "# paths", "P\tA\t1+,2-,3+\t*\tTP:Z:circular", "P\tB\t2+,1-,3+,4+\t*\tTP:Z:circular",
    ]


@pytest.mark.parametrize(
    ("walk_set", "circular"),
    [
        ({"a": "1+ 2+ 3+", "b": "1+ 2+ 4+", "c": "3- 2- 1- 4+"}, True),
        ({"a": "1+ 2- 3+ 4+", "b": "4+ 1+ 2- 3+"}, True),  # a cycle: all edges are transitive
        ({"a": "2+ 5+ 1-", "b": "3+ 2+ 5+ 1- 4+"}, False),
    ],
)
def test_contraction_keeps_genomes(make_graph, walk_set, circular):
    seqs = {"1": "ACGTTGCAACCA", "2": "TTGGAACCGGTTACA", "3": "GATTACAGGCT", "4": "CCAGTACG", "5": "GGGTTT"}
    used = {s[:-1] for w in walk_set.values() for s in w.split()}
    edits = {
        1: {"subs": [{"pos": 0, "alt": "T"}], "dels": [{"pos": 3, "len": 2}], "inss": [{"pos": 0, "seq": "CC"}]},
        2: {"subs": [], "dels": [], "inss": [{"pos": len(seqs[walk_set["a"].split()[1][:-1]]), "seq": "GA"}]},
    }
    g = make_graph(walk_set, {b: s for b, s in seqs.items() if b in used}, circular, edits)
    c = simplify.contract(g)
    assert walks.transitive_edges(c.walks).count() == 0
    assert c.blocks.count() < g.blocks.count()
    before, after = (dict(rows(sequences.reconstruct(x), "path_id", "seq")) for x in (g, c))
    assert before == after
    assert quality.report(c).count() == 0


def test_empty_tables_give_empty_results(empty_graph):
    g = empty_graph
    core = junctions.backbone(g, 1)
    for df in (
        stats.block_stats(g), stats.pairwise_content(g), walks.graph_links(g.walks), junctions.junctions(g.walks, core),
        synteny.synteny_units(g, core), sequences.reconstruct(g), quality.report(g), gfa.gfa_lines(g),
    ):
        assert df.count() == 0


def test_nulls_and_repeats_in_the_tables(spark, make_graph):
    g = make_graph({"s1": "1+ 2+ 3+", "s2": "1+ 3-"}, {"1": 10, "2": 20, "3": 30})
    want = rows(stats.block_stats(g))
    odd = g.raw_nodes.where("node_id = '1'").withColumns({"node_id": F.lit("99"), "block_id": F.lit(None).cast("string"), "strand": F.lit(None).cast("string")})
    h = type(g)(g.raw_nodes.unionByName(g.raw_nodes).unionByName(odd), g.raw_paths.unionByName(g.raw_paths), g.blocks)
    assert rows(stats.block_stats(h)) == want


def test_report_names_broken_rules(make_graph):
    g = make_graph({"s1": "1+ 2+"}, {"1": 10, "2": 20}, edits={1: {"subs": [{"pos": 12, "alt": "A"}], "dels": [], "inss": []}})
    assert "substitution out of bounds" in {r["rule"] for r in quality.report(g).collect()}


def test_core_alignment_follows_the_guide(make_graph):
    g = make_graph({"s1": "10+ 30+ 20+", "s2": "20- 40- 10-"}, {"10": "AAACCC", "20": "GGGAAA", "30": "TTC", "40": "ACG"}, edits={6: {"subs": [{"pos": 0, "alt": "T"}], "dels": [], "inss": []}})
    found = dict(rows(sequences.core_alignment(g, junctions.backbone(g, 4)), "path_name", "seq"))
    assert found == {"s1": "AAACCCGGGAAA", "s2": "TAACCCGGGAAA"}


def test_components_follow_links_that_occur_once(make_graph):
    from strandloom.plans.graph_queries import g28_components

    g = make_graph({"s1": "1+ 2+", "s2": "3+ 2-", "s3": "4+"}, dict.fromkeys("1234", 9), circular=False)
    assert rows(g28_components(g), "vertex", "component") == [("1", "1"), ("2", "1"), ("3", "1"), ("4", "4")]


@pytest.mark.parametrize("circular", [True, False])
def test_intervals_hold_every_node_of_every_path(make_graph, circular):
    from strandloom.operators.matches import block_intervals
    from strandloom.plans.match_queries import node_hits

    g = make_graph({"s1": "1+ 2+ 3- 1+", "s2": "2+"}, {"1": 10, "2": 20, "3": 5}, circular=circular)
    want = [("1", 0, 10, True), ("1", 10, 30, True), ("1", 30, 35, True), ("1", 35, 45, True), ("2", 0, 20, True)]
    assert rows(block_intervals(*node_hits(g)), "block", "start", "end", "aligned") == want


def test_intervals_of_a_node_over_the_origin(spark, make_graph):
    from strandloom.operators.matches import block_intervals
    from strandloom.plans.match_queries import node_hits

    g = make_graph({"s1": "1+ 2+"}, {"1": 10, "2": 20})
    g.walks = g.walks.withColumns({"pos_start": (F.col("pos_start") + 15) % 30, "pos_end": (F.when(F.col("pos_end") == 0, 30).otherwise(F.col("pos_end")) + 15) % 30})
    want = [("1", 0, 15, True), ("1", 15, 25, True), ("1", 25, 30, True)]
    assert rows(block_intervals(*node_hits(g)), "block", "start", "end", "aligned") == want


def test_projection_on_all_names(make_graph):
    from strandloom.plans.match_queries import path_names

    names = [f"s{i}" for i in range(5)]
    g = make_graph(dict.fromkeys(names, "1+"), {"1": 9})
    assert {r["path_name"] for r in stats.project(g, path_names(g)).collect()} == set(names)
    assert stats.project(g, names[:2]).count() == 2

"""Expressions on sequences, edits and cigars; alignment, sketches, trees and matches."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.functions import edits as ed
from strandloom.functions import seq as sq
from strandloom.operators import align, matches, sketch, tree
from strandloom.operators.components import connected_components
from strandloom.operators.quality import overlaps, runs
from strandloom.tables import EDIT_TYPE

from .conftest import rows

CONSENSUS = "ACTCTACCCGCTACTGGCAC"
EDITS = [
    ({"subs": [(1, "G")], "dels": [(8, 3)], "inss": []}, "AGTCTACCTACTGGCAC", "AGTCTACC---TACTGGCAC"),
    ({"subs": [(15, "A")], "dels": [], "inss": [(20, "AAA")]}, "ACTCTACCCGCTACTAGCACAAA", "ACTCTACCCGCTACTAGCAC"),
    ({"subs": [], "dels": [(10, 2)], "inss": [(3, "GG")]}, "ACTGGCTACCCGACTGGCAC", "ACTCTACCCG--ACTGGCAC"),
]


@pytest.fixture(scope="module")
def edited(spark):
    return spark.createDataFrame([(i, CONSENSUS, e) for i, (e, _, _) in enumerate(EDITS)], f"i int, c string, e {EDIT_TYPE}")


def test_edits_are_applied(edited):
    got = edited.orderBy("i").select(ed.apply_edit(F.col("c"), F.col("e")), ed.apply_aligned(F.col("c"), F.col("e"))).collect()
    assert [tuple(r) for r in got] == [(raw, aligned) for _, raw, aligned in EDITS]


def test_reversed_edits_make_the_other_strand(edited):
    n = F.length("c")
    back = ed.apply_edit(sq.reverse_complement(F.col("c")), ed.reverse_edit(n, F.col("e")))
    got = edited.select(back == sq.reverse_complement(ed.apply_edit(F.col("c"), F.col("e")))).collect()
    assert all(r[0] for r in got)


@pytest.mark.parametrize("cuts", [[0, 20], [0, 9, 20], [0, 3, 10, 11, 20]])
def test_slices_make_the_whole(edited, cuts):
    n = F.length("c")
    parts = [ed.apply_edit(F.col("c").substr(a + 1, b - a), ed.slice_edit(F.col("e"), F.lit(a), F.lit(b), n)) for a, b in zip(cuts, cuts[1:], strict=False)]
    got = edited.orderBy("i").select(F.concat(*parts)).collect()
    assert [r[0] for r in got] == [raw for _, raw, _ in EDITS]
    places = [ed.node_interval(F.col("e"), F.lit(a), F.lit(b), n) for a, b in zip(cuts, cuts[1:], strict=False)]
    for r, (_, raw, _) in zip(edited.orderBy("i").select(*[x for p in places for x in p]).collect(), EDITS, strict=True):
        assert r[0] == 0 and r[-1] == len(raw) and all(r[i] == r[i + 1] for i in range(1, len(r) - 1, 2))


def test_concatenated_edits(edited):
    two = ed.concat_edits(F.col("e"), F.length("c"), F.col("e"))
    got = edited.orderBy("i").select(ed.apply_edit(F.concat("c", "c"), two)).collect()
    assert [r[0] for r in got] == [raw * 2 for _, raw, _ in EDITS]


def test_edit_problems(spark):
    bad = {"subs": [(1, "-"), (1, "A"), (9, "C")], "dels": [(8, 3), (9, 5), (2, 0)], "inss": [(21, "A")]}
    df = spark.createDataFrame([(20, bad)], f"n int, e {EDIT_TYPE}")
    found = set(df.select(ed.problems(F.col("n"), F.col("e"))).head()[0])
    assert found == {
        "substitution by a gap", "two substitutions at one place", "substitution inside a deletion", "empty deletion", "deletions overlap", "insertion out of bounds",
    }


def test_positions(spark):
    df = spark.createDataFrame([(10, 40, 10, 20, True, 100, True), (10, 40, 10, 20, False, 100, True), (90, 10, 15, 20, True, 100, True), (10, 40, 10, 20, True, 100, False)], "s long, e long, l long, h long, f boolean, n long, c boolean")
    got = df.select(*ed.new_position(F.col("s"), F.col("e"), F.col("l"), F.col("h"), F.col("f"), F.col("n"), F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(20, 30), (20, 30), (5, 10), (20, 30)]


def test_cigars(spark):
    df = spark.createDataFrame([("10M 2I\t3D5M",)], "t string").select(cg.parse(F.col("t")).alias("c"))
    c = F.col("c")
    got = df.select(
        cg.text(c), cg.match_length(c), cg.total_length(c), cg.text(cg.invert(c)), cg.text(cg.swap_sides(c)), cg.text(cg.add_leading(c, "D", F.lit(4))),
        cg.text(cg.add_leading(cg.add_leading(c, "D", F.lit(4)), "D", F.lit(1))), cg.text(cg.add_trailing(c, "I", F.lit(2))), cg.has_no_indel(c),
    ).head()
    assert tuple(got) == ("10M2I3D5M", 15, 20, "5M3D2I10M", "10M2D3I5M", "4D10M2I3D5M", "5D10M2I3D5M", "10M2I3D5M2I", False)


def test_sequence_functions(spark):
    df = spark.createDataFrame([("ACGTRYN",), ("",), (None,)], "s string")
    s = F.col("s")
    assert [tuple(r) for r in df.select(sq.reverse_complement(s), sq.rotate_left(s, F.lit(2)), sq.rotate_right(s, F.lit(2)), sq.is_valid(s)).collect()] == [
        ("NRYACGT", "GTRYNAC", "YNACGTR", True), ("", "", "", True), (None, None, None, None),
    ]


@pytest.mark.parametrize(("x", "mask", "want"), [(123, 456, 384), (0, 456, 136), (123, 0, 0)])
def test_integer_hash(spark, x, mask, want):
    assert sketch.invertible_hash(np.array([x], dtype=np.uint64), mask)[0] == want
    assert spark.range(1).select(sq.integer_hash(F.lit(x), mask)).head()[0] == want


def test_native_sketch_equals_the_arrays(spark):
    rng = random.Random(3)
    seqs = [(i, "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate((0, 5, 8, 20, 60, 300))]
    df = spark.createDataFrame(seqs, "i int, s string")
    assert rows(sketch.native_sketch(df, "i", "s", 8, 16)) == rows(sketch.sketch(df, "i", "s", 8, 16).select("i", "value").distinct())


def test_sketch_skips_nulls_and_other_letters(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "NNNNNNNNNN"), (4, "ACGTTGCANN")], "i int, s string")
    assert {r["i"] for r in sketch.sketch(df, "i", "s", 8, 4).collect()} <= {4}


def test_sketch_distance_has_the_first_as_denominator(spark):
    df = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 2)], "k int, value long")
    assert rows(sketch.sketch_distances(df, "k")) == [(0, 1, 2, 1 - 2 / 3)]


def test_neighbor_joining():
    d = np.array([[0, 5, 9, 9, 8], [5, 0, 10, 10, 9], [9, 10, 0, 8, 7], [9, 10, 8, 0, 3], [8, 9, 7, 3, 0]], float)
    assert tree.q_matrix(d)[0, 1] == -50 and tree.q_matrix(d)[3, 4] == -48
    assert tree.joined_distances(d, 0, 1)[2:].tolist() == [7, 7, 6]
    assert sorted(tree.neighbor_joining(d, list("abcde")).leaves()) == list("abcde")
    assert tree.neighbor_joining(np.zeros((1, 1)), ["a"]).name == "a"


def test_newick():
    text = "(('a''b':1.5,b)inner:2,(c,d));"
    t = tree.parse_newick(text)
    assert t.leaves() == ["a'b", "b", "c", "d"] and tree.to_newick(t) == "(('a''b',b),(c,d));"
    assert [len(w) for w in tree.waves(t)] == [2, 1]
    assert tree.attach(t, ["b", "d", "c", "a'b"]) is t
    for bad in ("", "(a,b", "(a,b);x", "(a,b,c);", "(a);", "(a:x,b);", "('a,b);"):
        with pytest.raises(ValueError):
            tree.parse_newick(bad)
    for names in (["b", "c", "d"], ["b", "c", "d", "a'b", "e"], ["b", "b", "c", "d"]):
        with pytest.raises(ValueError):
            tree.attach(t, names)


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", max_size=120), st.integers(0, 2**32))
def test_alignment_gives_the_sequence_back(ref, seed):
    rng = random.Random(seed)
    q = list(ref)
    for _ in range(rng.randint(0, 5)):
        at = rng.randint(0, len(q))
        q[at : at + rng.randint(0, 6)] = [rng.choice("ACGT") for _ in range(rng.randint(0, 6))]
    query = "".join(q)
    edit = align.realign(ref, query)
    assert align.apply(ref, edit) == query


def test_alignment_finds_the_gap():
    assert align.realign("ACGTACGTAA", "ACGTCGTAA") == {"subs": [], "dels": [{"pos": 4, "len": 1}], "inss": []}
    assert align.realign("ACGT", "") == {"subs": [], "dels": [{"pos": 0, "len": 4}], "inss": []}


def _ops(text):
    import re

    return [(o, int(n)) for n, o in re.findall(r"(\d+)([MID=X])", text)]


def test_groups_between_long_indels():
    ops = _ops("10I20D10M20I190D40M1D1I40M1I40M1D100I200M60I60D140M200D40M2I70M")
    assert matches.keep_groups(ops, 100) == [(5, 11), (13, 17), (18, 21)]


def _match(spark, *rows_):
    return spark.createDataFrame(rows_, "q_name string, q_len int, q_start int, q_end int, r_name string, r_len int, r_start int, r_end int, matches int, divergence double")


def test_energy(spark):
    m = _match(spark, ("q", 100, 0, 50, "r", 200, 120, 200, 40, 0.02))
    # two of the four ends of the match are ends of a block
    assert m.select(matches.energy(10, 10)).head()[0] == pytest.approx(-40 + 20 + 8)


def test_greedy_takes_the_best_and_nothing_that_overlaps(spark):
    m = _match(
        spark,
        ("a", 1000, 0, 100, "b", 1000, 0, 100, 100, 0.0), ("a", 1000, 50, 300, "c", 1000, 0, 250, 250, 0.0),
        ("b", 1000, 500, 600, "c", 1000, 300, 400, 100, 0.0), ("x", 1000, 0, 100, "y", 1000, 0, 100, 100, None),
    ).withColumn("energy", -F.col("matches").cast("double"))
    assert {(r["q_name"], r["r_name"]) for r in matches.greedy(m).collect()} == {("a", "c"), ("b", "c"), ("x", "y")}
    assert matches.greedy(m.limit(0)).count() == 0


def test_intervals_of_a_block(spark):
    hits = spark.createDataFrame([("b", 10, 100), ("b", 200, 300), ("b", 310, 500), ("b", 600, 900)], "block string, start int, end int")
    lens = spark.createDataFrame([("b", 1000)], "block string, len int")
    got = rows(matches.refine_intervals(matches.block_intervals(hits, lens), 50), "start", "end", "aligned")
    assert sorted(got) == [(0, 100, True), (100, 200, False), (200, 300, True), (300, 500, True), (500, 600, False), (600, 900, True), (900, 1000, False)]


def test_anchor_sides(spark):
    m = _match(spark, ("a", 9, 0, 4, "b", 9, 0, 4, 4, 0.0), ("a", 9, 4, 8, "c", 9, 0, 4, 4, 0.0), ("b", 9, 4, 8, "c", 9, 4, 8, 4, 0.0))
    blocks = spark.createDataFrame([("a", 5, "ACGTNCGTA"), ("b", 3, "ACGTACGTA"), ("c", 5, "ACGTNCGTA")], "name string, depth int, consensus string")
    got = {(r["q_name"], r["r_name"]): r["anchor"] for r in matches.anchors(m, blocks).collect()}
    assert got == {("a", "b"): "qry", ("a", "c"): "ref", ("b", "c"): "ref"}


def test_runs_and_overlaps(spark):
    p = spark.createDataFrame([("k", x) for x in (1, 2, 3, 5, 6, 9, 9)], "k string, pos int")
    assert rows(runs(p, ["k"])) == [("k", 1, 4), ("k", 5, 7), ("k", 9, 10)]
    rng = random.Random(1)
    iv = [("k", i, s := rng.randint(0, 9000), s + rng.randint(0, 2500)) for i in range(60)]
    want = sorted((a[1], b[1]) for a in iv for b in iv if a[1] < b[1] and a[3] > b[2] and a[2] < b[3] and a[3] > a[2] and b[3] > b[2])
    got = overlaps(spark.createDataFrame(iv, "k string, id int, start long, end long"), ["k"]).select("id_a", "id_b")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_components_of_long_chains_and_stars(spark):
    edges = [(0, f"{i:03}", f"{i + 1:03}") for i in range(60)] + [(1, "000", f"{i:03}") for i in range(1, 30)] + [(0, None, "001"), (2, "zz", "yy")]
    verts = [(0, f"{i:03}") for i in range(61)] + [(1, f"{i:03}") for i in range(31)]
    e, v = spark.createDataFrame(edges, "g int, a string, b string"), spark.createDataFrame(verts, "g int, vertex string")
    got = {(r["g"], r["vertex"]): r["component"] for r in connected_components(v, e, ["g"]).collect()}
    assert all(got[0, f"{i:03}"] == "000" for i in range(61))
    assert got[1, "030"] == "030" and got[1, "029"] == "000"
    assert connected_components(v.limit(0), e.limit(0), ["g"]).count() == 0


def _least_of_components(edges, vertices):
    up = {v: v for v in vertices}

    def top(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for g, a, b in edges:
        x, y = top((g, a)), top((g, b))
        up[max(x, y)] = min(x, y)
    return {v: top(v)[1] for v in vertices}


@pytest.mark.parametrize("length, at_once, most", [(1_000, 500_000, 1), (100_000, 20_000, 12)])
def test_components_of_shuffled_random_ids(spark, monkeypatch, length, at_once, most):
    from strandloom.operators import components

    monkeypatch.setattr(components, "FOREST_EDGES", at_once)
    rng = random.Random(length)
    chain = [str(rng.getrandbits(64)) for _ in range(length)]
    edges = [(0, a, b) for a, b in zip(chain, chain[1:], strict=False)]
    side = [[str(rng.getrandbits(64)) for _ in range(20)] for _ in range(20)]  # a grid
    edges += [(1, side[i][j], side[i - 1][j]) for i in range(1, 20) for j in range(20)] + [(1, side[i][j], side[i][j - 1]) for i in range(20) for j in range(1, 20)]
    edges += [(2, a, b) for a, b in zip(chain[:500], chain[1:500] + chain[:1], strict=False)]  # a cycle
    edges += [(3, chain[0], x) for x in chain[1:800]]  # a star
    edges += [(4, rng.choice(chain[:900]), rng.choice(chain[:900])) for _ in range(500)]
    vertices = list({(g, x) for g, a, b in edges for x in (a, b)})
    rng.shuffle(edges)
    log: list = []
    e, v = spark.createDataFrame(edges, "g int, a string, b string").repartition(8), spark.createDataFrame(vertices, "g int, vertex string")
    got = {(r["g"], r["vertex"]): r["component"] for r in connected_components(v, e, ["g"], log).collect()}
    assert got == _least_of_components(edges, vertices)
    assert len(log) <= most


def test_components_of_numbers_and_unfinished_rounds(spark, monkeypatch):
    from strandloom.operators import components

    e = spark.createDataFrame([("x", 2, 10), ("x", 10, 9), ("y", 10, 2)], "g string, a long, b long")
    v = spark.createDataFrame([("x", i) for i in (2, 9, 10)] + [("y", 2), ("y", 10)], "g string, vertex long")
    assert rows(connected_components(v, e, ["g"])) == [("x", 10, 2), ("x", 2, 2), ("x", 9, 2), ("y", 10, 2), ("y", 2, 2)]
    monkeypatch.setattr(components, "MOST_ROUNDS", 0)
    with pytest.raises(RuntimeError, match="unfinished"):
        connected_components(v, e, ["g"])


def test_merged_tables(spark):
    from strandloom.tables import merge_by_key

    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert rows(merge_by_key(a, b, ["k"], "v", "left")) == [(1, "x"), (2, None), (3, "w")]
    assert rows(merge_by_key(a, b, ["k"], "v", "right")) == [(1, "x"), (2, "z"), (3, "w")]
    assert rows(merge_by_key(a, b, ["k"], "v", F.coalesce("left", F.lit("new")))) == [(1, "x"), (2, "new"), (3, "w")]
    with pytest.raises(Exception, match="both tables"):
        merge_by_key(a, b, ["k"], "v").collect()

"""Chains and matches of two sequences."""

import random

import numpy as np
import pytest

from strandloom.operators import align, matching

GAP = 300


def _gain(dq, dr, k):
    return min(dq, dr, k) - 0.05 * abs(dq - dr) - 0.5 * (dq != dr)


def test_a_chain_passes_more_than_200_other_anchors():
    qa = np.array([0, *range(5000, 5300), 100])
    ra = np.array([0, *[50] * 300, 100])
    assert [0, 301] in matching.chains(qa, ra, 15, GAP)


@pytest.mark.parametrize("seed", range(40))
def test_best_chain_equals_that_of_all_pairs(seed):
    rng = random.Random(seed)
    side, k, gap = rng.choice([20, 60, 400]), 5, rng.choice([8, 30, 300])
    points = sorted({(rng.randrange(side), rng.randrange(side)) for _ in range(150)} | {(i, i + 3) for i in range(0, side - 3, 2)}, key=lambda p: p[::-1])
    best = []
    for i, (q, r) in enumerate(points):
        before = [b + _gain(q - x, r - y, k) for (x, y), b in zip(points, best) if 0 < q - x <= gap and 0 < r - y <= gap]
        best.append(max([k, *before]))
    chain = [points[i] for i in matching.chains(*np.array(points).T, k, gap)[0]]
    score = k + sum(_gain(b[0] - a[0], b[1] - a[1], k) for a, b in zip(chain, chain[1:]))
    assert score == pytest.approx(max(best))


def _dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def _diverged(seq, every):
    """Every so many letters one is changed, so no word of that length is left."""
    return "".join("ACGT"["TACG".index(c)] if i % every == every // 2 else c for i, c in enumerate(seq))


def test_a_diverged_stretch_without_anchors_stays_in_one_match():
    rng = random.Random(2)
    left, middle, right = _dna(rng, 200), _dna(rng, 420), _dna(rng, 200)
    between = _diverged(middle[:210], 10) + "ACGTA" + _diverged(middle[210:], 10)  # no end grows over an indel
    found = matching.pair_matches(left + middle + right, left + between + right, *matching.PRESETS["10"], 100)
    assert [(m["q_start"], m["q_end"], m["r_start"], m["r_end"]) for m in found] == [(0, 820, 0, 825)]


def test_an_unrelated_stretch_divides_a_match():
    rng = random.Random(3)
    left, right = _dna(rng, 200), _dna(rng, 200)
    q, r = left + _dna(rng, 900) + right, left + _dna(rng, 900) + right
    found = sorted(matching.pair_matches(q, r, *matching.PRESETS["10"], 100), key=lambda m: m["q_start"])
    assert [(m["q_start"] < 5, m["q_start"] > 1050) for m in found] == [(True, False), (False, True)]
    assert all(195 <= m["matches"] <= 240 for m in found)
    for m in found:
        assert sum(o["len"] for o in m["cigar"] if o["op"] in "MI") == m["q_end"] - m["q_start"]
        assert sum(o["len"] for o in m["cigar"] if o["op"] in "MD") == m["r_end"] - m["r_start"]


def test_a_repeat_inside_a_better_match_is_a_match_of_its_own():
    rng = random.Random(5)
    repeat = _dna(rng, 200)
    q = _dna(rng, 100) + repeat + _dna(rng, 300) + repeat + _dna(rng, 200)
    found = matching.pair_matches(q, q, *matching.PRESETS["10"], 100)
    places = sorted((m["q_start"], m["r_start"], m["matches"]) for m in found)
    assert len(places) == 3 and places[0] == (0, 0, 1000)
    for (q_start, r_start, n), (x, y) in zip(places[1:], [(100, 600), (600, 100)]):
        assert abs(q_start - x) < 5 and abs(r_start - y) < 5 and 200 <= n < 215


def test_a_match_is_not_repeated_by_what_it_left_over():
    rng = random.Random(6)
    q = _dna(rng, 3000)
    r = "".join(rng.choice("ACGT") if rng.random() < 0.06 else c for c in q)
    assert len(matching.pair_matches(q, r[:1000] + r[1010:2000] + "ACG" + r[2000:], *matching.PRESETS["10"], 100)) == 1


def _changed(rng, seq, every):
    """Substitutions, short indels, one long deletion and one long insertion."""
    out = []
    for c in seq:
        x = rng.randrange(every)
        out.append(rng.choice("ACGT") if x == 0 else "" if x == 1 else c + rng.choice("ACGT") if x == 2 else c)
    s = "".join(out)
    return s[: len(s) // 4] + s[len(s) // 4 + 900 : len(s) // 2] + _dna(rng, 700) + s[len(s) // 2 :]


@pytest.mark.parametrize("every", [30, 200])
def test_long_sequences_are_aligned_between_common_words(every):
    rng = random.Random(every)
    ref = _dna(rng, 30_000)
    qry = _changed(rng, ref, every)
    edit = align.realign(ref, qry)
    assert align.apply(ref, edit) == qry
    # about as many edits as were made
    assert len(edit["subs"]) + len(edit["dels"]) + len(edit["inss"]) < 1.3 * 3 * len(ref) / every + 40
    assert sum(len(i["seq"]) for i in edit["inss"]) < 700 + 3 * len(ref) / every
    for a, b in ((ref, ref), (ref, ref[::-1]), ("A" * 5000, "A" * 4000), (ref[:9000] + ref[:9000], ref[:9000])):
        assert align.apply(a, align.realign(a, b)) == b


def test_stretches_beyond_the_matrix_are_one_deletion_and_one_insertion(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(align, "CELLS", 10_000)
    a, b = _dna(rng, 3000), _dna(rng, 2500)
    assert align.apply(a, align.realign(a, b)) == b


def test_substitutions_of_the_majority_mend_edits(make_graph):
    """Two of three nodes have T at 1: the consensus takes it, the third gets the old letter; the genomes stay."""
    from strandloom.operators.sequences import node_sequences
    from strandloom.plans.build import reconsensus

    sub = lambda *s: {"subs": [{"pos": p, "alt": a} for p, a in s], "dels": [], "inss": []}
    gap = {"subs": [], "dels": [{"pos": 0, "len": 3}], "inss": []}
    g = make_graph({"a": "1+", "b": "1+", "c": "1+", "d": "1+"}, {"1": "ACGT"}, edits={1: sub((1, "T"), (3, "A")), 2: sub((1, "T")), 3: sub((1, "T")), 4: gap}, circular=False)
    before = {r["node_id"]: r["seq"] for r in node_sequences(g).collect()}
    h = reconsensus(g)
    assert h.blocks.head()["consensus"] == "ATGT"
    assert {r["node_id"]: r["seq"] for r in node_sequences(h).collect()} == before
    edits = {r["node_id"]: r["edit"] for r in h.alignments.collect()}
    assert [tuple(s) for s in edits["1"]["subs"]] == [(3, "A")] and not edits["2"]["subs"] and [tuple(d) for d in edits["4"]["dels"]] == [(0, 3)]

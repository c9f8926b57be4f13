"""Files in and out, and builds that give their genomes back."""

import gzip
import lzma
import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.operators import quality
from strandloom.operators.align import apply, realign
from strandloom.operators.matching import pair_matches, reverse_complement
from strandloom.plans import build
from strandloom.sources import fasta, gfa, graph_json, tabular

from .conftest import rows

TEXT = "skipped\n>a first one\nacgt\n  ACG \n\n>b\n>c  \nNNRY\r\nAC\n"
WANT = [(0, "a", "first one", "ACGTACG"), (1, "b", None, ""), (2, "c", None, "NNRYAC")]


@pytest.mark.parametrize("pack", [("fa", lambda b: b), ("fa.gz", gzip.compress), ("fa.xz", lzma.compress)])
def test_fasta(spark, tmp_path, pack):
    p, q = tmp_path / f"one.{pack[0]}", tmp_path / f"two.{pack[0]}"
    p.write_bytes(pack[1](TEXT[8:].encode()))
    q.write_bytes(pack[1](b">d x\nAA\nCC"))
    got = fasta.read_fasta(spark, [str(p), str(q)])
    assert rows(got) == [*WANT, (3, "d", "x", "AACC")]


def test_fasta_refuses(spark, tmp_path):
    bad, blank, gap = tmp_path / "bad.fa", tmp_path / "blank.fa", tmp_path / "gap.fa"
    bad.write_text("ACGT\nACGT\n")
    blank.write_text(" \n\n")
    gap.write_text(">a\nAC-GT\n")
    with pytest.raises(fasta.FastaError):
        fasta.read_fasta(spark, [str(bad)])
    assert fasta.read_fasta(spark, [str(blank)]).count() == 0
    with pytest.raises(Exception, match="alphabet"):
        fasta.read_fasta(spark, [str(gap)]).collect()
    assert fasta.read_fasta(spark, [str(gap)], gaps=True).head()["seq"] == "AC-GT"


def test_fasta_out(spark, tmp_path):
    df = spark.createDataFrame(WANT, fasta.SCHEMA)
    fasta.write_fasta(df, str(tmp_path / "out"), order=["rec_index"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == ">a first one\nACGTACG\n>b\n\n>c\nNNRYAC\n"
    for ext in ("fa", "fa.gz", "fa.bz2", "fa.xz", "fa.zst"):
        fasta.write_file(str(tmp_path / "deep" / f"x.{ext}"), "text")
        assert (tmp_path / "deep" / f"x.{ext}").stat().st_size


def test_graph_json_round_trip(spark, make_graph, tmp_path):
    big = "18446744073709551615"
    g = make_graph({"s1": f"{big}+ 2-", "s2": "2+"}, {big: "ACGT", "2": "GGG"}, edits={1: {"subs": [{"pos": 1, "alt": "T"}], "dels": [], "inss": []}})
    doc = graph_json.graph_json(g).head()["json"]
    p = tmp_path / "g.json"
    p.write_text(doc)
    h = graph_json.read_graphs(spark, [str(p)])
    assert rows(h.nodes) == rows(g.nodes) and rows(h.paths) == rows(g.paths)
    assert rows(h.alignments, "block_id", "node_id", "edit") == rows(g.alignments, "block_id", "node_id", "edit")
    graph_json.write_graphs(h, str(tmp_path / "out"))
    gfa.write_gfa(h, str(tmp_path / "gfa"))
    assert list((tmp_path / "gfa").glob("graph_id=0/*.txt"))


@pytest.mark.parametrize("text", ["{", "[]", "{}", '{"paths": {}, "blocks": {}}', '{"paths": {"1": {"id": 1}}, "blocks": {}, "nodes": {}}'])
def test_what_is_no_graph_is_refused(spark, tmp_path, text):
    p = tmp_path / "g.json"
    p.write_text(text)
    with pytest.raises(graph_json.GraphLoadError):
        graph_json.read_graphs(spark, [str(p)])
    with pytest.raises(graph_json.GraphLoadError):
        graph_json.read_graphs(spark, [str(tmp_path / "g.txt")])


def test_match_table(spark, tmp_path):
    p = tmp_path / "m.tsv"
    p.write_text("q\t100\t11\t50\t\tr\t200\t90\t51\t38\t40\t60\t20M 1I\t0.95\t70\n")
    r = tabular.read_matches(spark, str(p)).withColumn("cigar", cg.text(F.col("cigar"))).head()
    assert (r["q_start"], r["q_end"], r["r_start"], r["r_end"], r["forward"], r["cigar"]) == (10, 50, 50, 90, False, "20M1I")
    assert r["divergence"] == pytest.approx(0.05)


def _mutated(rng, seq, rate):
    out = []
    for c in seq:
        x = rng.random()
        out.append(rng.choice("ACGT") if x < rate else "" if x < rate * 1.1 else c + "GT" if x < rate * 1.2 else c)
    return "".join(out)


@pytest.mark.parametrize("forward", [True, False])
def test_planted_homology_is_found(forward):
    rng = random.Random(4)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    core = dna(400)
    other = _mutated(rng, core, 0.08)
    q, r = dna(200) + core + dna(150), dna(90) + (other if forward else reverse_complement(other)) + dna(300)
    m = max(pair_matches(q, r, 15, 10, 300, 50), key=lambda m: m["matches"])
    assert m["forward"] == forward and m["matches"] > 280
    assert sum(o["len"] for o in m["cigar"] if o["op"] in "MI") == m["q_end"] - m["q_start"]
    assert sum(o["len"] for o in m["cigar"] if o["op"] in "MD") == m["r_end"] - m["r_start"]


def test_unrelated_sequences_don_t_match():
    rng = random.Random(9)
    assert pair_matches(*("".join(rng.choice("ACGT") for _ in range(2000)) for _ in range(2)), 15, 10, 300, 50) == []


def test_build_gives_the_genomes_back(spark):
    rng = random.Random(5)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a, b, c, d = (dna(300) for _ in range(4))
    genomes = [a + b + c, _mutated(rng, a, 0.02) + d + c, a + reverse_complement(b) + _mutated(rng, c, 0.02)]
    records = spark.createDataFrame([(i, f"s{i}", None, s) for i, s in enumerate(genomes)], fasta.SCHEMA)
    g = build.build(records, build.Options(verify=True, guide_tree="((s0,s2),s1);"))
    assert build.verify(g, records).count() == 0 and quality.report(g).count() == 0
    assert g.blocks.count() < 9 and g.nodes.count() > g.blocks.count()


def test_one_genome_is_its_own_graph(spark):
    records = spark.createDataFrame([(0, "s", None, "ACGTACGTACGTACGTACGT")], fasta.SCHEMA)
    assert build.build(records).blocks.count() == 1


def test_realigned_letters():
    e = realign("ACGTACGTACGT", "ACGTTACGACGT")
    assert apply("ACGTACGTACGT", e) == "ACGTTACGACGT"


def test_a_file_of_many_splits_keeps_its_order(spark, tmp_path):
    p = tmp_path / "big.fa"
    p.write_text("".join(f">r{i} d\n{'ACGT' * (i % 30)}\nACG\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = fasta.read_fasta(spark, [str(p)])
        assert rows(got.orderBy("rec_index"), "rec_index", "seq_name", "seq") == sorted(((i, f"r{i}", "ACGT" * (i % 30) + "ACG") for i in range(3000)), key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_command_line(spark, make_graph, tmp_path, capsys, monkeypatch):
    import io
    import json

    from strandloom import __main__ as cli

    assert cli.main(["schema"]) == 0
    schema = json.loads(capsys.readouterr().out)
    assert set(schema["required"]) == {"paths", "blocks", "nodes"} and schema["properties"]["nodes"]["additionalProperties"]["properties"]["position"]["items"]["type"] == "integer"
    monkeypatch.setattr(cli, "_session", lambda jobs: spark)
    monkeypatch.setattr("sys.stdin", io.StringIO(">one\nACGTACGTACGTAAAC\n"))
    out = str(tmp_path / "g.json.gz")
    assert cli.main(["build", "-", "-o", out, "-K", "13", "--verify"]) == 0
    assert cli.main(["reconstruct", out]) == 0
    assert capsys.readouterr().out == ">one\nACGTACGTACGTAAAC\n"
    assert cli.main(["export", "block-sequences", out, "-o", str(tmp_path / "blocks")]) == 0
    assert [p.name for p in (tmp_path / "blocks").glob("*.fa")] == ["block_0.fa"]
    assert cli.main(["export", "gfa", out, "-o", f"{tmp_path}/gfa/"]) == 0
    text = "".join(p.read_text() for p in sorted((tmp_path / "gfa").glob("part-*")))
    assert text.startswith("H\t") and "S\t0\t" in text and text.index("# blocks") < text.index("# paths")
    with pytest.raises(SystemExit, match="backbone"):
        cli.main(["export", "junction-context", out])

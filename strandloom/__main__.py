"""Command line: build, export, simplify, reconstruct, schema.

    spark-submit ... -m strandloom build genomes.fa -o graph.json --circular
    spark-submit ... -m strandloom export gfa graph.json -o graph.gfa --no-duplicated
"""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import junctions, sequences, simplify, stats
from strandloom.plans import build
from strandloom.session import application_folder, part_files
from strandloom.sources import fasta, gfa, graph_json


def _session(threads: str | None) -> SparkSession:
    b = SparkSession.builder.appName("strandloom").config("spark.sql.session.timeZone", "UTC")
    if threads:
        b = b.master(f"local[{threads}]")
    return b.getOrCreate()


def _emit(lines: DataFrame, order: list[str], out: str) -> None:
    """Ordered text: a path that ends with a slash is a folder that the executors write, part files following each
    other in order; else rows are streamed through the driver to one file or to the standard output."""
    ordered = lines.orderBy(*order).select("value")
    if out.endswith("/"):
        ordered.write.mode("overwrite").text(out)
    elif out in ("", "-"):
        for r in ordered.toLocalIterator():
            print(r["value"])
    else:
        with fasta.open_out(out) as f:
            for r in ordered.toLocalIterator():
                f.write(f"{r['value']}\n")


def _inputs(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files to read; ``-`` is the standard input, which is stored in the shared folder first."""
    if "-" not in paths:
        return paths
    place = f"{application_folder(spark)}/stdin-{uuid.uuid4().hex}"
    spark.createDataFrame([(sys.stdin.read().removesuffix("\n"),)], "value string").coalesce(1).write.text(place)
    return [f for p in paths for f in (part_files(spark, place) if p == "-" else [p])]


def _name_blocks(spark: SparkSession, folder: str) -> None:
    """Gives the text of each block the name ``block_{id}.fa`` and removes the folders that held it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for held in fs.listStatus(path(folder)):
        name = held.getPath().getName()
        if name.startswith("block_id="):
            for f in fs.listStatus(held.getPath()):
                if f.getPath().getName().startswith("part-"):
                    fs.rename(f.getPath(), path(f"{folder}/block_{name.removeprefix('block_id=')}.fa"))
            fs.delete(held.getPath(), True)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandloom")
    p.add_argument("-j", "--jobs", help="threads of a local session; by default the session decides")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("inputs", nargs="+")
    b.add_argument("-o", "--output", default="-")
    b.add_argument("-l", "--len", type=int, default=100)
    b.add_argument("-a", "--alpha", type=float, default=100.0)
    b.add_argument("-b", "--beta", type=float, default=10.0)
    b.add_argument("-s", "--sensitivity", choices=["5", "10", "20"], default="10")
    b.add_argument("-c", "--circular", action="store_true")
    b.add_argument("-x", "--max-self-map", type=int, default=100)
    b.add_argument("-K", "--kmer-length", type=int, help="letters of a word, instead of the preset's")
    b.add_argument("-k", "--alignment-kernel", choices=["native"], default="native", help="there is one: seeds, chains and banded alignment")
    b.add_argument("--extra-band-width", type=int, default=build.EXTRA_BAND)
    b.add_argument("--max-alignment-attempts", type=int, default=build.ATTEMPTS)
    b.add_argument("--guide-tree")
    b.add_argument("--verify", action="store_true")
    e = sub.add_parser("export")
    e.add_argument("what", choices=["gfa", "block-consensus", "block-sequences", "core-genome", "junction-context"])
    e.add_argument("input")
    e.add_argument("-o", "--output", default="-")
    e.add_argument("--minimum-length", type=int, default=0)
    e.add_argument("--maximum-length", type=int)
    e.add_argument("--minimum-depth", type=int, default=0)
    e.add_argument("--maximum-depth", type=int)
    e.add_argument("--no-duplicated", action="store_true")
    e.add_argument("--include-sequences", action="store_true")
    e.add_argument("--unaligned", action="store_true")
    e.add_argument("--guide-strain")
    s = sub.add_parser("simplify")
    s.add_argument("input")
    s.add_argument("--strains", required=True, help="names, divided by commas")
    s.add_argument("-o", "--output", default="-")
    r = sub.add_parser("reconstruct")
    r.add_argument("input")
    r.add_argument("-o", "--output", default="-")
    r.add_argument("--verify", metavar="FASTA")
    sub.add_parser("schema")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "schema":
        print(graph_json.json_schema())
        return 0
    spark = _session(a.jobs)
    graph = lambda g: graph_json.graph_json(g).select("graph_id", F.col("json").alias("value"))
    if a.command == "build":
        tree = open(a.guide_tree).read() if a.guide_tree else None
        o = build.Options(a.len, a.alpha, a.beta, a.sensitivity, a.circular, a.max_self_map, tree, a.verify, a.kmer_length, a.extra_band_width, a.max_alignment_attempts)
        _emit(graph(build.build(fasta.read_fasta(spark, _inputs(spark, a.inputs)), o)), ["graph_id"], a.output)
        return 0
    g = graph_json.read_graphs(spark, [a.input])
    if a.command == "simplify":
        _emit(graph(simplify.simplify(g, a.strains.split(","))), ["graph_id"], a.output)
    elif a.command == "reconstruct":
        back = sequences.reconstruct(g).withColumn("n", F.col("path_id").cast("decimal(20,0)"))
        if a.verify:
            want = fasta.read_fasta(spark, [a.verify]).select(F.col("seq_name").alias("path_name"), "seq")
            wrong = sequences.compare_genomes(back, want, ["path_name"]).collect()
            for w in wrong:
                print(f"differs: {w['path_name']}", file=sys.stderr)
            return int(bool(wrong))
        lines = back.select("n", F.concat(F.lit(">"), F.coalesce("path_name", "path_id"), F.lit("\n"), "seq").alias("value"))
        _emit(lines, ["n"], a.output)
    elif a.what == "gfa":
        lines = gfa.gfa_lines(g, a.include_sequences, min_len=a.minimum_length, max_len=a.maximum_length, min_depth=a.minimum_depth, max_depth=a.maximum_depth, no_duplicated=a.no_duplicated)
        _emit(lines, ["graph_id", "section", "rank"], a.output)
    elif a.what == "block-consensus":
        rows = g.blocks.select(F.col("block_id").cast("decimal(20,0)").alias("n"), F.concat(F.lit(">"), "block_id", F.lit("\n"), "consensus").alias("value"))
        _emit(rows, ["n"], a.output)
    elif a.what == "block-sequences":
        if a.output == "-":
            raise SystemExit("block sequences need a folder (-o)")
        rows = sequences.block_sequences(g, aligned=not a.unaligned)
        text = rows.select("block_id", F.concat(F.lit(">"), "name", F.lit(" "), "description", F.lit("\n"), "seq").alias("value"))
        text.repartition("block_id").write.mode("overwrite").partitionBy("block_id").text(a.output)
        _name_blocks(spark, a.output)
    elif a.what == "junction-context":
        g = g.stored()
        core = junctions.backbone(g, a.minimum_length or junctions.CORE_LENGTH)
        for r in junctions.refused_graphs(g.walks, core).collect():
            raise SystemExit(f"a path of graph {r['graph_id']} has {r['fewest']} backbone blocks, two are needed")
        lines = gfa.context_lines(junctions.junctions(g.walks, core), stats.block_stats(g))
        _emit(lines, ["graph_id", "section", "value"], a.output)
    else:
        guide = None
        if a.guide_strain:
            found = g.paths.where(F.col("path_name") == a.guide_strain).select("graph_id", "path_id").collect()
            if not found:
                raise SystemExit(f"no path is named {a.guide_strain}")
            guide = {r["graph_id"]: r["path_id"] for r in found}
        rows = sequences.core_alignment(g, guide=guide, aligned=not a.unaligned)
        _emit(rows.select("path_name", F.concat(F.lit(">"), F.coalesce("path_name", "path_id"), F.lit("\n"), "seq").alias("value")), ["path_name"], a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())

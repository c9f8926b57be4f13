"""Round trips of the sources and sinks: what is written and read back, against the tables in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.operators import tree as tr
from strandloom.plans.graph_queries import BASE, LINKS, STEPS
from strandloom.session import application_folder, part_files, read_table
from strandloom.sources import fasta, gfa, graph_json, tabular
from strandloom.tables import Graphs

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return register


def _place(spark: SparkSession) -> str:
    """A new folder among the stored tables of this application, which are removed at its end."""
    return f"{application_folder(spark)}/{uuid.uuid4().hex}"


@query(
    "s1_fasta_read",
    """WITH r AS (SELECT rec_index, arg_max({'s': coalesce(seq, ''), 'n': coalesce(seq_name, '')}, loaded_at) AS v FROM fasta_records WHERE rec_index IS NOT NULL GROUP BY rec_index)
    SELECT row_number() OVER (ORDER BY rec_index) - 1 AS rec_index, 'r' || rec_index AS seq_name, nullif(trim(v.n), '') AS descr, sha256(upper(v.s)) AS seq FROM r""",
)
def s1_fasta_read(spark: SparkSession, folder: str) -> DataFrame:
    """All records written as packed FASTA files and read back: names, descriptions, order over all files, letters."""
    rows = read_table(spark, folder, "fasta_records").where("rec_index is not null").groupBy("rec_index").agg(
        F.max(F.struct("loaded_at", F.coalesce("seq", F.lit("")).alias("seq"), F.coalesce("seq_name", F.lit("")).alias("n"))).alias("v")
    )
    place = _place(spark)
    out = rows.select("rec_index", F.concat(F.lit("r"), "rec_index").alias("seq_name"), F.col("v.n").alias("descr"), F.col("v.seq").alias("seq"))
    fasta.write_fasta(out, place, order=["rec_index"], compression="gzip")
    back = fasta.read_fasta(spark, part_files(spark, place), gaps=True)
    return back.select("rec_index", "seq_name", "descr", F.sha2("seq", 256).alias("seq"))


@query(
    "s8_graph_json_read",
    f"""WITH {BASE} SELECT nd.graph_id, node_id, block_id, path_id, coalesce(strand, '+') AS strand, pos_start, pos_end, md5(consensus) AS block, path_name, circular
    FROM nd JOIN (SELECT graph_id, block_id, consensus FROM blocks) USING (graph_id, block_id) JOIN (SELECT path_id, path_name, circular FROM pt) USING (path_id)""",
)
def s8_graph_json_read(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of all graphs after they were made JSON documents and read back. Names are told apart by their path, since a graph must not use one twice."""
    g = Graphs.load(spark, folder)
    named = g.paths.withColumn("path_name", F.concat_ws("|", "path_id", "path_name"))
    clean = Graphs(g.raw_nodes.where("block_id is not null"), named.withColumn("loaded_at", F.lit(None).cast("timestamp_ntz")), g.blocks)
    place = _place(spark)
    graph_json.graph_json(clean).write.parquet(place)
    back = graph_json.parse_graphs(spark.read.parquet(place))
    own = F.when(F.instr("path_name", "|") > 0, F.regexp_replace("path_name", r"^[0-9]+\|", ""))
    paths = back.paths.select("path_id", own.alias("path_name"), "circular")
    nodes = back.nodes.join(back.blocks.select("graph_id", "block_id", F.md5("consensus").alias("block")), ["graph_id", "block_id"]).join(paths, "path_id")
    return nodes.select("graph_id", "node_id", "block_id", "path_id", "strand", "pos_start", "pos_end", "block", "path_name", "circular")


@query(
    "s10_match_table",
    """SELECT 'p' || l_partkey AS q_name, 400::INT AS q_len, (l_linenumber - 1)::INT AS q_start, (l_linenumber + 99)::INT AS q_end, 's' || l_suppkey AS r_name, 500::INT AS r_len,
       (l_linenumber * 2 - 1)::INT AS r_start, (l_linenumber * 2 + 99)::INT AS r_end, l_quantity::INT AS matches, l_orderkey % 2 = 0 AS forward,
       (l_quantity::INT || 'M' || l_linenumber || 'I') AS cigar, round(l_discount, 6) AS divergence, l_orderkey::INT AS quality FROM lineitem""",
)
def s10_match_table(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines written as a match table of 15 columns and read back; reverse matches are written backwards."""
    c = F.col
    n = lambda x: x.cast("int")
    turned = c("l_orderkey") % 2 != 0
    a, b = c("l_linenumber"), c("l_linenumber") + 99
    out = read_table(spark, folder, "lineitem").select(
        F.concat(F.lit("p"), "l_partkey"), F.lit(400), n(F.when(turned, b).otherwise(a)), n(F.when(turned, a).otherwise(b)), F.lit(""), F.concat(F.lit("s"), "l_suppkey"), F.lit(500),
        n(a * 2), n(a * 2 + 99), n(c("l_quantity")), F.lit(1), n(c("l_orderkey")), F.concat(n(c("l_quantity")).cast("string"), F.lit("M"), n(a).cast("string"), F.lit("I")),
        (1 - c("l_discount")).cast("double"), F.lit(0),
    )
    place = _place(spark)
    out.toDF(*[f"c{i}" for i in range(15)]).write.csv(place, sep="\t")
    from strandloom.functions.cigar import text

    m = tabular.read_matches(spark, place)
    return m.select("q_name", "q_len", "q_start", "q_end", "r_name", "r_len", "r_start", "r_end", "matches", "forward", text(c("cigar")).alias("cigar"), F.round("divergence", 6).alias("divergence"), "quality")


@query("s13_newick", "SELECT s_name AS leaf, (row_number() OVER (ORDER BY s_name) - 1)::INT AS place FROM supplier")
def s13_newick(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves, in order, of a tree over the suppliers after it was written as Newick, read and checked against their names."""
    names = [r[0] for r in read_table(spark, folder, "supplier").select("s_name").orderBy("s_name").collect()]
    tree = tr.attach(tr.parse_newick(tr.to_newick(tr.balanced(names))), names)
    return spark.createDataFrame([(x, i) for i, x in enumerate(tree.leaves())], "leaf string, place int")


@query("s14_table_files", "SELECT 'csv' AS kind, n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 'json', n_nationkey, n_name, n_regionkey FROM nation")
def s14_table_files(spark: SparkSession, folder: str) -> DataFrame:
    """A table written as CSV and as JSON lines, read back by the names of its files."""
    nation = read_table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    csv, lines = f"{_place(spark)}.csv", f"{_place(spark)}.json"
    tabular.write_csv(nation, csv)
    nation.write.json(lines)
    schema = ", ".join(f"{n} {t}" for n, t in nation.dtypes)
    read = lambda kind, p: tabular.read_table_file(spark, p, schema).select(F.lit(kind).alias("kind"), *nation.columns)
    return read("csv", csv).unionByName(read("json", lines))


@query(
    "k8_minimal_gfa",
    f"""WITH {BASE}, {STEPS}, {LINKS} SELECT graph_id, section, sha256(value) AS line FROM (
    SELECT DISTINCT graph_id, 0 AS section, 'H' || chr(9) || 'VN:Z:1.0' AS value FROM st
    UNION ALL SELECT graph_id, 1, concat_ws(chr(9), 'S', block_id, '*', 'LN:i:' || greatest(1, round(len / 10)::BIGINT), 'DP:f:' || count || '.0') FROM st
    UNION ALL SELECT graph_id, 2, concat_ws(chr(9), 'L', block_1, CASE WHEN fwd_1 THEN '+' ELSE '-' END, block_2, CASE WHEN fwd_2 THEN '+' ELSE '-' END, '0M') FROM gl)""",
)
def k8_minimal_gfa(spark: SparkSession, folder: str) -> DataFrame:
    """GFA without sequences, segments drawn at a tenth of their length."""
    from strandloom.operators.stats import block_stats
    from strandloom.operators.walks import graph_links

    g = Graphs.load(spark, folder).stored()
    segs = block_stats(g).select("graph_id", F.col("block_id").alias("segment"), "len", F.col("count").alias("depth"))
    side = lambda i: F.struct(F.col(f"block_{i}").alias("segment"), F.col(f"fwd_{i}").alias("fwd"))
    links = graph_links(g.walks).select("graph_id", side(1).alias("left"), side(2).alias("right"))
    return gfa.minimal_gfa_lines(segs, links, F.col("len") / 10).select("graph_id", "section", F.sha2("value", 256).alias("line"))


@query(
    "o2_gfa_order",
    f"""WITH {BASE}, {STEPS}, {LINKS}, o AS (
    SELECT graph_id, 1 AS section, block_id || '+' AS name, row_number() OVER (PARTITION BY graph_id ORDER BY block_id::UHUGEINT) AS place FROM st
    UNION ALL SELECT graph_id, 2, block_1 || CASE WHEN fwd_1 THEN '+' ELSE '-' END || block_2 || CASE WHEN fwd_2 THEN '+' ELSE '-' END,
       row_number() OVER (PARTITION BY graph_id ORDER BY block_1::UHUGEINT, block_2::UHUGEINT, NOT fwd_1, NOT fwd_2) FROM gl
    UNION ALL SELECT graph_id, 3, path_id || '+', row_number() OVER (PARTITION BY graph_id ORDER BY path_id::UHUGEINT) FROM (SELECT DISTINCT graph_id, path_id FROM w))
    SELECT graph_id, section, name, place::INT AS place FROM o""",
)
def o2_gfa_order(spark: SparkSession, folder: str) -> DataFrame:
    """Order of the lines of every section of the graph export: numeric ids, of equal ids forward before reverse."""
    lines = gfa.gfa_lines(Graphs.load(spark, folder).stored()).where("section > 0 and rank.a >= 0")
    order = Window.partitionBy("graph_id", "section").orderBy("rank")
    part = F.split("value", "\t")
    name = F.when(F.col("section") == 1, F.concat(part[1], F.lit("+"))).when(F.col("section") == 2, F.concat(part[1], part[2], part[3], part[4])).otherwise(F.concat(F.col("rank.a").cast("string"), F.lit("+")))
    return lines.select("graph_id", "section", name.alias("name"), F.row_number().over(order).alias("place"))

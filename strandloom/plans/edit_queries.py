"""Queries of edit arithmetic, cigar extensions, predicates and keyed merges, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.functions import edits as ed
from strandloom.functions.seq import count_n
from strandloom.operators import matches as mt
from strandloom.operators import simplify, walks
from strandloom.plans.graph_queries import BASE, LINKS, RECONSTRUCT, SEQ, STEPS
from strandloom.plans.match_queries import _MATCH_SQL, _matches
from strandloom.session import cut_lineage, read_table
from strandloom.tables import EDIT_TYPE, Graphs, merge_by_key

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


_N = "length(consensus)"
#: Lists without null entries, as the engine reads them.
_CLEAN = """
    ec AS (SELECT graph_id, block_id, node_id, consensus, list_filter(subs, lambda s: s IS NOT NULL) AS subs,
                  list_filter(dels, lambda d: d IS NOT NULL) AS dels, list_filter(inss, lambda i: i IS NOT NULL) AS inss FROM ed)
"""


def _total(items: str, value: str, x: str) -> str:
    return f"coalesce(list_sum(list_transform({items}, lambda {x}: {value})), 0)::INT"


@query(
    "f9_edit_ends",
    f"""WITH {SEQ.strip().rstrip(',')}, {_CLEAN}
    SELECT graph_id, block_id, node_id,
           {_total("list_filter(dels, lambda d: d.pos = 0)", "d.len", "d")} AS first_deleted,
           {_total(f"list_filter(dels, lambda d: d.pos > 0 AND d.pos + d.len = {_N})", "d.len", "d")} AS last_deleted,
           {_total("list_filter(inss, lambda i: i.pos = 0)", "length(i.seq)", "i")} AS first_inserted,
           {_total(f"list_filter(inss, lambda i: i.pos > 0 AND i.pos = {_N})", "length(i.seq)", "i")} AS last_inserted,
           {_total("dels", "d.len", "d")} = {_N} AND len(inss) = 0 AS empty
    FROM ec""",
)
def f9_edit_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Letters deleted and inserted at both ends of every node, and whether nothing of it is left."""
    n, e = F.length("consensus"), F.col("edit")
    return Graphs.load(spark, folder).alignments.select(
        "graph_id", "block_id", "node_id", ed.leading_deleted(e).alias("first_deleted"), ed.trailing_deleted(n, e).alias("last_deleted"),
        ed.leading_inserted(e).alias("first_inserted"), ed.trailing_inserted(n, e).alias("last_inserted"), ed.is_empty(n, e).alias("empty"),
    )


def _text(e: str, prefix: str = "") -> F.Column:
    """An edit as sorted text, for comparisons."""
    c = lambda k: f"{e}.{k}"
    parts = F.concat(
        F.transform(c("subs"), lambda s: F.concat(F.lit("s"), s["pos"].cast("string"), s["alt"])),
        F.transform(c("dels"), lambda d: F.concat(F.lit("d"), d["pos"].cast("string"), F.lit("/"), d["len"].cast("string"))),
        F.transform(c("inss"), lambda i: F.concat(F.lit("i"), i["pos"].cast("string"), i["seq"])),
        F.array(F.lit("")),
    )
    return F.array_join(F.array_sort(parts), ";")


@query(
    "x6_joined_edits",
    f"""WITH {SEQ.strip().rstrip(',')}, {_CLEAN},
    b AS (SELECT *, {_N} AS n, array_to_string(list_concat(list_transform(list_filter(inss, lambda i: i.pos = {_N}), lambda i: i.seq),
                 list_transform(list_filter(inss, lambda i: i.pos = 0), lambda i: i.seq)), '') AS border FROM ec)
    SELECT graph_id, block_id, node_id, array_to_string(list_sort(list_concat(
        list_transform(subs, lambda s: 's' || s.pos || s.alt), list_transform(subs, lambda s: 's' || (s.pos + n) || s.alt),
        list_transform(dels, lambda d: 'd' || d.pos || '/' || d.len), list_transform(dels, lambda d: 'd' || (d.pos + n) || '/' || d.len),
        list_transform(list_filter(inss, lambda i: i.pos <> n), lambda i: 'i' || i.pos || i.seq),
        CASE WHEN border <> '' THEN ['i' || n || border] ELSE [] END,
        list_transform(list_filter(inss, lambda i: i.pos <> 0), lambda i: 'i' || (i.pos + n) || i.seq), [''])), ';') AS edits FROM b""",
)
def x6_joined_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Every edit laid end to end with itself: what it is on a block made of its own block twice."""
    al = Graphs.load(spark, folder).alignments
    n = F.length("consensus")
    return al.withColumn("j", ed.concat_edits(F.col("edit"), n, F.col("edit"))).select("graph_id", "block_id", "node_id", _text("j").alias("edits"))


@query(
    "x8_node_intervals",
    f"""WITH {SEQ.strip().rstrip(',')}, {_CLEAN}, c AS (SELECT *, 30 AS a, least(80, {_N}) AS b, {_N} AS n FROM ec)
    SELECT graph_id, block_id, node_id,
      (a - coalesce(list_sum(list_transform(list_filter(dels, lambda d: d.pos < a), lambda d: least(d.pos + d.len, a) - d.pos)), 0)
         + coalesce(list_sum(list_transform(list_filter(inss, lambda i: i.pos < a), lambda i: length(i.seq))), 0))::INT AS low,
      (b - coalesce(list_sum(list_transform(list_filter(dels, lambda d: d.pos < b), lambda d: least(d.pos + d.len, b) - d.pos)), 0)
         + coalesce(list_sum(list_transform(list_filter(inss, lambda i: i.pos < b OR (b = n AND i.pos = n)), lambda i: length(i.seq))), 0))::INT AS high FROM c""",
)
def x8_node_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Where the interval [30, 80) of its block lies in every node."""
    al = Graphs.load(spark, folder).alignments
    n = F.length("consensus")
    low, high = ed.node_interval(F.col("edit"), F.lit(30), F.least(F.lit(80), n), n)
    return al.select("graph_id", "block_id", "node_id", low.alias("low"), high.alias("high"))


@query(
    "x10_reconciled_edits",
    f"""WITH {SEQ.strip().rstrip(',')}, {_CLEAN},
    v AS (SELECT *, 10 AS p, consensus[11] AS old, CASE consensus[11] WHEN 'A' THEN 'C' ELSE 'A' END AS new, list_filter(subs, lambda s: s.pos = 10) AS mine,
                 len(list_filter(dels, lambda d: 10 >= d.pos AND 10 < d.pos + d.len)) > 0 AS gone FROM ec WHERE {_N} > 10)
    SELECT graph_id, block_id, node_id, array_to_string(list_sort(list_concat(list_transform(
        CASE WHEN len(mine) = 0 AND gone THEN subs WHEN len(mine) = 0 THEN list_append(subs, {{'pos': p, 'alt': old}})
             WHEN mine[1].alt = new THEN list_filter(subs, lambda s: s.pos <> 10) ELSE subs END, lambda s: 's' || s.pos || s.alt),
        list_transform(dels, lambda d: 'd' || d.pos || '/' || d.len), list_transform(inss, lambda i: 'i' || i.pos || i.seq), [''])), ';') AS edits
    FROM v WHERE len(mine) < 2 AND NOT (len(mine) = 1 AND gone)""",
)
def x10_reconciled_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Valid edits after letter 10 of their block has become another one (C for A, A for all else)."""
    al = Graphs.load(spark, folder).alignments.where(F.length("consensus") > 10)
    mine = F.filter("edit.subs", lambda s: s["pos"] == 10)
    gone = F.exists("edit.dels", lambda d: (F.lit(10) >= d["pos"]) & (F.lit(10) < d["pos"] + d["len"]))
    al = al.where((F.size(mine) < 2) & ~((F.size(mine) == 1) & gone))
    old = F.substring("consensus", 11, 1)
    new = F.when(old == "A", "C").otherwise("A")
    return al.withColumn("r", ed.reconcile_substitution(F.col("edit"), F.lit(10), old, new)).select("graph_id", "block_id", "node_id", _text("r").alias("edits"))


@query(
    "a19_unknown_letters",
    "SELECT graph_id, block_id, (length(p) - length(replace(p, 'N', '')))::INT AS n FROM (SELECT graph_id, block_id, substr(consensus, 11, 190) AS p FROM blocks)",
)
def a19_unknown_letters(spark: SparkSession, folder: str) -> DataFrame:
    """Letters N in [10, 200) of every consensus."""
    return read_table(spark, folder, "blocks").select("graph_id", "block_id", count_n(F.col("consensus"), F.lit(10), F.lit(200)).alias("n"))


# ---- cigars and matches made of order lines

_CIGAR = "(l_quantity::INT + 1) || 'M' || (l_partkey % 9 + 1) || 'D' || l_linenumber || 'M'"


@query(
    "x15_extended_cigars",
    f"""WITH l AS (SELECT l_orderkey, l_partkey, l_linenumber, {_CIGAR} AS c, l_orderkey % 2 = 0 AS f, l_partkey % 3 AS al, l_suppkey % 4 AS ar, l_orderkey % 5 AS pl, l_suppkey % 2 AS pr FROM lineitem),
    s AS (SELECT *, CASE WHEN f THEN pl ELSE pr END AS a, CASE WHEN f THEN pr ELSE pl END AS b FROM l)
    SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN a > 0 THEN a || 'I' ELSE '' END || CASE WHEN al > 0 THEN al || 'D' ELSE '' END || c
           || CASE WHEN ar > 0 THEN ar || 'D' ELSE '' END || CASE WHEN b > 0 THEN b || 'I' ELSE '' END AS cigar FROM s""",
)
def x15_extended_cigars(spark: SparkSession, folder: str) -> DataFrame:
    """Cigars of order lines after both sides of their matches grew."""
    n = lambda c: c.cast("string")
    c = F.col
    text = F.concat(n(c("l_quantity").cast("int") + 1), F.lit("M"), n(c("l_partkey") % 9 + 1), F.lit("D"), n(c("l_linenumber")), F.lit("M"))
    grown = cg.extend(cg.parse(text), c("l_orderkey") % 2 == 0, c("l_partkey") % 3, c("l_suppkey") % 4, c("l_orderkey") % 5, c("l_suppkey") % 2)
    return read_table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", cg.text(grown).alias("cigar"))


@query(
    "m11_energy_by_length",
    f"""WITH m AS ({_MATCH_SQL}), e AS (SELECT *, -matches + 100.0::DOUBLE * (4 - (q_start = 0)::INT - (q_end = q_len)::INT - (r_start = 0)::INT - (r_end = r_len)::INT)
          + 10.0::DOUBLE * coalesce(divergence, 0) * matches AS energy FROM m WHERE matches >= 150)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(energy, 6) AS energy FROM e WHERE energy < 0""",
)
def m11_energy_by_length(spark: SparkSession, folder: str) -> DataFrame:
    """Matches of order lines of negative energy by the older form, which refuses those under 150 letters."""
    kept = _matches(spark, folder).withColumn("energy", mt.energy_by_length(150)).where("energy < 0")
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("energy", 6).alias("energy"))


@query(
    "g12_block_hits",
    f"""WITH m AS (SELECT *, {_CIGAR.replace('l_quantity::INT', '(matches // 8)')} AS cigar, l_orderkey % 2 = 0 AS f, l_suppkey % 3 = 0 AS q_anchor FROM ({_MATCH_SQL}))
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, r_name AS block, r_start AS start, r_end AS "end", NOT q_anchor AS is_anchor, f AS forward, cigar FROM m
    UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, q_name, q_start, q_end, q_anchor, f,
       CASE WHEN f THEN (matches // 8 + 1) || 'M' || (l_partkey % 9 + 1) || 'I' || l_linenumber || 'M'
            ELSE l_linenumber || 'M' || (l_partkey % 9 + 1) || 'I' || (matches // 8 + 1) || 'M' END FROM m""",
)
def g12_block_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Matches of order lines seen from both their blocks; roles and directions of cigars follow."""
    c, n = F.col, lambda x: x.cast("string")
    text = F.concat(n((c("matches") / 8).cast("int") + 1), F.lit("M"), n(c("l_partkey") % 9 + 1), F.lit("D"), n(c("l_linenumber")), F.lit("M"))
    m = _matches(spark, folder).withColumns({"cigar": cg.parse(text), "forward": c("l_orderkey") % 2 == 0, "anchor": F.when(c("l_suppkey") % 3 == 0, "qry").otherwise("ref")})
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    hits = mt.hits_of_blocks(m, keys)
    return hits.select(*keys, "block", "start", "end", "is_anchor", "forward", cg.text(c("cigar")).alias("cigar"))


@query(
    "j10_merged_tables",
    "SELECT coalesce(c_custkey, s_suppkey) AS key, coalesce(c_name, s_name) AS name FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey",
)
def j10_merged_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and suppliers as one table by key; of a key in both the customer counts."""
    left = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    right = read_table(spark, folder, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return merge_by_key(left, right, ["key"], "name", "left")


# ---- contraction, where every path is a graph of its own

_ALONE = f"""{BASE}, pw AS (SELECT path_id AS graph_id, path_id, circular, ord, block_id, fwd FROM w),
    {STEPS.replace("FROM w ", "FROM pw ")}, {LINKS},
    dp AS (SELECT graph_id, block_id, count(*) AS depth FROM pw GROUP BY ALL),
    te AS (SELECT gl.graph_id, block_1, fwd_1, block_2, fwd_2, count FROM gl JOIN dp d1 ON d1.graph_id = gl.graph_id AND d1.block_id = block_1
           JOIN dp d2 ON d2.graph_id = gl.graph_id AND d2.block_id = block_2 WHERE block_1 <> block_2 AND count = d1.depth AND count = d2.depth)"""


def paths_alone(g: Graphs) -> Graphs:
    """Every path as a graph of its own, numbered by its id: its walk, its nodes and the blocks that it holds."""
    held = cut_lineage(g.walks)
    nodes = held.select("node_id", F.col("path_id").alias("graph_id"), "block_id", "path_id", F.when(F.col("fwd"), "+").otherwise("-").alias("strand"), "pos_start", "pos_end")
    paths = g.paths.withColumn("graph_id", F.col("path_id"))
    mine = held.select("graph_id", "block_id", "path_id").distinct()
    blocks = g.blocks.select("graph_id", "block_id", "consensus").join(mine, ["graph_id", "block_id"]).select(F.col("path_id").alias("graph_id"), "block_id", "consensus")
    edits = g.alignments.select("block_id", "node_id", F.col("edit").cast(EDIT_TYPE).alias("edit")).join(held.select("node_id", F.col("path_id").alias("graph_id")), "node_id")
    lists = held.groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id"))), lambda x: x["node_id"]).alias("nodes"))
    paths = paths.drop("nodes").join(lists, "path_id")
    return simplify.bundle(nodes, paths, blocks, edits.select("graph_id", "block_id", "node_id", "edit"))


@query("g21_edges_of_paths", f"WITH {_ALONE} SELECT graph_id, block_1, fwd_1, block_2, fwd_2, count FROM te")
def g21_edges_of_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Transitive edges of every path taken as a graph: all edges between blocks that it holds once."""
    return walks.transitive_edges(paths_alone(Graphs.load(spark, folder)).stored().walks)


@query(
    "g22_contracted_paths",
    f"""WITH RECURSIVE {_ALONE}, ud AS (SELECT graph_id, block_1 AS a, block_2 AS b FROM te UNION SELECT graph_id, block_2, block_1 FROM te),
    vs AS (SELECT DISTINCT pw.graph_id, pw.block_id, len FROM pw JOIN (SELECT DISTINCT graph_id AS g, path_id FROM w) x ON x.path_id = pw.graph_id JOIN bl ON bl.graph_id = g AND bl.block_id = pw.block_id),
    rch AS (SELECT graph_id, block_id AS v, block_id AS u FROM vs UNION SELECT r.graph_id, r.v, ud.b FROM rch r JOIN ud ON ud.graph_id = r.graph_id AND ud.a = r.u),
    cm AS (SELECT graph_id, v AS block_id, min(u) AS c FROM rch GROUP BY ALL)
    SELECT graph_id, (list(block_id ORDER BY len DESC, block_id::UHUGEINT))[1] AS block_id, sum(len)::INT AS len FROM cm JOIN vs USING (graph_id, block_id) GROUP BY graph_id, c""",
)
def g22_contracted_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of every path after its transitive edges are contracted."""
    return simplify.contract(paths_alone(Graphs.load(spark, folder))).blocks.select("graph_id", "block_id", F.length("consensus").alias("len"))


@query(
    "g24_contracted_walks",
    f"""WITH {BASE}, {SEQ.strip().rstrip(",")}, {RECONSTRUCT.strip()}
    SELECT rk.path_id, CASE WHEN NOT circular AND off = 0 THEN sha256(joined) END AS seq, length(joined) AS n FROM rk JOIN pt ON pt.path_id = rk.path_id""",
)
def g24_contracted_walks(spark: SparkSession, folder: str) -> DataFrame:
    """Genomes read back from contracted graphs of one path each.

    What a circular path, or one whose first letters are unknown, begins with may change where its
    places have gaps: of those only the length is given.
    """
    from strandloom.operators.sequences import reconstruct

    g = Graphs.load(spark, folder).stored()
    first = g.walks.join(g.alignments.select("node_id"), "node_id", "left_semi").groupBy("path_id", "circular").agg(F.min(F.struct("ord", "pos_start"))["pos_start"].alias("off"))
    back = reconstruct(simplify.contract(paths_alone(g))).join(first, "path_id").where(F.length("seq") > 0)
    return back.select("path_id", F.when(~F.col("circular") & (F.col("off") == 0), F.sha2("seq", 256)).alias("seq"), F.length("seq").alias("n"))


# ---- the merge passes of a build, on the graphs of the tables


@query("g20_merged_genomes", ORACLE["g24_contracted_walks"])
def g20_merged_genomes(spark: SparkSession, folder: str) -> DataFrame:
    """Genomes read back after all graphs went through merge passes until no match was left: found, taken, sliced, realigned, contracted.

    Of paths that may begin elsewhere afterwards only the length is given, as for contraction.
    """
    from strandloom.operators.sequences import reconstruct
    from strandloom.plans.build import Options, self_merge

    g = Graphs.load(spark, folder).stored()
    first = g.walks.join(g.alignments.select("node_id"), "node_id", "left_semi").groupBy("path_id", "circular").agg(F.min(F.struct("ord", "pos_start"))["pos_start"].alias("off"))
    clean = simplify.bundle(
        g.nodes.where("block_id is not null"), g.paths, g.blocks, g.alignments.select("graph_id", "block_id", "node_id", F.col("edit").cast(EDIT_TYPE).alias("edit"))
    )
    back = reconstruct(self_merge(clean, Options(length=50, alpha=10.0))).join(first, "path_id").where(F.length("seq") > 0)
    return back.select("path_id", F.when(~F.col("circular") & (F.col("off") == 0), F.sha2("seq", 256)).alias("seq"), F.length("seq").alias("n"))

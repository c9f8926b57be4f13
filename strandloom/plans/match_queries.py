"""Queries of exports, sketches, intervals, cigars and match arithmetic, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.functions import edits as ed
from strandloom.functions import seq as sq
from strandloom.operators import matches as mt
from strandloom.operators import matching, simplify, sketch, stats
from strandloom.plans import build
from strandloom.plans.graph_queries import BASE, LINKS, SEQ, STEPS
from strandloom.session import cut_lineage, read_table
from strandloom.sources import gfa, graph_json
from strandloom.tables import Graphs

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


# ---- exports

_SIGN = "CASE WHEN {} THEN '+' ELSE '-' END"


def _gfa_sql(walk: str, segments: str) -> str:
    """Lines of the export over the walk table ``walk``; ``segments`` selects from the block statistics."""
    steps = STEPS.replace("FROM w ", f"FROM {walk} ")
    s1, s2, sp = (_SIGN.format(c) for c in ("fwd_1", "fwd_2", "fwd"))
    return f"""WITH {BASE}, sg AS (SELECT * FROM st {segments}),
    fw AS (SELECT graph_id, path_id, circular, ord, block_id, fwd FROM w SEMI JOIN sg USING (graph_id, block_id)), {steps}, {LINKS},
    lines AS (
      SELECT graph_id, 1 AS section, 'S' || chr(9) || block_id || chr(9) || consensus || chr(9) || 'RC:i:' || count * len || chr(9) || 'LN:i:' || len
             || CASE WHEN duplicated THEN chr(9) || 'TP:Z:duplicated' ELSE '' END AS value
      FROM sg JOIN (SELECT graph_id, block_id, consensus FROM blocks) USING (graph_id, block_id)
      UNION ALL SELECT graph_id, 2, concat_ws(chr(9), 'L', block_1, {s1}, block_2, {s2}, '*', 'RC:i:' || count) FROM gl
      UNION ALL SELECT graph_id, 3, 'P' || chr(9) || coalesce(path_name, path_id) || chr(9) || steps || chr(9) || '*'
             || CASE WHEN circular THEN chr(9) || 'TP:Z:circular' ELSE '' END
      FROM (SELECT graph_id, path_id, string_agg(block_id || {sp}, ',' ORDER BY ord) AS steps FROM fw GROUP BY ALL) JOIN (SELECT path_id, path_name, circular FROM pt) USING (path_id))
    SELECT graph_id, section, sha256(value) AS line FROM lines
    UNION ALL SELECT DISTINCT graph_id, section, sha256(CASE section WHEN 1 THEN '# blocks' WHEN 2 THEN '# edges' ELSE '# paths' END) FROM lines
    UNION ALL SELECT DISTINCT graph_id, 0, sha256('H' || chr(9) || 'VN:Z:1.0') FROM pt"""


@query("k6_gfa_lines", _gfa_sql("fw", ""))
def k6_gfa_lines(spark: SparkSession, folder: str) -> DataFrame:
    """GFA lines of all graphs; lines are compared by their digest."""
    return gfa.gfa_lines(Graphs.load(spark, folder).stored()).select("graph_id", "section", F.sha2("value", 256).alias("line"))


@query("k7_gfa_filtered", _gfa_sql("fw", "WHERE len >= 200 AND count >= 3 AND NOT duplicated"))
def k7_gfa_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """The same for blocks of 200 letters and three nodes or more that no path holds twice, walks linked anew."""
    lines = gfa.gfa_lines(Graphs.load(spark, folder).stored(), min_len=200, min_depth=3, no_duplicated=True)
    return lines.select("graph_id", "section", F.sha2("value", 256).alias("line"))


@query("k1_graph_json")
def k1_graph_json(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON document per graph."""
    return graph_json.graph_json(Graphs.load(spark, folder))


@query(
    "k3_block_consensus",
    "SELECT graph_id, block_id, '>' || block_id || chr(10) || consensus AS record FROM blocks",
)
def k3_block_consensus(spark: SparkSession, folder: str) -> DataFrame:
    """FASTA records of the block consensus export."""
    b = read_table(spark, folder, "blocks")
    return b.select("graph_id", "block_id", F.concat(F.lit(">"), "block_id", F.lit("\n"), "consensus").alias("record"))


_CHAINS = f"""{BASE}, {STEPS}, {LINKS}, dp AS (SELECT graph_id, block_id, count(*) AS depth FROM w GROUP BY ALL),
    ud AS (SELECT gl.graph_id, block_1 AS a, block_2 AS b FROM gl JOIN dp d1 ON d1.graph_id = gl.graph_id AND d1.block_id = block_1
           JOIN dp d2 ON d2.graph_id = gl.graph_id AND d2.block_id = block_2 WHERE block_1 <> block_2 AND count = d1.depth AND count = d2.depth),
    rch AS (SELECT graph_id, block_id AS v, block_id AS u FROM bl UNION SELECT r.graph_id, r.v, CASE WHEN ud.a = r.u THEN ud.b ELSE ud.a END FROM rch r JOIN ud ON ud.graph_id = r.graph_id AND (ud.a = r.u OR ud.b = r.u)),
    cm AS (SELECT graph_id, v AS block_id, min(u) AS c FROM rch GROUP BY ALL)"""


@query(
    "g22_contracted",
    f"""WITH RECURSIVE {_CHAINS} SELECT graph_id, (list(block_id ORDER BY len DESC, block_id::UHUGEINT))[1] AS block_id, sum(len)::INT AS len FROM cm JOIN bl USING (graph_id, block_id) GROUP BY graph_id, c""",
)
def g22_contracted(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of all graphs after their transitive edges are contracted."""
    return simplify.contract(Graphs.load(spark, folder)).blocks.select("graph_id", "block_id", F.length("consensus").alias("len"))


@query(
    "g23_kept_paths",
    f"""WITH {BASE}, kp AS (SELECT * FROM pt WHERE circular),
    kn AS (SELECT nd.* FROM nd SEMI JOIN kp USING (path_id))
    SELECT b.graph_id, b.block_id, count(*) AS depth FROM (SELECT graph_id, block_id FROM blocks) b
    JOIN kn ON kn.graph_id = b.graph_id AND kn.block_id = b.block_id GROUP BY ALL""",
)
def g23_kept_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Depth of the blocks that remain when only circular paths are kept."""
    g = Graphs.load(spark, folder)
    return stats.block_depth(simplify.keep_paths(g, g.paths.where("circular")))


@query("g7_block_matches")
def g7_block_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Matches between different blocks of a graph."""
    found = matching.find_matches(read_table(spark, folder, "blocks"))
    return found.withColumn("cigar", cg.text(F.col("cigar")))


def _block_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Matches between blocks of one graph, under names that tell the graphs apart."""
    found = matching.find_matches(read_table(spark, folder, "blocks"))
    name = lambda c: F.concat_ws("|", "graph_id", c)
    return found.withColumns({"q_name": name("q_name"), "r_name": name("r_name")})


@query("g9_split_matches")
def g9_split_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The same matches divided at indels of 20 letters and more."""
    return mt.split_matches(_block_matches(spark, folder), 20).withColumn("cigar", cg.text(F.col("cigar")))


@query("g10_accepted_matches")
def g10_accepted_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Matches of negative energy that don't overlap a better one, with the anchor side of each."""
    g = Graphs.load(spark, folder)
    kept = mt.greedy(cut_lineage(mt.candidates(mt.split_matches(_block_matches(spark, folder), 50), alpha=10.0)))
    depth = g.alignments.groupBy("graph_id", "block_id").agg(F.count("*").alias("depth"))
    blocks = g.blocks.join(depth, ["graph_id", "block_id"]).select(F.concat_ws("|", "graph_id", "block_id").alias("name"), "depth", "consensus")
    return mt.anchors(kept, blocks).withColumn("cigar", cg.text(F.col("cigar")))


@query(
    "g1_singletons",
    """SELECT rec_index AS graph_id, rec_index::VARCHAR AS block_id, rec_index::VARCHAR AS path_id, length(s) AS pos_end, sha256(upper(s)) AS consensus
       FROM (SELECT rec_index, arg_max(seq, loaded_at) AS s FROM fasta_records GROUP BY 1) WHERE s <> ''""",
)
def g1_singletons(spark: SparkSession, folder: str) -> DataFrame:
    """One graph of one block, node and path for every record with letters."""
    rows = read_table(spark, folder, "fasta_records").groupBy("rec_index").agg(F.max(F.struct("loaded_at", "seq", "seq_name", "descr")).alias("last"))
    g = build.singletons(rows.select("rec_index", "last.seq_name", "last.descr", "last.seq").where("seq <> ''"), circular=False)
    nodes = g.nodes.join(g.blocks, ["graph_id", "block_id"])
    return nodes.select("graph_id", "block_id", "path_id", "pos_end", F.sha2("consensus", 256).alias("consensus"))


@query(
    "f8_projected_paths",
    f"WITH {BASE} SELECT graph_id, path_id, path_name FROM pt WHERE path_name IS NOT NULL",
)
def f8_projected_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of all names in the tables: the projection takes a list or a table of names."""
    g = Graphs.load(spark, folder)
    return stats.project(g, path_names(g))


def path_names(g: Graphs) -> DataFrame:
    return g.paths.where("path_name IS NOT NULL").select("path_name").distinct()


@query(
    "x13_cigar_edits",
    """SELECT l_orderkey, l_partkey, l_linenumber, (q || '/' || d) AS dels, ((q + d) || ':' || repeat('N', i)) AS inss
       FROM (SELECT *, l_quantity::INT + 1 AS q, l_partkey % 9 + 1 AS d, l_suppkey % 4 + 1 AS i FROM lineitem)""",
)
def x13_cigar_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Edits of the cigars made of order lines."""
    li = read_table(spark, folder, "lineitem")
    n = lambda c: c.cast("string")
    text = F.concat(n(F.col("l_quantity").cast("int") + 1), F.lit("M"), n(F.col("l_partkey") % 9 + 1), F.lit("D"), n(F.col("l_suppkey") % 4 + 1), F.lit("I"), n(F.col("l_linenumber")), F.lit("M"))
    e = li.select("l_orderkey", "l_partkey", "l_linenumber", cg.to_edit(cg.parse(text)).alias("e"))
    return e.select(
        "l_orderkey", "l_partkey", "l_linenumber",
        F.array_join(F.transform("e.dels", lambda d: F.concat(n(d["pos"]), F.lit("/"), n(d["len"]))), ",").alias("dels"),
        F.array_join(F.transform("e.inss", lambda i: F.concat(n(i["pos"]), F.lit(":"), i["seq"])), ",").alias("inss"),
    )


# ---- sketches

K, W = 15, 100


def _word(start: str, letter: str, back: bool) -> str:
    terms = []
    for i in range(K):
        code = f"(instr('ACGT', {letter}[p + {i}]) - 1)"
        terms.append(f"((3 - {code}) * {1 << (2 * i)})" if back else f"({code} * {1 << (2 * (K - 1 - i))})")
    return "(" + " + ".join(terms) + ")"


def _hash(x: str) -> list[str]:
    m = (1 << (2 * K)) - 1
    return [
        f"((((-1 - {x}) & {m}) + ({x} << 21)) & {m})",
        "xor(x, x >> 24)",
        f"((x + (x << 3) + (x << 8)) & {m})",
        "xor(x, x >> 14)",
        f"((x + (x << 2) + (x << 4)) & {m})",
        "xor(x, x >> 28)",
        f"((x + (x << 31)) & {m})",
    ]


def _sketch_sql() -> str:
    there, back = _word("p", "s", False), _word("p", "s", True)
    ctes = [
        "rc AS (SELECT rec_index, translate(upper(arg_max(seq, loaded_at)), 'U', 'T') AS s FROM fasta_records GROUP BY 1)",
        f"ws AS (SELECT rec_index, s, unnest(range(1, greatest(1, length(s) - {K - 2}))) AS p FROM rc WHERE length(s) >= {K})",
        f"wd AS (SELECT rec_index, p, {there} AS a, {back} AS b FROM ws WHERE NOT regexp_matches(s[p:p + {K - 1}], '[^ACGT]'))",
        f"h0 AS (SELECT rec_index, p, least(a, b)::BIGINT AS x FROM wd WHERE a <> b)",
    ]
    for i, step in enumerate(_hash("x")):
        ctes.append(f"h{i + 1} AS (SELECT rec_index, p, {step}::BIGINT AS x FROM h{i})")
    ctes.append(
        f"mn AS (SELECT rec_index, x, row_number() OVER o AS r, count(*) OVER (PARTITION BY rec_index) AS n, "
        f"min(x) OVER (PARTITION BY rec_index ORDER BY p ROWS {W - 1} PRECEDING) AS value FROM h{len(_hash('x'))} WINDOW o AS (PARTITION BY rec_index ORDER BY p))"
    )
    ctes.append(f"sk AS (SELECT DISTINCT rec_index, value FROM mn WHERE r >= {W} OR (n < {W} AND r = n))")
    return ",\n".join(ctes)


def _records(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "fasta_records").groupBy("rec_index").agg(F.max(F.struct("loaded_at", "seq")).alias("last"))
    return rows.select("rec_index", F.upper("last.seq").alias("seq"))


@query("g2_sketch", f"WITH {_sketch_sql()} SELECT rec_index, value FROM sk")
def g2_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """Values of the minimizer sketches of all records."""
    return sketch.sketch(_records(spark, folder), "rec_index", "seq", K, W).select("rec_index", "value").distinct()


@query(
    "a20_sketch_distances",
    f"""WITH {_sketch_sql()}, sz AS (SELECT rec_index, count(*) AS n FROM sk GROUP BY 1)
    SELECT x.rec_index AS a, y.rec_index AS b, count(*) AS shared, 1 - count(*) / max(n) AS distance
    FROM sk x JOIN sk y ON x.value = y.value AND x.rec_index < y.rec_index JOIN sz ON sz.rec_index = x.rec_index GROUP BY 1, 2""",
)
def a20_sketch_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Distances of all records that share a minimizer."""
    return sketch.sketch_distances(sketch.sketch(_records(spark, folder), "rec_index", "seq", K, W), "rec_index")


# ---- intervals, cigars, match arithmetic on the star-schema tables

_HITS = """
    ln AS (SELECT path_id AS block, tot_len AS len, len(nodes) = 1 AS alone FROM pt),
    hw AS (SELECT path_id AS block, pos_start AS s, pos_end AS e, len, circular AND (pos_end < pos_start OR (pos_end = pos_start AND alone)) AS wraps FROM w JOIN ln ON block = path_id),
    hs AS (SELECT block, s AS start, CASE WHEN wraps THEN len ELSE e END AS "end" FROM hw WHERE CASE WHEN wraps THEN len ELSE e END > s
           UNION ALL SELECT block, 0, e FROM hw WHERE wraps AND e > 0)
"""
_INTERVALS = """
    gp AS (SELECT block, coalesce(lag("end") OVER (PARTITION BY block ORDER BY start), 0) AS s, start AS e, "end" AS he FROM hs),
    iv AS (SELECT block, s AS start, e AS "end", false AS aligned FROM gp WHERE e > s
           UNION ALL SELECT block, e, he, true FROM gp
           UNION ALL SELECT ln.block, coalesce(m, 0), len, false FROM ln LEFT JOIN (SELECT block, max("end") AS m FROM hs GROUP BY 1) x ON x.block = ln.block WHERE len > coalesce(m, 0))
"""


def node_hits(g: Graphs) -> tuple[DataFrame, DataFrame]:
    """Places of all nodes on their paths, and the paths' lengths.

    A node over the origin of a circular path is two hits; one that is the whole circle may begin
    where it ends. Other nodes without letters are no hit.
    """
    lengths = g.paths.select(F.col("path_id").alias("block"), F.col("tot_len").alias("len"), (F.size("nodes") == 1).alias("alone"))
    places = g.walks.select(F.col("path_id").alias("block"), "circular", F.col("pos_start").alias("start"), F.col("pos_end").alias("end")).join(lengths, "block")
    wraps = F.col("circular") & ((F.col("end") < F.col("start")) | ((F.col("end") == F.col("start")) & F.col("alone")))
    part = lambda a, b: F.struct(F.col(a).alias("start") if a else F.lit(0).cast("bigint").alias("start"), F.col(b).alias("end"))
    parts = F.when(wraps, F.array(part("start", "len"), part(None, "end"))).otherwise(F.array(part("start", "end")))
    hits = places.select("block", F.explode(parts).alias("p")).select("block", "p.start", "p.end")
    return hits.where(F.col("end") > F.col("start")), lengths.drop("alone")


@query("w5_block_intervals", f'WITH {BASE}, {_HITS}, {_INTERVALS} SELECT block, start, "end", aligned FROM iv')
def w5_block_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """All paths divided into their nodes and the gaps between."""
    return mt.block_intervals(*node_hits(Graphs.load(spark, folder)))


@query(
    "w6_refined_intervals",
    f"""WITH {BASE}, {_HITS}, {_INTERVALS},
    nr AS (SELECT *, "end" - start AS size, coalesce(lag("end" - start) OVER o, -1) AS bf, coalesce(lead("end" - start) OVER o, -1) AS af,
                  row_number() OVER o AS n FROM iv WINDOW o AS (PARTITION BY block ORDER BY start)),
    tg AS (SELECT *, CASE WHEN aligned OR size >= 400 OR (bf < 0 AND af < 0) THEN n WHEN bf >= af THEN n - 1 ELSE n + 1 END AS t FROM nr)
    SELECT block, min(start) AS start, max("end") AS "end", bool_or(aligned AND n = t) AS aligned,
           coalesce(sum(size) FILTER (n < t), 0)::BIGINT AS extend_left, coalesce(sum(size) FILTER (n > t), 0)::BIGINT AS extend_right
    FROM tg GROUP BY block, t""",
)
def w6_refined_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """The same with gaps under 400 letters given to their longer neighbour."""
    return mt.refine_intervals(mt.block_intervals(*node_hits(Graphs.load(spark, folder))), 400)


_MATCH_SQL = """SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey, 'p' || l_partkey AS q_name, 'p' || l_suppkey AS r_name, 200 + l_partkey % 300 AS q_len, 200 + l_suppkey % 300 AS r_len,
    l_linenumber % 3 * 10 AS q_start, 200 + l_partkey % 300 - l_linenumber % 2 * 5 AS q_end, l_orderkey % 2 * 7 AS r_start, 200 + l_suppkey % 300 - l_orderkey % 3 AS r_end,
    (l_quantity * 8)::INT AS matches, CASE WHEN l_orderkey % 5 > 0 THEN l_discount END AS divergence FROM lineitem"""


def _matches(spark: SparkSession, folder: str) -> DataFrame:
    li = read_table(spark, folder, "lineitem")
    c = F.col
    return li.select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", F.concat(F.lit("p"), "l_partkey").alias("q_name"), F.concat(F.lit("p"), "l_suppkey").alias("r_name"),
        (200 + c("l_partkey") % 300).alias("q_len"), (200 + c("l_suppkey") % 300).alias("r_len"), (c("l_linenumber") % 3 * 10).alias("q_start"),
        (200 + c("l_partkey") % 300 - c("l_linenumber") % 2 * 5).alias("q_end"), (c("l_orderkey") % 2 * 7).alias("r_start"), (200 + c("l_suppkey") % 300 - c("l_orderkey") % 3).alias("r_end"),
        (c("l_quantity") * 8).cast("int").alias("matches"), F.when(c("l_orderkey") % 5 > 0, c("l_discount")).alias("divergence"),
    )


@query(
    "m10_match_energy",
    f"""WITH m AS ({_MATCH_SQL}), e AS (SELECT *, -matches + 100.0::DOUBLE * (4 - (q_start = 0)::INT - (q_end = q_len)::INT - (r_start = 0)::INT - (r_end = r_len)::INT)
          + 10.0::DOUBLE * coalesce(divergence, 0) * matches AS energy FROM m)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(energy, 6) AS energy FROM e WHERE q_name <> r_name AND energy < 0""",
)
def m10_match_energy(spark: SparkSession, folder: str) -> DataFrame:
    """Energies of matches made of order lines; those of different sides and negative energy."""
    kept = mt.candidates(_matches(spark, folder))
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("energy", 6).alias("energy"))


@query(
    "x22_integer_hash",
    "WITH h0 AS (SELECT o_orderkey, o_custkey AS x FROM orders), "
    + ", ".join(f"h{i + 1} AS (SELECT o_orderkey, {s}::BIGINT AS x FROM h{i})" for i, s in enumerate(_hash("x")))
    + f" SELECT o_orderkey, x AS hash FROM h{len(_hash('x'))}",
)
def x22_integer_hash(spark: SparkSession, folder: str) -> DataFrame:
    """The invertible hash as an expression of the engine."""
    return read_table(spark, folder, "orders").select("o_orderkey", sq.integer_hash(F.col("o_custkey"), (1 << (2 * K)) - 1).alias("hash"))


@query(
    "a17_cigar_sums",
    """SELECT l_orderkey, l_partkey, l_linenumber, (q + 1 + l_linenumber)::INT AS matched, (q + 1 + l_linenumber + l_partkey % 9 + 1 + l_suppkey % 4 + 1)::INT AS total,
       (l_linenumber || 'M' || (l_suppkey % 4 + 1) || 'D' || (l_partkey % 9 + 1) || 'I' || (q + 1) || 'M') AS turned
       FROM (SELECT *, l_quantity::INT AS q FROM lineitem)""",
)
def a17_cigar_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Matched and total length of cigars made of order lines, and each cigar read backwards."""
    li = read_table(spark, folder, "lineitem")
    text = F.concat((F.col("l_quantity").cast("int") + 1).cast("string"), F.lit("M \t"), (F.col("l_partkey") % 9 + 1).cast("string"), F.lit("D"),
                    (F.col("l_suppkey") % 4 + 1).cast("string"), F.lit("I"), F.col("l_linenumber").cast("string"), F.lit("M"))
    c = li.select("l_orderkey", "l_partkey", "l_linenumber", cg.parse(text).alias("c"))
    turned = cg.text(cg.swap_sides(cg.invert(F.col("c"))))
    return c.select("l_orderkey", "l_partkey", "l_linenumber", cg.match_length(F.col("c")).alias("matched"), cg.total_length(F.col("c")).alias("total"), turned.alias("turned"))


@query(
    "x17_rotated_consensus",
    "SELECT graph_id, block_id, sha256(consensus[37 % length(consensus) + 1:] || consensus[:37 % length(consensus)]) AS rotated FROM blocks",
)
def x17_rotated_consensus(spark: SparkSession, folder: str) -> DataFrame:
    """Every consensus turned left by 37 letters."""
    b = read_table(spark, folder, "blocks")
    return b.select("graph_id", "block_id", F.sha2(sq.rotate_left(F.col("consensus"), F.lit(37)), 256).alias("rotated"))


@query(
    "x7_sliced_edits",
    f"""WITH {BASE}, {SEQ}, cut AS (SELECT *, 30 AS a, least(80, length(consensus)) AS b FROM ed)
    SELECT graph_id, block_id, node_id,
      coalesce(list_aggregate(list_transform(list_filter(subs, lambda s: s IS NOT NULL AND s.pos >= a AND s.pos < b), lambda s: (s.pos - a) || s.alt), 'string_agg', ','), '') AS subs,
      coalesce(list_aggregate(list_transform(list_filter(dels, lambda d: d IS NOT NULL AND d.pos < b AND d.pos + d.len > a),
          lambda d: (greatest(d.pos, a) - a) || '/' || (least(d.pos + d.len, b) - greatest(d.pos, a))), 'string_agg', ','), '') AS dels,
      coalesce(list_aggregate(list_transform(list_filter(inss, lambda i: i IS NOT NULL AND i.pos >= a AND (i.pos < b OR (b = length(consensus) AND i.pos = b))),
          lambda i: (i.pos - a) || i.seq), 'string_agg', ','), '') AS inss
    FROM cut""",
)
def x7_sliced_edits(spark: SparkSession, folder: str) -> DataFrame:
    """All edits inside the interval [30, 80) of their blocks."""
    al = Graphs.load(spark, folder).alignments
    n = F.length("consensus")
    s = al.withColumn("s", ed.slice_edit(F.col("edit"), F.lit(30), F.least(F.lit(80), n), n))
    text = lambda c, f: F.array_join(F.transform(c, f), ",")
    return s.select(
        "graph_id", "block_id", "node_id",
        text("s.subs", lambda x: F.concat(x["pos"].cast("string"), x["alt"])).alias("subs"),
        text("s.dels", lambda x: F.concat(x["pos"].cast("string"), F.lit("/"), x["len"].cast("string"))).alias("dels"),
        text("s.inss", lambda x: F.concat(x["pos"].cast("string"), x["seq"])).alias("inss"),
    )


@query(
    "x9_new_positions",
    f"""WITH {BASE} SELECT node_id, CASE WHEN c THEN ((s % tot_len) + tot_len) % tot_len ELSE s END AS new_start, CASE WHEN c THEN ((e % tot_len) + tot_len) % tot_len ELSE e END AS new_end
    FROM (SELECT w.node_id, tot_len, w.circular AS c, CASE WHEN fwd THEN pos_start + 10 ELSE pos_end - 60 END AS s, CASE WHEN fwd THEN pos_start + 60 ELSE pos_end - 10 END AS e
          FROM w JOIN pt USING (path_id) WHERE tot_len > 0)""",
)
def x9_new_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Place on the path of letters 10 to 60 of every node."""
    g = Graphs.load(spark, folder)
    w = g.walks.join(g.paths.select("path_id", "tot_len"), "path_id").where("tot_len > 0")
    s, e = ed.new_position(F.col("pos_start"), F.col("pos_end"), F.lit(10), F.lit(60), F.col("fwd"), F.col("tot_len"), F.col("circular"))
    return w.select("node_id", s.alias("new_start"), e.alias("new_end"))

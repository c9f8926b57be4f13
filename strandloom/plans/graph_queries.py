"""Queries of the graph operators over whole tables, and the same in SQL.

Names tell the operator of the inventory that a query exercises (q: analysis, a: aggregate, w: walk,
f: filter, g: graph, x: sequence, m: match). All graphs of the tables are answered at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import edits as ed
from strandloom.functions import seq as sq
from strandloom.operators import consensus, junctions, quality, sequences, stats, synteny, walks
from strandloom.operators.components import connected_components
from strandloom.session import cut_lineage, read_table
from strandloom.sources import gfa
from strandloom.tables import Graphs

QUERIES: dict = {}
ORACLE: dict = {}

#: Common table expressions of the cleaned graph.
BASE = """
    nd AS (SELECT DISTINCT node_id, graph_id, block_id, path_id, strand, pos_start, pos_end FROM nodes),
    pt AS (SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY path_id ORDER BY loaded_at DESC) = 1),
    pn AS (SELECT graph_id, path_id, circular, unnest(nodes) AS node_id, generate_subscripts(nodes, 1) - 1 AS ord FROM pt),
    w AS (SELECT pn.graph_id, pn.path_id, circular, ord, node_id, block_id, coalesce(strand, '+') = '+' AS fwd, pos_start, pos_end
          FROM pn JOIN (SELECT node_id, block_id, strand, pos_start, pos_end FROM nd WHERE block_id IS NOT NULL) USING (node_id)),
    bl AS (SELECT graph_id, block_id, length(consensus) AS len FROM blocks),
    pp AS (SELECT graph_id, block_id, path_id, count(*) AS n FROM w GROUP BY ALL),
    np AS (SELECT graph_id, count(DISTINCT path_id) AS n_paths FROM w GROUP BY ALL),
    bs AS (SELECT graph_id, block_id, sum(n)::BIGINT AS count, count(*) AS n_strains, sum(n) > count(*) AS duplicated,
                  sum(n) = count(*) AND count(*) = any_value(n_paths) AS core
           FROM pp JOIN np USING (graph_id) GROUP BY ALL),
    st AS (SELECT * FROM bs JOIN bl USING (graph_id, block_id)),
    nb AS (SELECT graph_id, block_id FROM st WHERE NOT duplicated AND len >= 200
           AND n_strains >= 0.5 * (SELECT max(n_paths) FROM np WHERE np.graph_id = st.graph_id))
"""
#: Consecutive places, circular walks closed; ``nx`` is the next (block, direction).
STEPS = """
    s0 AS (SELECT graph_id, path_id, ord, block_id AS b1, fwd AS f1,
                  coalesce(lead(block_id) OVER o, CASE WHEN circular THEN first_value(block_id) OVER o END) AS b2,
                  coalesce(lead(fwd) OVER o, CASE WHEN circular THEN first_value(fwd) OVER o END) AS f2,
                  count(*) OVER (PARTITION BY path_id) AS n
           FROM w WINDOW o AS (PARTITION BY path_id ORDER BY ord)),
    s AS (SELECT * FROM s0 WHERE b2 IS NOT NULL)
"""
TEXT = """
    t AS (SELECT *, b1 || CASE WHEN f1 THEN '_f' ELSE '_r' END || '__' || b2 || CASE WHEN f2 THEN '_f' ELSE '_r' END AS own,
                    b2 || CASE WHEN f2 THEN '_r' ELSE '_f' END || '__' || b1 || CASE WHEN f1 THEN '_r' ELSE '_f' END AS inv
          FROM s WHERE n > 1)
"""
LINKS = """
    gl AS (SELECT graph_id, CASE WHEN keep THEN b1 ELSE b2 END AS block_1, CASE WHEN keep THEN f1 ELSE NOT f2 END AS fwd_1,
                  CASE WHEN keep THEN b2 ELSE b1 END AS block_2, CASE WHEN keep THEN f2 ELSE NOT f1 END AS fwd_2, count(*) AS count
           FROM (SELECT *, b1::UHUGEINT < b2::UHUGEINT OR (b1 = b2 AND f1) AS keep FROM s) GROUP BY ALL)
"""
#: Junctions over the backbone table ``nb``.
JUNCTIONS = """
    jm AS (SELECT w.*, nb.block_id IS NOT NULL AS is_core,
                  count(nb.block_id) OVER (PARTITION BY path_id ORDER BY ord) AS run,
                  count(nb.block_id) OVER (PARTITION BY path_id) AS n_core
           FROM w LEFT JOIN nb ON nb.graph_id = w.graph_id AND nb.block_id = w.block_id),
    ji AS (SELECT *, CASE WHEN circular AND run = 0 THEN n_core ELSE run END AS idx, (circular AND run = 0)::INT AS late FROM jm),
    jc AS (SELECT graph_id, path_id, circular, n_core, idx,
                  max(block_id) FILTER (is_core) AS lb, bool_or(fwd) FILTER (is_core) AS lf,
                  coalesce(list(block_id ORDER BY late, ord) FILTER (NOT is_core), []) AS cb,
                  coalesce(list(fwd ORDER BY late, ord) FILTER (NOT is_core), []) AS cf
           FROM ji GROUP BY ALL),
    jr AS (SELECT *, coalesce(lead(lb) OVER o, CASE WHEN circular THEN first_value(lb) OVER o END) AS rb,
                  coalesce(lead(lf) OVER o, CASE WHEN circular THEN first_value(lf) OVER o END) AS rf
           FROM jc WINDOW o AS (PARTITION BY path_id ORDER BY idx)),
    jk AS (SELECT *, lb || CASE WHEN lf THEN '_f' ELSE '_r' END || '__' || rb || CASE WHEN rf THEN '_f' ELSE '_r' END AS own,
                     rb || CASE WHEN rf THEN '_r' ELSE '_f' END || '__' || lb || CASE WHEN lf THEN '_r' ELSE '_f' END AS inv
           FROM jr WHERE lb IS NOT NULL AND rb IS NOT NULL
           AND graph_id NOT IN (SELECT graph_id FROM jc WHERE n_core < 2)),
    j AS (SELECT graph_id, path_id, idx, least(own, inv) AS edge, own <= inv AS "natural", lb, rb, cb,
                 array_to_string(CASE WHEN own <= inv
                   THEN list_transform(range(1, len(cb) + 1), lambda i: cb[i] || CASE WHEN cf[i] THEN '_f' ELSE '_r' END)
                   ELSE list_transform(range(len(cb), 0, -1), lambda i: cb[i] || CASE WHEN cf[i] THEN '_r' ELSE '_f' END) END, '~') AS center_key
          FROM jk QUALIFY row_number() OVER (PARTITION BY graph_id, least(own, inv), path_id ORDER BY idx DESC) = 1)
"""


SEQ = """
    al AS (SELECT graph_id, block_id, consensus, unnest(map_entries(alignments)) AS e FROM blocks),
    ed AS (SELECT graph_id, block_id, consensus, e.key AS node_id, coalesce(e.value.subs, []) AS subs, coalesce(e.value.dels, []) AS dels,
                  coalesce(e.value.inss, []) AS inss FROM al WHERE e.value IS NOT NULL),
    x0 AS (SELECT graph_id, block_id, node_id, consensus, inss, dels,
                  list_reduce(list_concat([consensus], list_transform(list_filter(subs, lambda s: s IS NOT NULL), lambda s: s.pos || ':' || s.alt)),
                    lambda acc, s: acc[:split_part(s, ':', 1)::INT] || split_part(s, ':', 2) || acc[split_part(s, ':', 1)::INT + 2:]) AS c1 FROM ed),
    x1 AS (SELECT graph_id, block_id, node_id, consensus, inss,
                  list_reduce(list_concat([c1], list_transform(list_filter(dels, lambda d: d IS NOT NULL), lambda d: d.pos || ':' || d.len)),
                    lambda acc, d: acc[:split_part(d, ':', 1)::INT] || repeat('-', split_part(d, ':', 2)::INT)
                                   || acc[split_part(d, ':', 1)::INT + split_part(d, ':', 2)::INT + 1:]) AS c2 FROM x0),
    x2 AS (SELECT *, replace(list_reduce(list_concat([c2], list_transform(list_reverse_sort(list_transform(list_filter(inss, lambda i: i IS NOT NULL),
                       lambda i: lpad(i.pos::VARCHAR, 9, '0') || ':' || i.seq)), lambda i: i)),
                    lambda acc, i: acc[:split_part(i, ':', 1)::INT] || split_part(i, ':', 2) || acc[split_part(i, ':', 1)::INT + 1:]), '-', '') AS raw FROM x1)
"""

#: Queries that read the walk table once; for the others it is stored before they read it again.
ONCE = {
    "a1_block_depth", "q2_block_counts", "q1_strains", "s9_duplicate_names", "o7_longest_block", "q4_path_dictionary", "a6_graph_links", "a6_edge_counts",
    "a8_walk_categories", "q5_pairwise_content", "x1_reverse_complement", "q7_block_alignment", "q7_node_sequences", "x5_reversed_edits", "a18_edit_lengths",
    "a9_majority_substitutions", "a10_majority_deletions", "a11_majority_insertions", "g19_new_consensus", "g25_reconstruct", "k4_block_sequences", "w8_gaps", "j5_overlaps",
    "g28_components",
}


def query(name: str, sql: str | None = None, *parts: str):
    """Registers a query of (graphs) -> DataFrame, with its SQL after the common expressions."""

    def load(spark, folder):
        g = Graphs.load(spark, folder)
        return g if name in ONCE else g.stored()

    def register(f):
        QUERIES[name] = lambda spark, folder: f(load(spark, folder))
        if sql is not None:
            ORACLE[name] = f"WITH {','.join((BASE, *parts))} {sql}"  # SQL that begins with a comma adds expressions
        return f

    return register


def near_core(g: Graphs) -> DataFrame:
    """Backbone used by the queries: single-copy blocks of half the paths or more, 200 letters and more."""
    return cut_lineage(junctions.backbone(g, 200, ~F.col("duplicated") & (F.col("n_strains") >= 0.5 * F.col("n_paths"))))


# ---- counts and statistics

query("q3_block_stats", "SELECT graph_id, block_id, count, n_strains, duplicated, core, len FROM st")(stats.block_stats)
query("a1_block_depth", "SELECT graph_id, block_id, count(*) AS depth FROM w GROUP BY ALL")(stats.block_depth)
query("q2_block_counts", "SELECT graph_id, block_id, path_id, n AS count FROM pp")(stats.block_counts)
query(
    "q5_pairwise_content",
    """, h AS (SELECT graph_id, path_id, block_id, len FROM pp JOIN bl USING (graph_id, block_id)),
    tot AS (SELECT graph_id, path_id, sum(len) AS total FROM h GROUP BY ALL),
    sh AS (SELECT a.graph_id, a.path_id AS path_i, b.path_id AS path_j, sum(a.len) AS shared
           FROM h a JOIN h b ON a.graph_id = b.graph_id AND a.block_id = b.block_id GROUP BY ALL)
    SELECT a.graph_id, a.path_id AS path_i, b.path_id AS path_j, coalesce(shared, 0)::BIGINT AS shared,
           (a.total + b.total - 2 * coalesce(shared, 0))::BIGINT AS diff
    FROM tot a JOIN tot b USING (graph_id)
    LEFT JOIN sh ON sh.graph_id = a.graph_id AND path_i = a.path_id AND path_j = b.path_id""",
)(stats.pairwise_content)
query(
    "q8_pangenome_size",
    """SELECT graph_id, count(*) AS n_blocks, sum(len)::BIGINT AS pangenome_len,
       coalesce(sum(len) FILTER (core), 0)::BIGINT AS core_len, count(*) FILTER (core) AS n_core FROM st GROUP BY ALL""",
)(stats.pangenome_size)
query("q8_frequency_spectrum", "SELECT graph_id, n_strains, sum(len)::BIGINT AS len, count(*) AS n_blocks FROM st GROUP BY ALL")(
    stats.frequency_spectrum
)
query(
    "f3_strict_core",
    """SELECT graph_id, block_id FROM bs JOIN (SELECT graph_id, count(*) AS total FROM pt GROUP BY ALL) USING (graph_id)
       WHERE n_strains = total AND count = total""",
)(stats.strict_core)
query("q1_strains", "SELECT graph_id, path_id, path_name FROM pt")(stats.strains)
query("s9_duplicate_names", "SELECT graph_id, path_name, count(*) AS n FROM pt WHERE path_name IS NOT NULL GROUP BY ALL HAVING count(*) > 1")(
    stats.duplicate_names
)
query(
    "o7_longest_block",
    "SELECT graph_id, block_id, len FROM bl QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY len DESC, block_id) = 1",
)(stats.longest_block)


@query(
    "q4_path_dictionary",
    "SELECT graph_id, path_id, string_agg(block_id || CASE WHEN fwd THEN '+' ELSE '-' END, ',' ORDER BY ord) AS walk FROM w GROUP BY ALL",
)
def q4_path_dictionary(g: Graphs) -> DataFrame:
    text = F.array_join(F.transform("walk", lambda s: F.concat(s["block_id"], F.when(s["fwd"], "+").otherwise("-"))), ",")
    return stats.path_dictionary(g).select("graph_id", "path_id", text.alias("walk"))


# ---- walks and edges

query("a6_graph_links", "SELECT * FROM gl", STEPS, LINKS)(lambda g: walks.graph_links(g.walks))
query("a6_edge_counts", "SELECT graph_id, least(own, inv) AS edge, count(*) AS count FROM t GROUP BY ALL", STEPS, TEXT)(
    lambda g: walks.edge_counts(g.walks)
)
query(
    "g21_transitive_edges",
    """, d AS (SELECT graph_id, block_id, count(*) AS depth FROM w GROUP BY ALL)
    SELECT gl.graph_id, block_1, fwd_1, block_2, fwd_2, count FROM gl
    JOIN d d1 ON d1.graph_id = gl.graph_id AND d1.block_id = block_1 JOIN d d2 ON d2.graph_id = gl.graph_id AND d2.block_id = block_2
    WHERE block_1 <> block_2 AND count = d1.depth AND count = d2.depth""",
    STEPS,
    LINKS,
)(lambda g: walks.transitive_edges(g.walks))


@query(
    "a8_walk_categories",
    """, e AS (SELECT graph_id, path_id, string_agg(block_id || CASE WHEN fwd THEN '_f' ELSE '_r' END, ',' ORDER BY ord) AS walk
               FROM w GROUP BY ALL)
    SELECT graph_id, sha256(walk) AS walk_key, count(*) AS count, min(path_id) AS first_path FROM e GROUP BY ALL""",
)
def a8_walk_categories(g: Graphs) -> DataFrame:
    return walks.walk_categories(g.walks).drop("paths")


query(
    "f6_filtered_walks",
    """SELECT graph_id, path_id, node_id, (row_number() OVER (PARTITION BY path_id ORDER BY ord) - 1)::INT AS ord
       FROM w SEMI JOIN nb USING (graph_id, block_id)""",
)(lambda g: walks.filter_walks(g.walks, near_core(g)).select("graph_id", "path_id", "node_id", "ord"))


@query(
    "w3_rotated_walks",
    """, fo AS (SELECT graph_id, min(block_id) AS focal FROM nb GROUP BY ALL),
    q AS (SELECT w.*, focal, row_number() OVER (PARTITION BY path_id ORDER BY ord) - 1 AS r, count(*) OVER (PARTITION BY path_id) AS n
          FROM w JOIN fo USING (graph_id) WHERE circular),
    z AS (SELECT *, min(r) FILTER (block_id = focal AND fwd) OVER (PARTITION BY path_id) AS f,
                 max(r) FILTER (block_id = focal AND NOT fwd) OVER (PARTITION BY path_id) AS b FROM q)
    SELECT graph_id, path_id, node_id,
           (CASE WHEN f IS NOT NULL THEN (r - f + n) % n ELSE (b - r + n) % n END)::BIGINT AS ord,
           CASE WHEN f IS NOT NULL THEN fwd ELSE NOT fwd END AS fwd
    FROM z WHERE f IS NOT NULL OR b IS NOT NULL""",
)
def w3_rotated_walks(g: Graphs) -> DataFrame:
    focal = near_core(g).groupBy("graph_id").agg(F.min("block_id").alias("block_id"))
    turned = walks.rotate_walks(g.walks.where("circular"), focal)
    return turned.select("graph_id", "path_id", "node_id", F.col("ord").cast("bigint").alias("ord"), "fwd")


# ---- junctions and synteny


def _junctions(g: Graphs) -> DataFrame:
    return cut_lineage(junctions.junctions(g.walks, near_core(g)))


query("q11_junctions", 'SELECT graph_id, edge, path_id, "natural", center_key FROM j', JUNCTIONS)(
    lambda g: _junctions(g).select("graph_id", "edge", "path_id", "natural", "center_key")
)
query(
    "q12_junction_stats",
    """, cat AS (SELECT graph_id, edge, center_key, count(*) AS n FROM j GROUP BY ALL),
    e AS (SELECT graph_id, edge, sum(n)::BIGINT AS n_isolates, coalesce(sum(n) FILTER (center_key <> ''), 0)::BIGINT AS n_non_empty,
                 count(*) AS n_categories, max(n) AS n_majority_category FROM cat GROUP BY ALL),
    acc AS (SELECT graph_id, edge, sum(len)::BIGINT AS accessory_length FROM (SELECT DISTINCT graph_id, edge, unnest(cb) AS block_id FROM j)
            JOIN bl USING (graph_id, block_id) GROUP BY ALL)
    SELECT e.graph_id, e.edge, n_isolates, n_non_empty, n_categories, n_majority_category, n_categories = 1 AS is_transitive,
           n_isolates > 1 AND n_majority_category = n_isolates - 1 AS is_singleton,
           l.len AS left_core_length, r.len AS right_core_length, coalesce(accessory_length, 0)::BIGINT AS accessory_length
    FROM e LEFT JOIN acc USING (graph_id, edge)
    JOIN bl l ON l.graph_id = e.graph_id AND l.block_id = regexp_extract(e.edge, '^([0-9]+)_', 1)
    JOIN bl r ON r.graph_id = e.graph_id AND r.block_id = regexp_extract(e.edge, '__([0-9]+)_', 1)""",
    JUNCTIONS,
)(lambda g: junctions.junction_stats(_junctions(g), g.block_lengths))
query(
    "q13_junction_positions",
    """SELECT j.graph_id, edge, j.path_id, l.pos_start AS left_start, l.pos_end AS left_end, r.pos_start AS right_start, r.pos_end AS right_end,
              "natural" AS strand
       FROM j JOIN w l ON l.path_id = j.path_id AND l.block_id = lb JOIN w r ON r.path_id = j.path_id AND r.block_id = rb""",
    JUNCTIONS,
)(lambda g: junctions.junction_positions(_junctions(g), g.walks))
query(
    "q17_junction_bars",
    """, x AS (SELECT graph_id, edge, path_id, unnest(string_split(center_key, '~')) AS k, generate_subscripts(string_split(center_key, '~'), 1) - 1 AS place
              FROM j WHERE center_key <> ''),
    y AS (SELECT *, left(k, length(k) - 2) AS block_id, k LIKE '%_f' AS fwd FROM x)
    SELECT graph_id, edge, path_id, place::INT AS place, block_id, fwd,
           (sum(len) OVER (PARTITION BY graph_id, edge, path_id ORDER BY place) - len)::BIGINT AS start,
           (sum(len) OVER (PARTITION BY graph_id, edge, path_id ORDER BY place))::BIGINT AS "end"
    FROM y JOIN bl USING (graph_id, block_id)""",
    JUNCTIONS,
)(lambda g: sequences.junction_bars(_junctions(g), g.block_lengths))
query(
    "a13_consensus_edges",
    """, cw AS (SELECT w.* FROM w SEMI JOIN nb USING (graph_id, block_id)),
    c0 AS (SELECT graph_id, path_id, block_id AS b1, fwd AS f1, count(*) OVER (PARTITION BY path_id) AS n,
                  coalesce(lead(block_id) OVER o, CASE WHEN circular THEN first_value(block_id) OVER o END) AS b2,
                  coalesce(lead(fwd) OVER o, CASE WHEN circular THEN first_value(fwd) OVER o END) AS f2
           FROM cw WINDOW o AS (PARTITION BY path_id ORDER BY ord)),
    c1 AS (SELECT *, b1 || CASE WHEN f1 THEN '_f' ELSE '_r' END || '__' || b2 || CASE WHEN f2 THEN '_f' ELSE '_r' END AS own,
                  b2 || CASE WHEN f2 THEN '_r' ELSE '_f' END || '__' || b1 || CASE WHEN f1 THEN '_r' ELSE '_f' END AS inv
           FROM c0 WHERE b2 IS NOT NULL AND n > 1)
    SELECT graph_id, least(own, inv) AS edge, count(DISTINCT path_id) AS n_isolates FROM c1 JOIN np USING (graph_id)
    GROUP BY ALL HAVING count(DISTINCT path_id) > max(n_paths) / 2""",
)(lambda g: junctions.consensus_edges(g.walks, near_core(g)))


CONTEXT = """
    lab AS (SELECT graph_id, edge, 'J' || (row_number() OVER (PARTITION BY graph_id ORDER BY edge) - 1) AS label FROM (SELECT DISTINCT graph_id, edge FROM j)),
    cx AS (SELECT j.graph_id, label, cb, list_concat([split_part(j.edge, '__', 1)], CASE WHEN center_key = '' THEN [] ELSE list_transform(string_split(center_key, '~'), lambda t: label || '_' || t) END,
                  [split_part(j.edge, '__', 2)]) AS st FROM j JOIN lab ON lab.graph_id = j.graph_id AND lab.edge = j.edge)
"""


@query("q15_context_segments", "SELECT graph_id, label || '_' || b AS segment, count(*) AS depth FROM (SELECT graph_id, label, unnest(cb) AS b FROM cx) GROUP BY ALL", JUNCTIONS, CONTEXT)
def q15_context_segments(g: Graphs) -> DataFrame:
    js = _junctions(g)
    return junctions.context_links(js, js)[0]


@query(
    "q15_context_links",
    """SELECT DISTINCT graph_id, left(x, length(x) - 2) AS left_segment, right(x, 1) = 'f' AS left_fwd, left(y, length(y) - 2) AS right_segment, right(y, 1) = 'f' AS right_fwd
       FROM (SELECT graph_id, st[i] AS x, st[i + 1] AS y FROM (SELECT graph_id, st, unnest(range(1, len(st))) AS i FROM cx))""",
    JUNCTIONS,
    CONTEXT,
)
def q15_context_links(g: Graphs) -> DataFrame:
    js = _junctions(g)
    links = junctions.context_links(js, js)[1]
    side = lambda s: [F.col(f"{s}.segment").alias(f"{s}_segment"), F.col(f"{s}.fwd").alias(f"{s}_fwd")]
    return links.select("graph_id", *side("left"), *side("right"))


@query(
    "q15_context_gfa",
    """SELECT graph_id, section, sha256(value) AS line FROM (
       SELECT DISTINCT graph_id, 0 AS section, 'H' || chr(9) || 'VN:Z:1.0' AS value FROM cx
       UNION ALL SELECT s.graph_id, 1, concat_ws(chr(9), 'S', segment, '*', 'LN:i:' || greatest(1, len), 'DP:f:' || depth || '.0') FROM (
         SELECT graph_id, label || '_' || b AS segment, b, count(*) AS depth FROM (SELECT graph_id, label, unnest(cb) AS b FROM cx) GROUP BY ALL
         UNION ALL SELECT e.graph_id, e.b, e.b, st.count FROM (SELECT DISTINCT graph_id, left(unnest([st[1], st[len(st)]]), -2) AS b FROM cx) e JOIN st ON st.graph_id = e.graph_id AND st.block_id = e.b) s
         JOIN bl ON bl.graph_id = s.graph_id AND bl.block_id = s.b
       UNION ALL SELECT DISTINCT graph_id, 2, concat_ws(chr(9), 'L', left(x, -2), CASE WHEN right(x, 1) = 'f' THEN '+' ELSE '-' END, left(y, -2), CASE WHEN right(y, 1) = 'f' THEN '+' ELSE '-' END, '0M')
         FROM (SELECT graph_id, st[i] AS x, st[i + 1] AS y FROM (SELECT graph_id, st, unnest(range(1, len(st))) AS i FROM cx)))""",
    JUNCTIONS,
    CONTEXT,
)
def q15_context_gfa(g: Graphs) -> DataFrame:
    """Lines of the junction-context graph of every graph."""
    lines = gfa.context_lines(_junctions(g), stats.block_stats(g))
    return lines.select("graph_id", "section", F.sha2("value", 256).alias("line"))


@query(
    "q14_junction_sequences",
    """, pw AS (SELECT path_id, block_id, node_id, fwd, row_number() OVER (PARTITION BY path_id ORDER BY ord) - 1 AS r, count(*) OVER (PARTITION BY path_id) AS n FROM w),
    e AS (SELECT j.*, a.r AS lo, b.r AS ro, a.n FROM j JOIN pw a ON a.path_id = j.path_id AND a.block_id = lb JOIN pw b ON b.path_id = j.path_id AND b.block_id = rb),
    s AS (SELECT graph_id, edge, path_id, "natural" AS nat, lo, n, unnest(range(0, CASE WHEN ro >= lo THEN ro - lo ELSE ro - lo + n END + 1)) AS i FROM e),
    p AS (SELECT s.*, pw.node_id, pw.fwd FROM s JOIN pw ON pw.path_id = s.path_id AND pw.r = (lo + i) % s.n)
    SELECT p.graph_id, edge, path_id, sha256(string_agg(CASE WHEN fwd = nat THEN raw ELSE reverse(translate(raw, 'ACGTYRWSKMDVHBN', 'TGCARYWSMKHBDVN')) END, '' ORDER BY CASE WHEN nat THEN i ELSE -i END)) AS seq
    FROM p JOIN x2 USING (node_id) GROUP BY ALL""",
    JUNCTIONS,
    SEQ,
)
def q14_junction_sequences(g: Graphs) -> DataFrame:
    return junctions.junction_sequences(_junctions(g), sequences.node_sequences(g), g.walks).withColumn("seq", F.sha2("seq", 256))


# ---- the strict backbone: core blocks of 500 letters and more

_STRICT = BASE[: BASE.index("nb AS (")] + "nb AS (SELECT graph_id, block_id FROM st WHERE core AND len >= 500)"


def strict(name: str, sql: str, *parts: str):
    def register(f):
        QUERIES[name] = lambda spark, folder: f(Graphs.load(spark, folder).stored())
        ORACLE[name] = f"WITH {','.join((_STRICT, *parts))} {sql}"
        return f

    return register


strict("f7_backbone", "SELECT graph_id, block_id, len FROM nb JOIN bl USING (graph_id, block_id)")(junctions.backbone)
strict("f7_backbone_walks", "SELECT graph_id, path_id, node_id, (row_number() OVER (PARTITION BY path_id ORDER BY ord) - 1)::INT AS ord FROM w SEMI JOIN nb USING (graph_id, block_id)")(
    lambda g: walks.filter_walks(g.walks, junctions.backbone(g)).select("graph_id", "path_id", "node_id", "ord")
)
strict("q11_strict_junctions", 'SELECT graph_id, edge, path_id, "natural", center_key FROM j', JUNCTIONS)(
    lambda g: junctions.junctions(g.walks, junctions.backbone(g)).select("graph_id", "edge", "path_id", "natural", "center_key")
)
strict("q11_refused_graphs", "SELECT graph_id, min(n_core) AS fewest FROM (SELECT graph_id, path_id, count(nb.block_id) AS n_core FROM w LEFT JOIN nb USING (graph_id, block_id) GROUP BY ALL) GROUP BY ALL HAVING min(n_core) < 2")(
    lambda g: junctions.refused_graphs(g.walks, junctions.backbone(g))
)


COMPONENTS = """
    , c0 AS (SELECT graph_id, path_id, block_id AS b1, fwd AS f1, count(*) OVER (PARTITION BY path_id) AS n,
                  coalesce(lead(block_id) OVER o, CASE WHEN circular THEN first_value(block_id) OVER o END) AS b2,
                  coalesce(lead(fwd) OVER o, CASE WHEN circular THEN first_value(fwd) OVER o END) AS f2
           FROM (SELECT w.* FROM w SEMI JOIN nb USING (graph_id, block_id)) WINDOW o AS (PARTITION BY path_id ORDER BY ord)),
    c1 AS (SELECT graph_id, least(b1, b2) AS a, greatest(b1, b2) AS b, count(*) AS c,
                  least(b1 || f1 || b2 || f2, b2 || (NOT f2) || b1 || (NOT f1)) AS e
           FROM c0 WHERE b2 IS NOT NULL AND n > 1 AND b1 <> b2 GROUP BY ALL),
    m AS (SELECT DISTINCT c1.graph_id, a, b FROM c1 JOIN bs x ON x.graph_id = c1.graph_id AND x.block_id = a
          JOIN bs y ON y.graph_id = c1.graph_id AND y.block_id = b WHERE c = x.count AND c = y.count),
    ud AS (SELECT graph_id, a, b FROM m UNION SELECT graph_id, b, a FROM m),
    rch AS (SELECT graph_id, block_id AS v, block_id AS u FROM nb UNION SELECT r.graph_id, r.v, ud.b FROM rch r JOIN ud ON ud.graph_id = r.graph_id AND ud.a = r.u),
    un AS (SELECT graph_id, v AS block_id, min(u) AS unit FROM rch GROUP BY ALL),
    us AS (SELECT graph_id, unit, sum(len)::BIGINT AS unit_len FROM un JOIN bl USING (graph_id, block_id) GROUP BY ALL)
"""


@query("q9_synteny_units")
def q9_synteny_units(g: Graphs) -> DataFrame:
    return synteny.synteny_units(g, near_core(g))


ORACLE["q9_synteny_units"] = f"""WITH RECURSIVE {BASE} {COMPONENTS}
    SELECT graph_id, block_id, unit, unit_len, 'MSU_' || (dense_rank() OVER (PARTITION BY graph_id ORDER BY unit_len DESC, unit) - 1) AS label
    FROM un JOIN us USING (graph_id, unit)"""


@query("q9_unit_walks")
def q9_unit_walks(g: Graphs) -> DataFrame:
    core = near_core(g)
    return synteny.unit_walks(g, synteny.synteny_units(g, core), core)


ORACLE["q9_unit_walks"] = f"""WITH RECURSIVE {BASE} {COMPONENTS},
    hd AS (SELECT graph_id, unit AS block_id, 'MSU_' || (row_number() OVER (PARTITION BY graph_id ORDER BY unit_len DESC, unit) - 1) AS label FROM us)
    SELECT w.graph_id, path_id, (row_number() OVER (PARTITION BY path_id ORDER BY ord) - 1)::INT AS ord, label, fwd
    FROM w JOIN hd ON hd.graph_id = w.graph_id AND hd.block_id = w.block_id"""


@query("q9_rotated_unit_walks")
def q9_rotated_unit_walks(g: Graphs) -> DataFrame:
    """Walks of circular paths over units, begun at the longest unit, units that mostly point backwards turned."""
    core = near_core(g)
    units = cut_lineage(synteny.synteny_units(g, core))
    turned = synteny.unit_walks(g.of_walks(g.walks.where("circular")), units, core, rotate=True)
    return turned.select("graph_id", "path_id", F.col("ord").cast("bigint").alias("ord"), "label", "fwd")


ORACLE["q9_rotated_unit_walks"] = f"""WITH RECURSIVE {BASE} {COMPONENTS},
    hd AS (SELECT graph_id, unit AS block_id, 'MSU_' || (row_number() OVER (PARTITION BY graph_id ORDER BY unit_len DESC, unit) - 1) AS label FROM us),
    q AS (SELECT w.graph_id, path_id, label, fwd, row_number() OVER (PARTITION BY path_id ORDER BY ord) - 1 AS r, count(*) OVER (PARTITION BY path_id) AS n
          FROM w JOIN hd ON hd.graph_id = w.graph_id AND hd.block_id = w.block_id WHERE circular),
    z AS (SELECT *, min(r) FILTER (label = 'MSU_0' AND fwd) OVER (PARTITION BY path_id) AS f, max(r) FILTER (label = 'MSU_0' AND NOT fwd) OVER (PARTITION BY path_id) AS b FROM q),
    t AS (SELECT graph_id, path_id, label, CASE WHEN f IS NOT NULL THEN (r - f + n) % n ELSE (b - r + n) % n END AS ord,
                 CASE WHEN f IS NOT NULL THEN fwd ELSE NOT fwd END AS fwd FROM z WHERE f IS NOT NULL OR b IS NOT NULL),
    nt AS (SELECT graph_id, label, sum(CASE WHEN fwd THEN 1 ELSE -1 END) AS net FROM t GROUP BY ALL)
    SELECT t.graph_id, path_id, ord::BIGINT AS ord, label, CASE WHEN net < 0 THEN NOT fwd ELSE fwd END AS fwd FROM t JOIN nt USING (graph_id, label)"""


@query("g28_components")
def g28_components(g: Graphs) -> DataFrame:
    """Blocks linked by any edge of a graph, however often it occurs."""
    places = cut_lineage(g.walks.select("graph_id", "path_id", "circular", "ord", "block_id", "fwd"))
    links = walks.graph_links(places).select("graph_id", F.col("block_1").alias("a"), F.col("block_2").alias("b"))
    return connected_components(places.select("graph_id", F.col("block_id").alias("vertex")), cut_lineage(links.distinct()), ["graph_id"])


ORACLE["g28_components"] = f"""WITH RECURSIVE {BASE}, {STEPS}, {LINKS},
    ud AS (SELECT DISTINCT graph_id, block_1 AS a, block_2 AS b FROM gl UNION SELECT graph_id, block_2, block_1 FROM gl),
    rch AS (SELECT DISTINCT graph_id, block_id AS v, block_id AS u FROM w UNION SELECT r.graph_id, r.v, ud.b FROM rch r JOIN ud ON ud.graph_id = r.graph_id AND ud.a = r.u)
    SELECT graph_id, v AS vertex, min(u) AS component FROM rch GROUP BY ALL"""


def g28_order_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Components of chains of scattered ids: each order is linked to the order of the next number."""
    scattered = lambda c: F.md5(c.cast("string"))
    orders = read_table(spark, folder, "orders").select(F.lit(0).alias("all"), F.col("o_orderkey").alias("k"))
    links = orders.select("all", scattered(F.col("k")).alias("a"), scattered(F.col("k") + 1).alias("b"))
    return connected_components(orders.select("all", scattered(F.col("k")).alias("vertex")), links, ["all"]).select("vertex", "component")


QUERIES["g28_order_chain"] = g28_order_chain
ORACLE["g28_order_chain"] = """
    WITH o AS (SELECT DISTINCT o_orderkey AS k, md5(o_orderkey::VARCHAR) AS vertex FROM orders),
    i AS (SELECT *, k - row_number() OVER (ORDER BY k) AS island FROM o)
    SELECT vertex, min(vertex) OVER (PARTITION BY island) AS component FROM i"""

# ---- sequences


@query(
    "x1_reverse_complement",
    "SELECT graph_id, block_id, sha256(reverse(translate(consensus, 'ACGTYRWSKMDVHBN-', 'TGCARYWSMKHBDVN-'))) AS rc FROM blocks",
)
def x1_reverse_complement(g: Graphs) -> DataFrame:
    return g.blocks.select("graph_id", "block_id", F.sha2(sq.reverse_complement(F.col("consensus")), 256).alias("rc"))


@query("q7_block_alignment", "SELECT graph_id, block_id, node_id, sha256(c2) AS seq FROM x2", SEQ)
def q7_block_alignment(g: Graphs) -> DataFrame:
    return sequences.node_sequences(g, aligned=True).withColumn("seq", F.sha2("seq", 256))


@query("q7_node_sequences", "SELECT graph_id, block_id, node_id, sha256(raw) AS seq FROM x2", SEQ)
def q7_node_sequences(g: Graphs) -> DataFrame:
    return sequences.node_sequences(g).withColumn("seq", F.sha2("seq", 256))


@query(
    "x5_reversed_edits",
    """SELECT graph_id, block_id, node_id,
          string_agg(p, ';' ORDER BY p) AS edits FROM (
            SELECT graph_id, block_id, node_id, unnest(list_concat(
              list_transform(list_filter(subs, lambda s: s IS NOT NULL), lambda s: 's' || (length(consensus) - s.pos - 1) || translate(s.alt, 'ACGT', 'TGCA')),
              list_transform(list_filter(dels, lambda d: d IS NOT NULL), lambda d: 'd' || (length(consensus) - d.pos - d.len) || '/' || d.len),
              list_transform(list_filter(inss, lambda i: i IS NOT NULL), lambda i: 'i' || (length(consensus) - i.pos) || reverse(translate(i.seq, 'ACGT', 'TGCA'))),
              [''])) AS p FROM ed) GROUP BY ALL""",
    SEQ,
)
def x5_reversed_edits(g: Graphs) -> DataFrame:
    e = g.alignments.withColumn("r", ed.reverse_edit(F.length("consensus"), F.col("edit")))
    text = F.concat(
        F.transform("r.subs", lambda s: F.concat(F.lit("s"), s["pos"].cast("string"), s["alt"])),
        F.transform("r.dels", lambda d: F.concat(F.lit("d"), d["pos"].cast("string"), F.lit("/"), d["len"].cast("string"))),
        F.transform("r.inss", lambda i: F.concat(F.lit("i"), i["pos"].cast("string"), i["seq"])),
        F.array(F.lit("")),
    )
    return e.select("graph_id", "block_id", "node_id", F.array_join(F.array_sort(text), ";").alias("edits"))


@query(
    "a18_edit_lengths",
    """SELECT graph_id, block_id, node_id, length(consensus) - d AS aligned, length(consensus) - d + i AS node_len, d = length(consensus) AS unaligned
       FROM (SELECT *, coalesce(list_sum(list_transform(list_filter(dels, lambda x: x IS NOT NULL), lambda x: x.len)), 0)::BIGINT AS d,
                    coalesce(list_sum(list_transform(list_filter(inss, lambda x: x IS NOT NULL), lambda x: length(x.seq))), 0)::BIGINT AS i FROM ed)""",
    SEQ,
)
def a18_edit_lengths(g: Graphs) -> DataFrame:
    n = F.length("consensus")
    return g.alignments.select(
        "graph_id",
        "block_id",
        "node_id",
        ed.aligned_count(n, F.col("edit")).alias("aligned"),
        ed.node_length(n, F.col("edit")).alias("node_len"),
        ed.is_unaligned(n, F.col("edit")).alias("unaligned"),
    )


MAJORITY = """
    dp AS (SELECT graph_id, block_id, count(*) AS depth FROM ed GROUP BY ALL)
"""
query(
    "a9_majority_substitutions",
    """SELECT graph_id, block_id, s.pos AS pos, s.alt AS alt, count(*) AS n FROM (SELECT graph_id, block_id, unnest(subs) AS s FROM ed)
       JOIN dp USING (graph_id, block_id) WHERE s IS NOT NULL GROUP BY ALL HAVING count(*) > max(depth) // 2""",
    SEQ,
    MAJORITY,
)(consensus.majority_substitutions)
query(
    "a10_majority_deletions",
    """, k AS (SELECT graph_id, block_id, unnest(range(d.pos, d.pos + d.len)) AS pos FROM (SELECT graph_id, block_id, unnest(dels) AS d FROM ed) WHERE d IS NOT NULL),
    c AS (SELECT graph_id, block_id, pos FROM k JOIN dp USING (graph_id, block_id) GROUP BY ALL HAVING count(*) > max(depth) // 2),
    i AS (SELECT *, pos - row_number() OVER (PARTITION BY graph_id, block_id ORDER BY pos) AS g FROM c)
    SELECT graph_id, block_id, min(pos)::INT AS start, (max(pos) + 1)::INT AS "end" FROM i GROUP BY graph_id, block_id, g""",
    SEQ,
    MAJORITY,
)(consensus.majority_deletions)
query(
    "a11_majority_insertions",
    """SELECT graph_id, block_id, i.pos AS pos, i.seq AS seq, count(*) AS n FROM (SELECT graph_id, block_id, unnest(inss) AS i FROM ed)
       JOIN dp USING (graph_id, block_id) WHERE i IS NOT NULL GROUP BY ALL HAVING count(*) > max(depth) // 2""",
    SEQ,
    MAJORITY,
)(consensus.majority_insertions)


@query("g19_new_consensus")
def g19_new_consensus(g: Graphs) -> DataFrame:
    return consensus.new_consensus(g).select("graph_id", "block_id", "kind", F.sha2("consensus", 256).alias("consensus"))


RECONSTRUCT = """
    rs AS (SELECT w.graph_id, w.path_id, string_agg(CASE WHEN fwd THEN raw ELSE reverse(translate(raw, 'ACGTYRWSKMDVHBN', 'TGCARYWSMKHBDVN')) END, '' ORDER BY ord) AS joined,
                  arg_min(pos_start, ord) AS off FROM w JOIN x2 USING (node_id) GROUP BY ALL),
    rk AS (SELECT *, CASE WHEN length(joined) > 0 THEN ((-off) % length(joined) + length(joined)) % length(joined) ELSE 0 END AS k FROM rs)
"""


@query(
    "g25_reconstruct",
    """SELECT pt.graph_id, pt.path_id, sha256(coalesce(joined[k + 1:] || joined[:k], '')) AS seq,
              length(coalesce(joined, '')) AS n FROM pt LEFT JOIN rk ON rk.path_id = pt.path_id""",
    SEQ,
    RECONSTRUCT,
)
def g25_reconstruct(g: Graphs) -> DataFrame:
    r = sequences.reconstruct(g)
    return r.select("graph_id", "path_id", F.sha2("seq", 256).alias("seq"), F.length("seq").alias("n"))


@query(
    "q10_core_alignment",
    """, gd AS (SELECT graph_id, min(path_id) AS guide FROM w GROUP BY ALL),
    og AS (SELECT w.graph_id, w.block_id, w.ord, w.fwd AS gf FROM w JOIN gd ON gd.graph_id = w.graph_id AND guide = path_id SEMI JOIN nb ON nb.graph_id = w.graph_id AND nb.block_id = w.block_id),
    ca AS (SELECT w.graph_id, w.path_id, string_agg(CASE WHEN gf THEN c2 ELSE reverse(translate(c2, 'ACGTYRWSKMDVHBN', 'TGCARYWSMKHBDVN')) END, '' ORDER BY og.ord) AS seq
           FROM w JOIN og ON og.graph_id = w.graph_id AND og.block_id = w.block_id JOIN x2 ON x2.node_id = w.node_id GROUP BY ALL)
    SELECT pt.graph_id, pt.path_id, sha256(coalesce(seq, '')) AS seq FROM pt LEFT JOIN ca USING (path_id)""",
    SEQ,
)
def q10_core_alignment(g: Graphs) -> DataFrame:
    return sequences.core_alignment(g, near_core(g)).select("graph_id", "path_id", F.sha2("seq", 256).alias("seq"))


@query(
    "k4_block_sequences",
    """SELECT x2.graph_id, x2.block_id, node_id AS name, sha256(c2) AS seq,
       '{"path_name":' || coalesce('"' || path_name || '"', 'null') || ',"block_id":"' || x2.block_id || '","start":' || pos_start || ',"end":' || pos_end
       || ',"strand":"' || coalesce(strand, '+') || '"}' AS description
       FROM x2 JOIN nd USING (node_id) JOIN pt ON pt.path_id = nd.path_id""",
    SEQ,
)
def k4_block_sequences(g: Graphs) -> DataFrame:
    return sequences.block_sequences(g).select("graph_id", "block_id", "name", F.sha2("seq", 256).alias("seq"), "description")


@query(
    "q16_shared_segments",
    """, dup AS (SELECT DISTINCT graph_id, block_id FROM pp WHERE n > 1),
    pl AS (SELECT w.graph_id, w.path_id, w.block_id, node_id, fwd, pos_start, pos_end, tot_len FROM w JOIN pt USING (path_id) JOIN bl ON bl.graph_id = w.graph_id AND bl.block_id = w.block_id WHERE len >= 300),
    pc AS (SELECT graph_id, path_id, block_id, node_id, fwd, pos_start AS s, CASE WHEN pos_end < pos_start THEN tot_len ELSE pos_end END AS e FROM pl
           UNION ALL SELECT graph_id, path_id, block_id, node_id, fwd, 0, pos_end FROM pl WHERE pos_end < pos_start)
    SELECT a.graph_id, a.block_id, a.path_id AS path_a, b.path_id AS path_b, a.node_id AS node_a, b.node_id AS node_b,
           a.s AS start_a, a.e AS end_a, b.s AS start_b, b.e AS end_b, a.fwd = b.fwd AS same_strand, dup.block_id IS NOT NULL AS duplicated
    FROM pc a JOIN pc b ON a.graph_id = b.graph_id AND a.block_id = b.block_id AND a.path_id < b.path_id
    LEFT JOIN dup ON dup.graph_id = a.graph_id AND dup.block_id = a.block_id""",
)
def q16_shared_segments(g: Graphs) -> DataFrame:
    return sequences.shared_segments(g, 300)


# ---- checks

query(
    "w8_gaps",
    """, f AS (SELECT *, coalesce(lead(pos_start) OVER o, CASE WHEN circular THEN first_value(pos_start) OVER o END) AS next_start,
                 coalesce(lead(node_id) OVER o, CASE WHEN circular THEN first_value(node_id) OVER o END) AS next_node FROM w WINDOW o AS (PARTITION BY path_id ORDER BY ord))
    SELECT graph_id, path_id, node_id, next_node, pos_end, next_start FROM f WHERE next_start IS NOT NULL AND next_start <> pos_end""",
)(quality.gaps)


_PROBLEMS = {
    "substitution out of bounds": "len(list_filter(subs, lambda s: s.pos < 0 OR s.pos >= n)) > 0",
    "substitution by a gap": "len(list_filter(subs, lambda s: s.alt = '-')) > 0",
    "two substitutions at one place": "len(list_distinct(list_transform(subs, lambda s: s.pos))) <> len(subs)",
    "substitution inside a deletion": "len(list_filter(subs, lambda s: len(list_filter(dels, lambda d: s.pos >= d.pos AND s.pos < d.pos + d.len)) > 0)) > 0",
    "deletion out of bounds": "len(list_filter(dels, lambda d: d.pos < 0 OR d.pos + d.len > n)) > 0",
    "empty deletion": "len(list_filter(dels, lambda d: d.len <= 0)) > 0",
    "deletions overlap": "len(list_filter(dels, lambda d: len(list_filter(dels, lambda o: o.pos < d.pos + d.len AND d.pos < o.pos + o.len)) > 1)) > 0",
    "insertion out of bounds": "len(list_filter(inss, lambda i: i.pos < 0 OR i.pos > n)) > 0",
}


@query(
    "g27_report",
    """, ec AS (SELECT graph_id, node_id, length(consensus) AS n, list_filter(subs, lambda s: s IS NOT NULL) AS subs,
                  list_filter(dels, lambda d: d IS NOT NULL) AS dels, list_filter(inss, lambda i: i IS NOT NULL) AS inss FROM ed),
    gp AS (SELECT *, coalesce(lead(pos_start) OVER o, CASE WHEN circular THEN first_value(pos_start) OVER o END) AS next_start FROM w WINDOW o AS (PARTITION BY path_id ORDER BY ord))
    SELECT graph_id, 'path names an unknown node' AS rule, node_id AS subject FROM pn ANTI JOIN nd USING (graph_id, node_id)
    UNION ALL SELECT graph_id, 'node in no walk', node_id FROM nd ANTI JOIN pn USING (graph_id, node_id)
    UNION ALL SELECT graph_id, 'node without block', node_id FROM nd WHERE block_id IS NULL
    UNION ALL SELECT graph_id, 'node of an unknown block', node_id FROM nd ANTI JOIN blocks USING (graph_id, block_id) WHERE block_id IS NOT NULL
    UNION ALL SELECT graph_id, 'node of an unknown path', node_id FROM nd ANTI JOIN pt USING (graph_id, path_id)
    UNION ALL SELECT graph_id, 'edit of an unknown node', node_id FROM ec ANTI JOIN nd USING (graph_id, node_id)
    UNION ALL SELECT graph_id, 'block without nodes', block_id FROM blocks ANTI JOIN nd USING (graph_id, block_id)
    UNION ALL SELECT graph_id, 'places that don''t meet', node_id FROM gp WHERE next_start <> pos_end
    """ + " ".join(f"UNION ALL SELECT graph_id, '{name}', node_id FROM ec WHERE {rule}" for name, rule in _PROBLEMS.items()),
    SEQ,
)
def g27_report(g: Graphs) -> DataFrame:
    return quality.report(g)


@query(
    "j5_overlaps",
    """SELECT a.graph_id, a.path_id, a.node_id AS id_a, b.node_id AS id_b
       FROM (SELECT * FROM nd WHERE pos_end > pos_start) a
       JOIN (SELECT * FROM nd WHERE pos_end > pos_start) b ON a.path_id = b.path_id AND a.graph_id = b.graph_id AND a.node_id < b.node_id AND a.pos_end + 50 > b.pos_start AND b.pos_end + 50 > a.pos_start""",
)
def j5_overlaps(g: Graphs) -> DataFrame:
    """Nodes of a path that come within 50 letters of each other."""
    n = g.nodes.where("pos_end > pos_start").select("graph_id", "path_id", F.col("node_id").alias("id"), F.col("pos_start").alias("start"), (F.col("pos_end") + 50).alias("end"))
    return quality.overlaps(n, ["graph_id", "path_id"])

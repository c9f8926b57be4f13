"""Queries of the general data problems: nested records (p2) and skewed keys (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.salted import salted_aggregate, salted_distinct_counts
from strandloom.operators.shred import flatten_alignments, refused, shred_edits
from strandloom.session import read_table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every non-null Edit entry of every valid payload, naming document, block and node."""
    rows = shred_edits(read_table(spark, folder, "graph_docs"))
    return rows.select("raw_id", "block_id", "node_id", "edit_kind", "edit_no", "edit_pos")


def p2_refused(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that give no rows because they are null, empty or no valid JSON."""
    return refused(read_table(spark, folder, "graph_docs"))


def p2_typed_edits(spark: SparkSession, folder: str) -> DataFrame:
    """The same flat table from the typed alignments of ``blocks``."""
    return flatten_alignments(read_table(spark, folder, "blocks"))


def p5_block_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct nodes, paths and graphs of every block, whatever its share of the rows."""
    return salted_distinct_counts(
        read_table(spark, folder, "nodes"),
        "block_id",
        {"n_nodes": "node_id", "n_paths": "path_id", "n_graphs": "graph_id"},
    )


def p5_block_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, forward rows and outermost positions of every block by salted partial aggregates."""
    return salted_aggregate(
        read_table(spark, folder, "nodes").where(F.col("block_id").isNotNull()),
        "block_id",
        {
            "rows": F.count("*"),
            "forward": F.count(F.when(F.col("strand") == "+", 1)),
            "low": F.min("pos_start"),
            "high": F.max("pos_end"),
        },
        {"n_rows": F.sum("rows"), "n_forward": F.sum("forward"), "min_start": F.min("low"), "max_end": F.max("high")},
        by=["node_id"],
    )


QUERIES = {
    "p2_found": p2_found,
    "p2_refused": p2_refused,
    "p2_typed_edits": p2_typed_edits,
    "p5_block_counts": p5_block_counts,
    "p5_block_spans": p5_block_spans,
}

ORACLE = {
    "p2_found": r"""
    WITH d AS (SELECT raw_id, payload FROM graph_docs QUALIFY row_number() OVER (PARTITION BY raw_id ORDER BY received_at DESC, payload DESC NULLS LAST) = 1),
    v AS (SELECT raw_id, payload FROM d WHERE json_valid(payload)),
    l AS (SELECT v.raw_id, v.payload, t.key AS list, t.fullkey AS list_path, unnest(range(json_array_length(v.payload, t.fullkey)::BIGINT)) AS i
          FROM v, json_tree(v.payload) t WHERE t.type = 'ARRAY' AND t.key IN ('subs', 'dels', 'inss')),
    e AS (SELECT *, json_extract(payload, list_path || '[' || i || ']') AS entry,
                 regexp_extract(list_path, '^(.*\.blocks(?:\."[0-9]+"|\.[0-9]+|\[[0-9]+\]))', 1) AS b,
                 regexp_extract(list_path, '^(.*\.alignments(?:\."[0-9]+"|\.[0-9]+|\[[0-9]+\]))', 1) AS n FROM l)
    SELECT raw_id, CASE WHEN b LIKE '%]' THEN json_extract_string(payload, b || '.id') ELSE nullif(regexp_extract(b, '([0-9]+)"?$', 1), '') END AS block_id,
           CASE WHEN n LIKE '%]' THEN json_extract_string(payload, n || '.node_id') ELSE nullif(regexp_extract(n, '([0-9]+)"?$', 1), '') END AS node_id,
           CASE list WHEN 'subs' THEN 'sub' WHEN 'dels' THEN 'del' ELSE 'ins' END AS edit_kind, i::INT AS edit_no,
           json_extract_string(entry, '$.pos')::INT AS edit_pos
    FROM e WHERE json_type(entry) <> 'NULL'
    """,
    "p2_refused": r"""
    WITH d AS (SELECT raw_id, payload FROM graph_docs QUALIFY row_number() OVER (PARTITION BY raw_id ORDER BY received_at DESC, payload DESC NULLS LAST) = 1)
    SELECT raw_id, CASE WHEN payload IS NULL THEN 'null' WHEN trim(payload, chr(9) || chr(10) || chr(13) || ' ') = '' THEN 'empty' ELSE 'invalid' END AS reason
    FROM d WHERE payload IS NULL OR NOT json_valid(payload)""",
    "p2_typed_edits": """
        WITH n AS (SELECT graph_id, block_id, unnest(map_entries(alignments)) AS e FROM blocks),
        r AS (SELECT graph_id, block_id, e.key AS node_id, e.value AS ed FROM n WHERE e.value IS NOT NULL)
        SELECT graph_id, block_id, node_id, 'sub' AS edit_kind, (i - 1)::INT AS edit_no, ed.subs[i].pos AS edit_pos,
               NULL::INT AS edit_len, ed.subs[i].alt AS edit_text
        FROM (SELECT *, unnest(generate_series(1, len(ed.subs))) AS i FROM r) WHERE ed.subs[i] IS NOT NULL
        UNION ALL
        SELECT graph_id, block_id, node_id, 'del', (i - 1)::INT, ed.dels[i].pos, ed.dels[i].len, NULL
        FROM (SELECT *, unnest(generate_series(1, len(ed.dels))) AS i FROM r) WHERE ed.dels[i] IS NOT NULL
        UNION ALL
        SELECT graph_id, block_id, node_id, 'ins', (i - 1)::INT, ed.inss[i].pos, NULL, ed.inss[i].seq
        FROM (SELECT *, unnest(generate_series(1, len(ed.inss))) AS i FROM r) WHERE ed.inss[i] IS NOT NULL
    """,
    "p5_block_counts": """
        SELECT block_id, count(DISTINCT node_id) AS n_nodes, count(DISTINCT path_id) AS n_paths,
               count(DISTINCT graph_id) AS n_graphs
        FROM nodes WHERE block_id IS NOT NULL GROUP BY block_id
    """,
    "p5_block_spans": """
        SELECT block_id, count(*) AS n_rows, count(*) FILTER (strand = '+') AS n_forward,
               min(pos_start) AS min_start, max(pos_end) AS max_end
        FROM nodes WHERE block_id IS NOT NULL GROUP BY block_id
    """,
}

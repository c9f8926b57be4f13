"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.bagminhash import expand_pairs, near_pairs
from strandloom.llm.bpe import encode_column
from strandloom.llm.cooccur import together
from strandloom.llm.leakage import clean_corpus, leaked_items, leaked_passages
from strandloom.llm.lookalike import TO_ASCII, canonical_forms, lookalike_pairs
from strandloom.llm.spans import shared_spans
from strandloom.session import read_table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of FASTA records whose sets of 16-letter windows are similar to 0.5 or more."""
    return expand_pairs(*near_pairs(read_table(spark, folder, "fasta_records"), "rec_index", "seq", delivered="loaded_at"))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: its class of equal letters and the number of links of that class, by bags of windows."""
    members, links = near_pairs(
        read_table(spark, folder, "fasta_records"), "rec_index", "seq", delivered="loaded_at", weighted=True
    )
    ends = links.select("class_a").unionAll(links.select("class_b")).groupBy(F.col("class_a").alias("class_id")).count()
    return members.join(ends, "class_id", "left").select("rec", "class_id", "n_windows", F.coalesce("count", F.lit(0)).alias("n_links"))


def _block_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = together(read_table(spark, folder, "nodes"), read_table(spark, folder, "paths"), "graph_id", "path_id", "block_id")
    return pairs.withColumnRenamed("item_a", "block_a").withColumnRenamed("item_b", "block_b")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of blocks that the paths of a graph hold together three times as often as by chance, five times at least."""
    pairs = _block_pairs(spark, folder)
    # the case is fixed by counts; every pair has its tail under the null, none is dropped by it
    return pairs.where(F.col("p_value").isNotNull()).select("graph_id", "block_a", "block_b")


def p3_surprise(spark: SparkSession, folder: str) -> DataFrame:
    """The same pairs with counts, expectation under the null, tail and false-discovery rate."""
    return _block_pairs(spark, folder).select(
        "graph_id", "block_a", "block_b", "n_a", "n_b", "n_ab", "n", "expected", "p_value", "q_bound", "residual"
    )


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """FASTA records and block consensus sequences, each once."""
    fasta = read_table(spark, folder, "fasta_records").groupBy(F.col("rec_index").cast("string").alias("record_id"))
    fasta = fasta.agg(F.max(F.struct("loaded_at", "seq")).alias("last")).select(F.lit("fasta").alias("record_kind"), "record_id", "last.seq")
    blocks = read_table(spark, folder, "blocks").groupBy(F.col("block_id").alias("record_id")).agg(F.max("consensus").alias("seq"))
    return fasta.unionByName(blocks.select(F.lit("block").alias("record_kind"), "record_id", "seq"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of records and blocks of which every 80 letters stand in another record too."""
    return shared_spans(_records(spark, folder))


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each record lies in spans that it shares."""
    spans = shared_spans(_records(spark, folder)).groupBy("record_kind", "record_id")
    spans = spans.agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"), F.count("*").alias("n_spans"))
    lengths = _records(spark, folder).select("record_kind", "record_id", F.length("seq").alias("letters"))
    return lengths.join(spans, ["record_kind", "record_id"], "left").select(
        "record_kind", "record_id", "letters", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("n_spans", F.lit(0)).alias("n_spans")
    )


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encode_column(read_table(spark, folder, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the evaluation items that they leak."""
    return leaked_items(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"))


def p7_passages(spark: SparkSession, folder: str) -> DataFrame:
    """The leaked passages themselves: place and length in words."""
    return leaked_passages(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"))


def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of the documents that remain once those that leak an item are gone."""
    docs = read_table(spark, folder, "documents")
    return clean_corpus(docs.select("doc_id"), leaked_items(docs, read_table(spark, folder, "eval_items")))


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The most likely reading of every document with letters outside ASCII, and how many of its tokens the search mends."""
    forms = canonical_forms(read_table(spark, folder, "documents"), "doc_id", "text")
    return forms.select("doc_id", F.sha2("form", 256).alias("form"), "n_tokens", "n_mended")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that differ as stored and look the same."""
    return lookalike_pairs(read_table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p3_found": p3_found,
    "p3_surprise": p3_surprise,
    "p4_found": p4_found,
    "p4_shares": p4_shares,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_passages": p7_passages,
    "p7_clean": p7_clean,
    "p8_found": p8_found,
    "p8_forms": p8_forms,
}

_SPANS = """
    rec AS (SELECT 'fasta' AS record_kind, rec_index::VARCHAR AS record_id, upper(arg_max(seq, loaded_at)) AS s FROM fasta_records GROUP BY rec_index
            UNION ALL SELECT 'block', block_id, upper(max(consensus)) FROM blocks GROUP BY block_id),
    w AS (SELECT * FROM (SELECT record_kind, record_id, p, s[p:p + 79] AS t FROM (SELECT *, unnest(range(1, length(s) - 78)) AS p FROM rec WHERE length(s) >= 80))
          WHERE NOT regexp_matches(t, '[^ACGT]')),
    sh AS (SELECT t FROM w GROUP BY t HAVING min(record_kind || record_id) <> max(record_kind || record_id)),
    h AS (SELECT record_kind, record_id, p, coalesce(p - lag(p) OVER o > 80, true) AS new FROM w SEMI JOIN sh USING (t) WINDOW o AS (PARTITION BY record_kind, record_id ORDER BY p)),
    r AS (SELECT *, sum(new::INT) OVER (PARTITION BY record_kind, record_id ORDER BY p) AS run FROM h),
    sp AS (SELECT record_kind, record_id, min(p) - 1 AS span_start, max(p) + 79 AS span_end FROM r GROUP BY record_kind, record_id, run)
"""



def _form_sql() -> str:
    """Documents in the consistent form, in SQL: characters of one-character compatibility forms and look-alikes by a table made by rule."""
    one: dict[str, str] = {}
    for code in [*range(0xA0, 0xD800), *range(0xF900, 0xFFF0), *range(0x1D400, 0x1D800)]:
        c = chr(code)
        form = unicodedata.normalize("NFKC", c)
        form = TO_ASCII.get(ord(form), form) if len(form) == 1 else form
        if len(form) == 1 and form != c and form != "'" and (form == " " or not form.isspace()):
            one[c] = form
    several = {c: unicodedata.normalize("NFKC", c) for c in "ﬀﬁﬂﬃﬄ…℡№ŉ"}
    expr = f"translate(nfc_normalize(t0), '{''.join(one)}', '{''.join(one.values())}')"
    for c, form in several.items():
        expr = f"replace({expr}, '{c}', '{form}')"
    ignorable = "[\\x{AD}\\x{34F}\\x{61C}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{3164}\\x{FE00}-\\x{FE0F}\\x{FEFF}\\x{FFA0}]+"
    return f"""
    d0 AS (SELECT id, raw, regexp_replace(raw, '{ignorable}', '', 'g') AS t0 FROM src WHERE raw <> ''),
    fm AS (SELECT id, raw, nfc_normalize(regexp_replace({expr}, '\\p{{Zs}}', ' ', 'g')) AS form FROM d0)"""


_WORDS13 = """
    wl AS (SELECT id, list_filter(regexp_split_to_array(lower(form), '[^a-z0-9_]+'), lambda x: x <> '') AS ws FROM fm),
    sh AS (SELECT DISTINCT id, array_to_string(ws[p:p + 12], ' ') AS s FROM (SELECT id, ws, unnest(range(1, len(ws) - 11)) AS p FROM wl WHERE len(ws) >= 13))
"""

#: Documents and items under one key: items have negative numbers, less one.
_BOTH = "src AS (SELECT doc_id AS id, text AS raw FROM documents UNION ALL SELECT -1 - item_id, text FROM eval_items)"
_LEAKS = "lk AS (SELECT DISTINCT a.id AS doc_id, -1 - b.id AS item_id FROM sh a JOIN sh b USING (s) WHERE a.id >= 0 AND b.id < 0)"

ORACLE: dict[str, str] = {
    "p7_found": f"WITH {_BOTH}, {_form_sql()}, {_WORDS13}, {_LEAKS} SELECT doc_id, item_id FROM lk",
    "p7_clean": f"WITH {_BOTH}, {_form_sql()}, {_WORDS13}, {_LEAKS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM lk)",
    "p8_found": f"""WITH src AS (SELECT doc_id AS id, text AS raw FROM documents), {_form_sql()}
        SELECT a.id AS doc_a, b.id AS doc_b FROM fm a JOIN fm b ON a.form = b.form AND a.id < b.id WHERE a.raw <> b.raw AND a.form <> ''""",
    "p1_found": """
        WITH r AS (SELECT rec_index, upper(arg_max(seq, loaded_at)) AS s FROM fasta_records GROUP BY rec_index),
        k AS (SELECT DISTINCT rec_index, s[p:p + 15] AS w FROM (SELECT *, unnest(range(1, length(s) - 14)) AS p FROM r WHERE length(s) >= 16)
              WHERE NOT regexp_matches(s[p:p + 15], '[^ACGT]')),
        n AS (SELECT rec_index, count(*) AS n FROM k GROUP BY rec_index),
        c AS (SELECT a.rec_index AS rec_a, b.rec_index AS rec_b, count(*) AS c FROM k a JOIN k b ON a.w = b.w AND a.rec_index < b.rec_index GROUP BY ALL)
        SELECT rec_a, rec_b FROM c JOIN n x ON x.rec_index = rec_a JOIN n y ON y.rec_index = rec_b WHERE 2 * c >= x.n + y.n - c
    """,
    "p1_classes": """
        WITH r AS (SELECT rec_index, upper(arg_max(seq, loaded_at)) AS s FROM fasta_records GROUP BY rec_index),
        cl AS (SELECT min(rec_index) AS class_id, s FROM r WHERE length(s) >= 16 GROUP BY s),
        k AS (SELECT class_id, w, count(*) AS c FROM (SELECT class_id, s[p:p + 15] AS w FROM (SELECT *, unnest(range(1, length(s) - 14)) AS p FROM cl))
              WHERE NOT regexp_matches(w, '[^ACGT]') GROUP BY ALL),
        n AS (SELECT class_id, sum(c)::BIGINT AS n FROM k GROUP BY class_id),
        c AS (SELECT a.class_id AS x, b.class_id AS y, sum(least(a.c, b.c))::BIGINT AS c FROM k a JOIN k b ON a.w = b.w AND a.class_id < b.class_id GROUP BY ALL),
        l AS (SELECT x, y FROM c JOIN n nx ON nx.class_id = x JOIN n ny ON ny.class_id = y WHERE 2 * c >= nx.n + ny.n - c),
        e AS (SELECT class_id, count(*) AS n_links FROM (SELECT x AS class_id FROM l UNION ALL SELECT y FROM l) GROUP BY 1)
        SELECT rec_index AS rec, cl.class_id, n.n AS n_windows, coalesce(n_links, 0) AS n_links
        FROM r JOIN cl USING (s) JOIN n ON n.class_id = cl.class_id LEFT JOIN e ON e.class_id = cl.class_id""",
    "p4_found": f"WITH {_SPANS} SELECT * FROM sp",
    "p4_shares": f"""WITH {_SPANS} SELECT rec.record_kind, rec.record_id, length(any_value(s)) AS letters,
        coalesce(sum(span_end - span_start), 0)::BIGINT AS shared, count(span_start) AS n_spans
        FROM rec LEFT JOIN sp ON sp.record_kind = rec.record_kind AND sp.record_id = rec.record_id GROUP BY ALL""",
    "p3_found": """
        WITH n AS (SELECT graph_id, count(DISTINCT path_id) AS n FROM paths GROUP BY graph_id),
        h AS (SELECT DISTINCT graph_id, path_id, block_id FROM nodes WHERE block_id IS NOT NULL),
        f AS (SELECT graph_id, block_id, count(*) AS c FROM h GROUP BY ALL),
        p AS (SELECT a.graph_id, a.block_id AS block_a, b.block_id AS block_b, count(*) AS n_ab
              FROM h a JOIN h b ON a.graph_id = b.graph_id AND a.path_id = b.path_id AND a.block_id < b.block_id
              GROUP BY ALL HAVING count(*) >= 5)
        SELECT p.graph_id, block_a, block_b
        FROM p JOIN n USING (graph_id)
        JOIN f fa ON fa.graph_id = p.graph_id AND fa.block_id = block_a
        JOIN f fb ON fb.graph_id = p.graph_id AND fb.block_id = block_b
        WHERE n_ab * n >= 3 * fa.c * fb.c
    """,
}

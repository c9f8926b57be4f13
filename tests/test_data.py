"""Nested records and skewed keys: brute force, dirty rows and clashing names."""

import json

import pytest
from pyspark.sql import functions as F

from strandloom.operators import salted, shred
from strandloom.operators.buckets import bucket_pairs, linked_pairs

from .conftest import rows

SCHEMA = "raw_id bigint, origin string, payload string, received_at timestamp"


def _docs(spark, *payloads):
    import datetime as dt

    t = dt.datetime(2030, 1, 1)
    return spark.createDataFrame([(i, None, p, t) for i, p in enumerate(payloads)], SCHEMA)


BIG = 18446744073709551615


def test_layouts_of_edits(spark):
    edit = {"subs": [{"pos": 1, "alt": "A"}, None, {"alt": "C", "pos": "7"}], "dels": None, "inss": [{"seq": "GG", "pos": 0, "more": {"x": [1]}}]}
    plain = {"blocks": {str(BIG): {"id": BIG, "alignments": {"5": edit, "6": {"edit": {"dels": [{"pos": 2, "len": 3}]}}}}}}
    lists = {"graphs": [{"graph": {"blocks": [{"id": str(BIG), "alignments": [{"node_id": 5, **edit}, {"node_id": "6", "subs": []}]}, None]}}]}
    loose = {"subs": [{"pos": None}], "version": 2}
    docs = _docs(spark, json.dumps(plain), json.dumps(lists), json.dumps(loose), '{"subs": [{"pos": NaN}]}', '{"subs": [', "", None, "null", "[]", "3")
    got = rows(shred.shred_edits(docs), "raw_id", "block_id", "node_id", "edit_kind", "edit_no", "edit_pos")
    common = [(str(BIG), "5", "ins", 0, 0), (str(BIG), "5", "sub", 0, 1), (str(BIG), "5", "sub", 2, 7)]
    assert got == sorted(
        [(0, *c) for c in common] + [(0, str(BIG), "6", "del", 0, 2)] + [(1, *c) for c in common] + [(2, None, None, "sub", 0, None)], key=repr
    )


def test_deliveries_count_once_in_their_latest_version(spark):
    import datetime as dt

    p = lambda n: json.dumps({"subs": [{"pos": n}]})
    docs = spark.createDataFrame([(1, None, p(1), dt.datetime(2030, 1, 1)), (1, None, p(2), dt.datetime(2030, 1, 2)), (1, None, p(2), dt.datetime(2030, 1, 2))], SCHEMA)
    assert [r["edit_pos"] for r in shred.shred_edits(docs).collect()] == [2]


def test_levels_rebuild_the_ancestors():
    columns = shred.shred([{"a": [{"b": [1, 2]}, {}, {"b": []}, {"b": [3]}]}, {}, {"a": []}])
    c = next(c for c in columns if c.path.name() == ("a", "[]", "b", "[]") and c is c.path.leaf)
    assert c.values == [1, 2, None, None, 3, None, None]
    assert c.reps == [0, 2, 1, 1, 1, 0, 0]
    assert c.defs == [5, 5, 2, 3, 5, 0, 1]


@pytest.mark.parametrize("depth", [1_000, 5_000, 100_000])
def test_documents_of_any_depth(spark, depth):
    inner = '{"blocks": {"7": {"alignments": {"5": {"subs": [{"pos": 3}], "dels": [null, {"pos": 4}]}}}}}'
    docs = _docs(spark, '{"a": ' * depth + inner + "}" * depth, "[" * depth + inner + "]" * depth, "[" * depth + inner + "]" * (depth - 1), '{"subs": [{"pos": 1}]}')
    got = rows(shred.shred_edits(docs), "raw_id", "block_id", "node_id", "edit_kind", "edit_no", "edit_pos")
    assert got == sorted([(i, "7", "5", *e) for i in (0, 1) for e in (("sub", 0, 3), ("del", 1, 4))] + [(3, None, None, "sub", 0, 1)], key=repr)
    assert rows(shred.refused(docs)) == [(2, "invalid")]


def test_numbers_keep_their_digits(spark):
    node = f'"alignments": [{{"node_id": {BIG}.0, "subs": [{{"pos": 2.0}}, {{"pos": 2.5}}, {{"pos": 1e999999999}}, {{"pos": {"9" * 5000}}}]}}]'
    docs = _docs(spark, f'{{"blocks": [{{"id": 1.8446744073709551615e19, {node}}}]}}', "{" + '"n": ' + "7" * 6000 + ', "subs": [{"pos": 1}]}', " \n", None, "[1,]")
    got = rows(shred.shred_edits(docs), "raw_id", "block_id", "node_id", "edit_no", "edit_pos")
    assert got == [(0, str(BIG), str(BIG), 0, 2), (0, str(BIG), str(BIG), 1, None), (0, str(BIG), str(BIG), 2, None), (0, str(BIG), str(BIG), 3, None), (1, None, None, 0, 1)]
    assert rows(shred.refused(docs)) == [(2, "empty"), (3, "null"), (4, "invalid")]


def test_deep_parser_agrees_with_the_plain_one():
    rng = __import__("random").Random(5)

    def value(d):
        kind = rng.randrange(8 if d else 6)
        if kind >= 6:
            n = rng.randrange(4)
            return [value(d - 1) for _ in range(n)] if kind == 6 else {rng.choice('ab"\\é0'): value(d - 1) for _ in range(n)}
        return [None, True, False, rng.randrange(-99, 99), 'x"\\\u00e9\n', ""][kind]

    for i in range(300):
        text = json.dumps(value(4), indent=rng.choice([None, 1]), ensure_ascii=bool(i % 2))
        assert shred.parse_deep(text) == json.loads(text)
        broken = text[: rng.randrange(len(text))] + rng.choice(["", "]", "}", ",", '"', "01", "NaN", " x"])
        try:
            want = json.loads(broken, parse_constant=shred._refuse)
        except ValueError:
            with pytest.raises(ValueError):
                shred.parse_deep(broken)
        else:
            assert shred.parse_deep(broken) == want


@pytest.mark.parametrize("heavy", [1, 5, 10_000])
def test_salted_counts_equal_plain_ones(spark, heavy):
    df = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 40).cast("string")).alias("k"),
        (F.col("id") % 37).alias("v"), F.when(F.col("id") % 4 > 0, F.col("id") % 5).alias("__salt"), F.lit(1).alias("__key"),
    )
    df = df.unionByName(df)
    got = salted.salted_distinct_counts(df, "k", {"n": "v", "m": "__salt"}, heavy_rows=heavy, salts=7)
    want = df.where("k is not null").groupBy("k").agg(F.countDistinct("v").alias("n"), F.countDistinct("__salt").alias("m"))
    assert rows(got, "k", "n", "m") == rows(want, "k", "n", "m")
    agg = salted.salted_aggregate(df.select("k", "v"), "k", {"s": F.sum("v"), "c": F.count("*")}, {"s": F.sum("s"), "c": F.sum("c")}, heavy_rows=heavy, salts=7)
    assert rows(agg) == rows(df.groupBy("k").agg(F.sum("v").alias("s"), F.count("*").alias("c")))
    assert salted.salted_distinct_counts(df.limit(0), "k", {"n": "v"}).count() == 0


@pytest.mark.parametrize("tile", [1, 3, 1000])
def test_bucket_pairs(spark, tile):
    members = [(b, i) for b in range(3) for i in range(12) if (i + b) % 3] + [(7, 1), (7, 1), (None, 2), (8, None)]
    df = spark.createDataFrame(members, "bucket int, id int")
    want = {(i, j) for b in range(3) for i in range(12) for j in range(i + 1, 12) if (i + b) % 3 and (j + b) % 3}
    got = bucket_pairs(df, ["bucket"], "id", tile).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert bucket_pairs(df.limit(0), ["bucket"], "id").count() == 0
    twice = {p for p in want if sum((p[0] + b) % 3 > 0 and (p[1] + b) % 3 > 0 for b in range(3)) >= 2}
    assert {tuple(r) for r in bucket_pairs(df, ["bucket"], "id", tile, least=2).collect()} == twice
    assert {tuple(r) for r in bucket_pairs(df.dropna().distinct(), ["bucket"], "id", tile, once=True).collect()} == want


@pytest.mark.parametrize("tile", [1, 3, 1000])
def test_linked_pairs(spark, tile):
    members = [(c, 10 * c + i) for c in range(4) for i in range(c * 4)] + [(None, 99)]
    m, e = spark.createDataFrame(members, "a int, y int"), spark.createDataFrame([(1, 2), (1, 3), (0, 1), (7, 1), (None, 1)], "p int, q int")
    want = sorted((x, y) for p, q in ((1, 2), (1, 3)) for c, x in members for d, y in members if c == p and d == q)
    assert rows(linked_pairs(e, "p", "q", m, "a", "y", tile)) == sorted(want, key=repr)
    assert linked_pairs(e, "p", "q", m.limit(0), "a", "y").count() == 0

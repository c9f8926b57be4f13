"""Graph JSON in and out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from strandloom.tables import EDIT_TYPE, Graphs, id_number

ID = "decimal(20,0)"
#: Ids exceed 2^63; a BIGINT schema would silently make nulls of them.
SCHEMA = f"""
    paths map<string, struct<id:{ID}, nodes:array<{ID}>, tot_len:bigint, circular:boolean, name:string, desc:string>>,
    blocks map<string, struct<id:{ID}, consensus:string, alignments:map<string, {EDIT_TYPE}>>>,
    nodes map<string, struct<id:{ID}, block_id:{ID}, path_id:{ID}, strand:string, position:array<bigint>>>
"""


class GraphLoadError(ValueError):
    """A file that is no graph: wrong extension, broken JSON, missing or null parts, doubtful names."""


def read_graphs(spark: SparkSession, paths: list[str]) -> Graphs:
    """Graphs of JSON files, one a file, numbered from 0 in the order given.

    Raises GraphLoadError where a file is no graph or names a path twice, instead of leaving nulls.
    """
    for p in paths:
        if not p.endswith((".json", ".json.gz")):
            raise GraphLoadError(f"neither .json nor .json.gz: {p}")
    raw = None
    for i, p in enumerate(paths):
        part = spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(p, multiLine=True).withColumn("graph_id", F.lit(i).cast("bigint"))
        raw = part if raw is None else raw.unionByName(part)
    try:
        held = {r[0]: r[1] for r in raw.groupBy("graph_id").count().collect()}
    except Exception as e:
        raise GraphLoadError(f"broken JSON: {str(e)[:200]}") from e
    lacking = [p for i, p in enumerate(paths) if held.get(i) != 1]
    if lacking:
        raise GraphLoadError(f"no graph: {lacking[0]}")
    return _checked(raw, lambda i: paths[i])


def parse_graphs(docs: DataFrame) -> Graphs:
    """Graphs of a table (graph_id, json), one document a row; the same checks as for files."""
    parsed = docs.select("graph_id", F.from_json("json", SCHEMA, {"mode": "FAILFAST"}).alias("v"))
    return _checked(parsed.select("graph_id", "v.paths", "v.blocks", "v.nodes"), lambda i: f"graph {i}")


def _checked(raw: DataFrame, name) -> Graphs:
    """The tables of parsed documents; an error where parts are missing or a name is used twice."""
    text = lambda c: F.col(c).cast("string")
    missing = raw.where(F.col("paths").isNull() | F.col("blocks").isNull() | F.col("nodes").isNull()).select("graph_id").head()
    if missing:
        raise GraphLoadError(f"no graph: {name(missing[0])}")
    p = raw.select("graph_id", F.explode("paths").alias("key", "v")).select(
        text("v.id").alias("path_id"), "graph_id", F.transform("v.nodes", lambda n: n.cast("string")).alias("nodes"), "v.tot_len", "v.circular",
        F.col("v.name").alias("path_name"), F.col("v.desc").alias("descr"), F.lit(None).cast("timestamp_ntz").alias("loaded_at"),
    )
    n = raw.select("graph_id", F.explode("nodes").alias("key", "v")).select(
        text("v.id").alias("node_id"), "graph_id", text("v.block_id").alias("block_id"), text("v.path_id").alias("path_id"), "v.strand",
        F.get("v.position", F.lit(0)).alias("pos_start"), F.get("v.position", F.lit(1)).alias("pos_end"), F.lit(None).cast("timestamp_ntz").alias("loaded_at"),
    )
    b = raw.select("graph_id", F.explode("blocks").alias("key", "v")).select("graph_id", text("v.id").alias("block_id"), "v.consensus", "v.alignments")
    for df, cols in ((p, ("path_id", "nodes", "tot_len", "circular")), (n, ("node_id", "block_id", "path_id", "strand", "pos_start", "pos_end")), (b, ("block_id", "consensus", "alignments"))):
        lacking = df.select("graph_id", F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]), lambda x: x.isNotNull()).alias("lacks"))
        bad = lacking.where(F.size("lacks") > 0).head()
        if bad:
            raise GraphLoadError(f"{name(bad['graph_id'])}: {', '.join(bad['lacks'])} absent")
    twice = p.where(F.col("path_name").isNotNull()).groupBy("graph_id", "path_name").count().where("count > 1").head()
    if twice:
        raise GraphLoadError(f"{name(twice['graph_id'])}: two paths have the name {twice['path_name']}")
    return Graphs(n, p, b)


def graph_json(g: Graphs) -> DataFrame:
    """graph_id, json: one document per graph, with entries in the numeric order of their ids."""
    number = lambda c: id_number(c)

    # values hold maps, which have no order: entries are ordered by their number alone
    def by_number(entries):
        return F.array_sort(entries, lambda x, y: F.when(x["n"] < y["n"], -1).when(x["n"] > y["n"], 1).otherwise(0))

    def entries(df: DataFrame, key: str, fields: dict, name: str) -> DataFrame:
        value = F.struct(*[c.alias(n) for n, c in fields.items()])
        kept = df.groupBy("graph_id").agg(by_number(F.collect_list(F.struct(number(key).alias("n"), value.alias("v")))).alias("l"))
        return kept.select("graph_id", F.map_from_entries(F.transform("l", lambda e: F.struct(e["n"].cast("string"), e["v"]))).alias(name))

    ids = F.transform("nodes", lambda n: n.cast("decimal(20,0)"))
    p = entries(g.paths, "path_id", {"id": number("path_id"), "nodes": ids, "tot_len": F.col("tot_len"), "circular": F.col("circular"), "name": F.col("path_name"), "desc": F.col("descr")}, "paths")
    n = entries(
        g.nodes, "node_id",
        {"id": number("node_id"), "block_id": number("block_id"), "path_id": number("path_id"), "strand": F.coalesce("strand", F.lit("+")), "position": F.array("pos_start", "pos_end")}, "nodes",
    )
    rows = g.alignments.groupBy("graph_id", "block_id").agg(by_number(F.collect_list(F.struct(number("node_id").alias("n"), "edit"))).alias("l"))
    maps = rows.select("graph_id", "block_id", F.map_from_entries(F.transform("l", lambda e: F.struct(e["n"].cast("string"), e["edit"]))).alias("alignments"))
    b = entries(g.blocks.select("graph_id", "block_id", "consensus").join(maps, ["graph_id", "block_id"], "left"), "block_id", {"id": number("block_id"), "consensus": F.col("consensus"), "alignments": F.coalesce("alignments", F.create_map().cast(f"map<string,{EDIT_TYPE}>"))}, "blocks")
    whole = p.join(b, "graph_id", "left").join(n, "graph_id", "left")
    return whole.select("graph_id", F.to_json(F.struct("paths", "blocks", "nodes")).alias("json"))


def write_graphs(g: Graphs, path: str, compression: str | None = None) -> None:
    """A folder of JSON text, a document per line and graph."""
    writer = graph_json(g).select(F.col("json").alias("value")).write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).text(path)


def json_schema() -> str:
    """The schema of graph documents as JSON Schema."""
    plain = {"string": {"type": "string"}, "boolean": {"type": "boolean"}}

    def of(t) -> dict:
        if isinstance(t, StructType):
            return {"type": "object", "properties": {f.name: of(f.dataType) for f in t.fields}, "required": [f.name for f in t.fields if f.name not in ("name", "desc")]}
        if isinstance(t, ArrayType):
            return {"type": "array", "items": of(t.elementType)}
        if isinstance(t, MapType):
            return {"type": "object", "additionalProperties": of(t.valueType)}
        return plain.get(t.simpleString(), {"type": "integer", "minimum": 0})

    whole = {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "graph", **of(StructType.fromDDL(SCHEMA))}
    whole["properties"]["paths"]["additionalProperties"]["properties"] |= {n: {"type": ["string", "null"]} for n in ("name", "desc")}
    return json.dumps(whole, indent=2)

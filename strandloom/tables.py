"""The graph as DataFrames: cleaned nodes, paths, walks and blocks of many graphs side by side.

Cleaning rules (all operators rely on them): a node or path delivered twice counts in its latest
version; a node without block is in no walk; a null strand means forward. Ids are decimal strings
of unsigned 64-bit numbers and are compared as strings unless an operator says otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.session import cut_lineage, read_table


def id_number(c: Column | str) -> Column:
    """An id as a number that orders as unsigned 64-bit integers do."""
    return F.col(c).cast("decimal(20,0)") if isinstance(c, str) else c.cast("decimal(20,0)")


def latest(df: DataFrame, key: list[str], by: str) -> DataFrame:
    """One row per key: the latest by ``by`` (ties: the greatest row); other columns come along."""
    rest = [c for c in df.columns if c not in key and c != by]
    kept = df.groupBy(*key).agg(F.max(F.struct(by, *rest)).alias("__last"))
    return kept.select(*key, *[F.col("__last")[c].alias(c) for c in [by, *rest]])


@dataclass
class Graphs:
    """Graphs given by the tables nodes, paths and blocks.

    nodes  node_id, graph_id, block_id, path_id, strand, pos_start, pos_end
    paths  path_id, graph_id, nodes ARRAY<STRING>, tot_len, circular, path_name, descr
    blocks graph_id, block_id, consensus, alignments MAP<node_id, Edit>
    """

    raw_nodes: DataFrame
    raw_paths: DataFrame
    blocks: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Graphs:
        return cls(*(read_table(spark, folder, t) for t in ("nodes", "paths", "blocks")))

    @cached_property
    def nodes(self) -> DataFrame:
        """One row per node. Repeated deliveries are equal but for their time, so a plain distinct does."""
        return self.raw_nodes.select(
            "node_id", "graph_id", "block_id", "path_id", "strand", "pos_start", "pos_end"
        ).distinct()

    @cached_property
    def paths(self) -> DataFrame:
        """One row per path, with the number of its nodes."""
        cols = ["graph_id", "nodes", "tot_len", "circular", "path_name", "descr", "loaded_at"]
        return latest(self.raw_paths.select("path_id", *cols), ["path_id"], "loaded_at").drop("loaded_at")

    @cached_property
    def path_nodes(self) -> DataFrame:
        """Walk order: one row per place of a path, ``ord`` from 0."""
        return self.paths.select("graph_id", "path_id", "circular", F.posexplode("nodes").alias("ord", "node_id"))

    @cached_property
    def walks(self) -> DataFrame:
        """Places of paths with the block and direction of their node."""
        nodes = self.nodes.where(F.col("block_id").isNotNull()).select(
            "node_id",
            "block_id",
            F.coalesce(F.col("strand") == "+", F.lit(True)).alias("fwd"),
            "pos_start",
            "pos_end",
        )
        return self.path_nodes.join(nodes, "node_id").select(
            "graph_id", "path_id", "circular", "ord", "node_id", "block_id", "fwd", "pos_start", "pos_end"
        )

    def stored(self) -> Graphs:
        """The same graphs with their walk table computed once, for plans that read it several times."""
        if not self.__dict__.get("_stored"):
            self.__dict__["walks"], self.__dict__["_stored"] = cut_lineage(self.walks), True
        return self

    def of_walks(self, walks: DataFrame) -> Graphs:
        """The same graphs with some of their walks only."""
        g = Graphs(self.raw_nodes, self.raw_paths, self.blocks)
        g.__dict__["walks"] = walks
        return g

    @cached_property
    def block_lengths(self) -> DataFrame:
        return self.blocks.select("graph_id", "block_id", F.length("consensus").alias("len"))

    @cached_property
    def alignments(self) -> DataFrame:
        """One row per (block, node) with its Edit; null lists become empty ones, null Edits stay out."""
        edits = self.blocks.select("graph_id", "block_id", "consensus", F.explode("alignments").alias("node_id", "edit"))
        empty = {k: F.coalesce(F.col(f"edit.{k}"), F.array().cast(t)) for k, t in EDIT_TYPES.items()}
        edit = F.struct(*[F.filter(c, lambda e: e.isNotNull()).alias(k) for k, c in empty.items()])
        return edits.where(F.col("edit").isNotNull()).select("graph_id", "block_id", "node_id", "consensus", edit.alias("edit"))


def merge_by_key(left: DataFrame, right: DataFrame, key: list[str], value: str, policy: str | Column = "error") -> DataFrame:
    """Two key-value tables as one (J10). Of a key in both, ``policy`` takes the left or right value, or
    an expression of ``left`` and ``right``; by default it is an error, as for graphs that must be disjoint."""
    joined = left.select(*key, F.struct(F.col(value).alias("v")).alias("a")).join(right.select(*key, F.struct(F.col(value).alias("v")).alias("b")), key, "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    rows = joined.select(*key, F.col("a.v").alias("left"), F.col("b.v").alias("right"), F.col("a").isNotNull().alias("__in_a"), both.alias("__both"))
    taken = {"left": F.col("left"), "right": F.col("right"), "error": F.raise_error(F.concat(F.lit("key in both tables: "), F.concat_ws("/", *key)))}
    chosen = taken[policy] if isinstance(policy, str) else policy
    return rows.select(*key, F.when(F.col("__both"), chosen).when(F.col("__in_a"), F.col("left")).otherwise(F.col("right")).alias(value))


EDIT_TYPES = {
    "subs": "array<struct<pos:int,alt:string>>",
    "dels": "array<struct<pos:int,len:int>>",
    "inss": "array<struct<pos:int,seq:string>>",
}
EDIT_TYPE = "struct<" + ",".join(f"{k}:{t}" for k, t in EDIT_TYPES.items()) + ">"

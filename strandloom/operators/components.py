"""Connected components of many graphs at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from strandloom.session import cut_lineage, ship

#: Rounds after which the search is given up with an error; graphs of any shape need about log n.
MOST_ROUNDS = 100
#: Edges that one task makes a forest of at a time.
FOREST_EDGES = 500_000


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least vertex of the component of each of the vertices 0 to n - 1.

    Every round the root of a vertex is hooked to the least root next to its tree, and trees are
    flattened; each tree that has a neighbour is joined to one, so their number halves at least.
    """
    parent = np.arange(n)
    while True:
        pa_, pb = parent[a], parent[b]
        apart = pa_ != pb
        if not apart.any():
            return parent
        a, b, pa_, pb = a[apart], b[apart], pa_[apart], pb[apart]
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _forest(by: int, kinds: pa.Schema):
    """Edges (by..., a, b) as stars (by..., vertex, least vertex that these edges join it to), chunk by chunk."""

    def stars(table: pa.Table) -> pa.RecordBatch | None:
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
        m = table.num_rows
        group = np.zeros(m, dtype=np.int64)
        for c in columns[:by]:
            codes = c.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.unique(group * (codes.max() + 1) + codes, return_inverse=True)[1]
        ends = pa.concat_arrays([columns[by], columns[by + 1]])
        coded = ends.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))  # vertices order as the engine orders them: texts by their bytes
        place = rank[coded.indices.to_numpy(zero_copy_only=False)]
        vertex, first, local = np.unique(np.concatenate((group, group)) * len(order) + place, return_index=True, return_inverse=True)
        root = least_labels(len(vertex), local[:m], local[m:])
        child = np.flatnonzero(root != np.arange(len(vertex)))
        rows = pa.array(first[child] % m)
        return pa.RecordBatch.from_arrays([*[c.take(rows) for c in columns[:by]], ends.take(pa.array(first[child])), ends.take(pa.array(first[root[child]]))], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= FOREST_EDGES:
                yield stars(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield stars(pa.Table.from_batches(held))

    return run


def connected_components(vertices: DataFrame, edges: DataFrame, by: list[str], log: list | None = None) -> DataFrame:
    """``by``, vertex, component (the least vertex of it).

    ``edges`` has ``by``, a, b. Large-star and small-star rounds: first every vertex sends its greater
    neighbours to the least of its neighbours, then each vertex joins its lesser neighbours to the
    least of them, until all trees are stars; the number of rounds grows with the logarithm of the
    longest chain. Before each round every task makes a forest of the edges it holds, a bounded
    number at a time, so that chains inside a task shrink at once. Least neighbours are combined on
    the map side, so a vertex with very many neighbours is no burden. The edges of a round are a
    stored table. ``log`` collects the number of edges of each round.

    Defined results: vertices without edges are their own component; edges with a null end or an
    end that is no vertex are ignored; repeated rows count once; empty tables give no rows. Should
    the rounds not end, an error is raised.
    """
    ship(edges.sparkSession)
    nodes = vertices.select(*by, "vertex").dropna().distinct()
    known = nodes.select(*by, F.col("vertex").alias("a"))
    pairs = edges.select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).alias("__ok"))
    pairs = pairs.where("__ok").dropna().select(*by, "a", "b").distinct()
    pairs = pairs.join(known, [*by, "a"], "left_semi").join(known.withColumnRenamed("a", "b"), [*by, "b"], "left_semi").select(*by, "a", "b")
    kinds = to_arrow_schema(pairs.schema)
    schema = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes)
    # rows are (vertex a, lesser vertex b) from here on
    forest = lambda df: cut_lineage(df.select(*by, "a", "b").mapInArrow(_forest(len(by), kinds), schema).distinct())
    trees = forest(pairs)
    for _ in range(MOST_ROUNDS):
        roots = trees.select(*by, F.col("b").alias("a")).distinct()
        shape = trees.groupBy(*by, "a").agg(F.count("*").alias("n")).join(roots.withColumn("root", F.lit(True)), [*by, "a"], "left")
        many, bad = shape.agg(F.sum("n"), F.count(F.when((F.col("n") > 1) | F.col("root"), 1))).first()
        if log is not None:
            log.append(many or 0)
        if not bad:
            return nodes.join(trees.select(*by, F.col("a").alias("vertex"), F.col("b").alias("component")), [*by, "vertex"], "left").select(*by, "vertex", F.coalesce("component", "vertex").alias("component"))
        both = trees.unionByName(trees.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*by, "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, [*by, "a"]).where(F.col("b") > F.col("a")).select(*by, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lesser = large.groupBy(*by, "a").agg(F.min("b").alias("m"))
        small = large.join(lesser, [*by, "a"]).where(F.col("b") != F.col("m")).select(*by, F.col("b").alias("a"), F.col("m").alias("b"))
        trees = forest(small.unionByName(lesser.select(*by, "a", F.col("m").alias("b"))).distinct())
    raise RuntimeError(f"components are unfinished after {MOST_ROUNDS} rounds")

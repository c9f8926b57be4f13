"""Items that stand together in baskets far more often than chance: exact counts against a fitted null.

Counts. Baskets and items of a group form a 0/1 matrix; counts of pairs are the products of its
columns. They are taken tile by tile: items are divided into parts of about TILE, and each pair of
parts is multiplied in slices of baskets, so no pair is ever written for a basket, no part of a
group grows beyond two tiles of counts, and a group with very many rows is divided among tasks by
baskets. A row goes to those pairs of parts only of which its basket holds items. Items that no partner could lift to the asked ratio are left out beforehand: n_ab is at
most min(n_a, n_b), so a ratio of r asks for r * max(n_a, n_b) <= n.

Null. The bipartite configuration model with the frequencies of the items and the sizes of the
baskets as expectations: p(item in basket) = x y / (1 + x y), fitted over the classes of equal
frequency and equal size, so the fit costs no more than the square of their number. The number of
baskets with both items is then Poisson-binomial; its tail is summed from exact convolutions over
size classes. A model is fitted once a group; tails are computed for classes of pairs with the same
degrees and count, divided among tasks. Benjamini-Hochberg runs over all pairs of items of a group,
where a pair below the asked count or ratio enters with 1 instead of its tail: that is no less, so the
rate is controlled, and ``q_bound`` is never below the q-value that all tails would give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.session import cut_lineage, ship

#: Items of a part, rows of a matrix slice, and rows of a group that one task takes.
TILE, SLICE, ROWS = 256, 8_192, 500_000
#: Tasks that fit null models, groups being spread over them, and classes of pairs whose tails one task computes.
TASKS, CLASSES = 96, 500


def _count_group(rows: list[pa.Table | pa.RecordBatch], least: int, lift: float):
    """Pairs and counts of one (group, part, part, share)."""
    table = pa.concat_tables([pa.Table.from_batches([r]) if isinstance(r, pa.RecordBatch) else r for r in rows])
    items, baskets = table["item"].combine_chunks().dictionary_encode(), table["basket"].combine_chunks().dictionary_encode()
    names = items.dictionary
    item = items.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    basket = baskets.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(names)
    order = np.argsort(basket, kind="stable")
    item, basket = item[order], basket[order]
    counts = np.zeros((n, n), dtype=np.int64)
    n_baskets = len(baskets.dictionary)
    for first in range(0, n_baskets, SLICE):
        a, b = np.searchsorted(basket, [first, first + SLICE])
        m = np.zeros((min(SLICE, n_baskets - first), n), dtype=np.float32)
        m[basket[a:b] - first, item[a:b]] = 1.0
        counts += (m.T @ m).astype(np.int64)
    part = np.zeros(n, dtype=np.int64)
    freq = np.zeros(n, dtype=np.int64)
    part[item] = table["part"].to_numpy()[order]
    freq[item] = table["n_item"].to_numpy()[order]
    low, high = table["part_a"][0].as_py(), table["part_b"][0].as_py()
    shares, total = table["shares"][0].as_py(), table["n"][0].as_py()
    counts[np.tril_indices(n)] = 0
    if low != high:  # pairs inside a part are counted where both parts are the same
        counts[part[:, None] == part[None, :]] = 0
    if shares == 1:
        counts[counts < least] = 0
    i, j = np.nonzero(counts)
    c = counts[i, j]
    if shares == 1:
        keep = c * float(total) >= lift * freq[i] * freq[j]
        i, j, c = i[keep], j[keep], c[keep]
    return names, i, j, c, freq


_COUNT_FIELDS = ["group", "item_a", "item_b", "n_a", "n_b", "n_ab", "n"]


def _counter(least: int, lift: float):
    def flush(rows, key):
        names, i, j, c, freq = _count_group(rows, least, lift)
        n = rows[0]["n"][0].as_py()
        a, b = names.take(pa.array(i)), names.take(pa.array(j))
        swap = np.array([x > y for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], dtype=bool)
        first = names.take(pa.array(np.where(swap, j, i)))
        second = names.take(pa.array(np.where(swap, i, j)))
        return pa.RecordBatch.from_arrays(
            [pa.array([key] * len(i), pa.string()), first, second, pa.array(freq[np.where(swap, j, i)], pa.int64()),
             pa.array(freq[np.where(swap, i, j)], pa.int64()), pa.array(c, pa.int64()), pa.array([n] * len(i), pa.int64())],
            names=_COUNT_FIELDS,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(n) for n in ("cell", "group", "part_a")]
            cell = cols[0].to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if held and key != cell[a]:
                    yield flush(held, held[0]["group"][0].as_py())
                    held = []
                key = cell[a]
                held.append(part)
        if held:
            yield flush(held, held[0]["group"][0].as_py())

    return run


def pair_counts(rows: DataFrame, sizes: DataFrame, least: int = 5, lift: float = 3.0, tile: int = TILE, share: int = ROWS) -> DataFrame:
    """Exact counts of the pairs with n_ab >= least and n_ab * n >= lift * n_a * n_b.

    ``rows`` has distinct (group, basket, item) of strings, ``sizes`` the number n of baskets of
    each group. Gives group, item_a < item_b, n_a, n_b, n_ab, n.
    """
    ship(rows.sparkSession)
    freq = rows.groupBy("group", "item").agg(F.count("*").alias("n_item"))
    fit = freq.join(sizes, "group").where((F.col("n_item") >= least) & (F.col("n_item") * F.lit(float(lift)) <= F.col("n")))
    of_group = fit.groupBy("group").agg(
        F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("parts"), F.ceil(F.sum("n_item") / F.lit(share)).cast("int").alias("shares")
    )
    fit = fit.join(of_group, "group")
    held = rows.join(fit, ["group", "item"]).withColumn("part", F.pmod(F.xxhash64("item"), "parts").cast("int"))
    held = held.select("group", "basket", "item", "n_item", "n", "shares", "parts", "part", F.pmod(F.xxhash64("basket"), "shares").cast("int").alias("share"))
    # a group of one part needs no partners; of the others, each basket names the parts that it holds
    single = held.where("parts = 1").withColumn("other", F.lit(0))
    several = held.where("parts > 1")
    present = several.select("group", "basket", "part").distinct().groupBy("group", "basket").agg(F.collect_list("part").alias("others"))
    several = several.join(present, ["group", "basket"]).withColumn("other", F.explode("others")).drop("others")
    cells = single.unionByName(several).select(
        "group", "basket", "item", "n_item", "n", "shares", "part", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"), "share"
    ).withColumn("cell", F.concat_ws("/", "part_a", "part_b", "share", "group"))
    counted = (
        cells.repartition("cell")
        .sortWithinPartitions("cell")
        .mapInArrow(
            _counter(least, lift), "group string, item_a string, item_b string, n_a bigint, n_b bigint, n_ab bigint, n bigint"
        )
    )
    whole = counted.groupBy("group", "item_a", "item_b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.sum("n_ab").alias("n_ab"), F.first("n").alias("n"))
    return whole.where((F.col("n_ab") >= least) & (F.col("n_ab") * F.col("n") >= F.lit(float(lift)) * F.col("n_a") * F.col("n_b")))


def fit_null(item_freq: np.ndarray, item_count: np.ndarray, basket_size: np.ndarray, basket_count: np.ndarray, rounds: int = 1_000, tolerance: float = 1e-9):
    """Multipliers (x of each frequency class, y of each size class) of the configuration model, and the residual.

    Items of all baskets and baskets of all items are certain (an infinite multiplier); they are
    peeled off before the rest is fitted by fixed-point iteration. The residual is the greatest
    relative difference of a degree from its expectation: under 1e-8 as a rule, about 1e-3 where the
    frequencies and sizes leave hardly any choice and the multipliers grow without end.
    """
    f, s = item_freq.astype(float), basket_size.astype(float)
    cf, cs = item_count.astype(float), basket_count.astype(float)
    x, y = np.zeros(len(f)), np.zeros(len(s))
    while True:
        full_item = (cf > 0) & (f > 0) & (f >= cs.sum())
        x[full_item] = np.inf
        s = s - cf[full_item].sum()
        cf = np.where(full_item, 0, cf)
        full_basket = (cs > 0) & (s > 0) & (s >= cf.sum())
        y[full_basket] = np.inf
        f = np.where(cf > 0, f - cs[full_basket].sum(), f)
        cs = np.where(full_basket, 0, cs)
        if not full_item.any() and not full_basket.any():
            break
    residual = 0.0
    i, j = np.flatnonzero((cf > 0) & (f > 0)), np.flatnonzero((cs > 0) & (s > 0))
    if len(i) and len(j):
        f, s, cf, cs = f[i], s[j], cf[i], cs[j]
        edges = max(1.0, float((f * cf).sum()))
        u, v = f / np.sqrt(edges), s / np.sqrt(edges)
        for _ in range(rounds):
            nu = f / ((cs * v)[None, :] / (1 + u[:, None] * v[None, :])).sum(1)
            nv = s / ((cf * nu)[None, :] / (1 + v[:, None] * nu[None, :])).sum(1)
            done = (np.abs(nu - u) <= tolerance * nu).all() and (np.abs(nv - v) <= tolerance * nv).all()
            u, v = nu, nv
            if done:
                break
        x[i], y[j] = u, v
        p = u[:, None] * v[None, :] / (1 + u[:, None] * v[None, :])
        residual = float(max(np.abs((p * cs[None, :]).sum(1) / f - 1).max(), np.abs((p * cf[:, None]).sum(0) / s - 1).max()))
    return x, y, residual


def probability(x: float, y: np.ndarray) -> np.ndarray:
    """Chance of an item in a basket of each size class."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isinf(x) | np.isinf(y), 1.0, x * y / (1 + x * y))


def _binomial(n: int, p: float, top: int) -> np.ndarray:
    """P(0..top) of a binomial, by the ratio of neighbours in logarithms."""
    top = min(top, n)
    if p <= 0 or n == 0:
        return np.array([1.0])
    if p >= 1:
        out = np.zeros(top + 1)
        if n <= top:
            out[n] = 1.0
        return out
    k = np.arange(1, top + 1)
    logs = np.concatenate(([n * np.log1p(-p)], np.log((n - k + 1) / k) + np.log(p) - np.log1p(-p))).cumsum()
    return np.exp(logs)


def poisson_binomial_tail(p: np.ndarray, count: np.ndarray, k: int) -> float:
    """P(X >= k) for a sum of ``count`` trials of each probability; the terms from k on are summed, so small tails stay exact."""
    mean = float((p * count).sum())
    spread = float(np.sqrt((p * (1 - p) * count).sum()))
    n = int(count.sum())
    if k <= 0:
        return 1.0
    if k > n:
        return 0.0
    top = min(n, int(max(k, mean) + 12 * spread + 40))
    pmf = np.array([1.0])
    for q, c in zip(p.tolist(), count.tolist(), strict=True):
        pmf = np.convolve(pmf, _binomial(int(c), min(max(q, 0.0), 1.0), top))[: top + 1]
    return float(min(1.0, pmf[k:].sum()))


def expected_and_tail(model: tuple, n_a: int, n_b: int, n_ab: int) -> tuple[float, float]:
    item_freq, basket_count, x, y = model
    xa, xb = x[np.searchsorted(item_freq, n_a)], x[np.searchsorted(item_freq, n_b)]
    p = probability(xa, y) * probability(xb, y)
    return float((p * basket_count).sum()), poisson_binomial_tail(p, basket_count, n_ab)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fitted model of each group from its degree classes."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            freq = np.array(sorted((d["degree"], d["many"]) for d in r["items"]), dtype=np.int64)
            size = np.array(sorted((d["degree"], d["many"]) for d in r["baskets"]), dtype=np.int64)
            x, y, residual = fit_null(freq[:, 0], freq[:, 1], size[:, 0], size[:, 1])
            out.append({"group": r["group"], "item_freq": freq[:, 0].tolist(), "basket_count": size[:, 1].tolist(), "x": x.tolist(), "y": y.tolist(), "residual": residual})
        yield pa.RecordBatch.from_pylist(out, schema=_MODEL)


_MODEL = pa.schema(
    [("group", pa.string()), ("item_freq", pa.list_(pa.int64())), ("basket_count", pa.list_(pa.int64())), ("x", pa.list_(pa.float64())),
     ("y", pa.list_(pa.float64())), ("residual", pa.float64())]
)


def _tails(classes: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
    """Null expectation and tail of some classes of one group."""
    m = models.iloc[0]
    model = (np.asarray(m["item_freq"]), np.asarray(m["basket_count"]), np.asarray(m["x"]), np.asarray(m["y"]))
    found = [expected_and_tail(model, *c) for c in classes[["n_a", "n_b", "n_ab"]].itertuples(index=False)]
    return classes.assign(expected=[f[0] for f in found], p_value=[f[1] for f in found], residual=m["residual"])[
        ["group", "n_a", "n_b", "n_ab", "pairs", "expected", "p_value", "residual"]
    ]


def together(
    baskets: DataFrame,
    all_baskets: DataFrame,
    group: str,
    basket: str,
    item: str,
    least: int = 5,
    lift: float = 3.0,
    surprise: bool = True,
    tile: int = TILE,
    share: int = ROWS,
) -> DataFrame:
    """Pairs of items of a group with n_ab >= least and n_ab * n >= lift * n_a * n_b.

    Gives the group, item_a < item_b, n_a, n_b, n_ab, n and, with ``surprise``, expected (under the
    null), p_value, q_bound (over all pairs of items that occur in the group) and the residual of the
    group's fit.

    Defined results: n counts the distinct baskets of ``all_baskets``, those without items included;
    rows with a null item, basket or group count for nothing; repeated rows count once; empty
    tables give no rows; other columns are ignored.
    """
    kind = baskets.schema[group].dataType.simpleString()
    rows = (
        baskets.select(F.col(group).cast("string").alias("group"), F.col(basket).cast("string").alias("basket"), F.col(item).cast("string").alias("item"))
        .dropna()
        .distinct()
    )
    sizes = (
        all_baskets.select(F.col(group).cast("string").alias("group"), F.col(basket).cast("string").alias("basket"))
        .dropna()
        .groupBy("group")
        .agg(F.countDistinct("basket").alias("n"))
    )
    if surprise:
        rows = cut_lineage(rows)  # pairs and both kinds of degrees are counted from them
    pairs = pair_counts(rows, sizes, least, lift, tile, share)
    if surprise:
        pairs = _with_surprise(cut_lineage(pairs), rows, sizes)
    return pairs.withColumn("group", F.col("group").cast(kind)).withColumnRenamed("group", group)


def _with_surprise(pairs: DataFrame, rows: DataFrame, sizes: DataFrame) -> DataFrame:
    def degrees(key: str, name: str) -> DataFrame:
        """Degree classes of each group: as many as there are different degrees, not as there are items or baskets."""
        each = rows.groupBy("group", key).agg(F.count("*").alias("degree"))
        classes = each.groupBy("group", "degree").agg(F.count("*").alias("many"))
        return classes.groupBy("group").agg(F.collect_list(F.struct("degree", "many")).alias(name), F.sum("many").alias(f"n_{name}"))

    model = degrees("item", "items").join(degrees("basket", "baskets"), "group").join(sizes, "group")
    empty = F.struct(F.lit(0).cast("bigint").alias("degree"), (F.col("n") - F.col("n_baskets")).alias("many"))
    model = model.select(
        "group", "items", F.when(F.col("n") > F.col("n_baskets"), F.concat("baskets", F.array(empty))).otherwise(F.col("baskets")).alias("baskets"),
        (F.col("n_items") * (F.col("n_items") - 1) / 2).alias("tests"),
    )
    model = cut_lineage(model)
    fitted = cut_lineage(
        model.drop("tests").join(pairs.select("group").distinct(), "group", "left_semi").select("group", "items", "baskets")
        # few rows, much work on each: a fixed number of partitions, which isn't coalesced by size
        .repartition(TASKS, "group")
        .mapInArrow(_fit, "group string, item_freq array<bigint>, basket_count array<bigint>, x array<double>, y array<double>, residual double")
    )
    # the tail depends on the degrees and the count only: pairs are few classes, of which a task takes CLASSES
    classes = pairs.groupBy("group", "n_a", "n_b", "n_ab").agg(F.count("*").alias("pairs"))
    chunks = classes.groupBy("group").agg(F.ceil(F.count("*") / F.lit(CLASSES)).cast("int").alias("chunks"))
    spread = classes.join(chunks, "group").withColumn("chunk", F.pmod(F.xxhash64("n_a", "n_b", "n_ab"), "chunks").cast("int")).drop("chunks")
    copies = fitted.join(chunks, "group").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    part = lambda df: df.repartition(TASKS, "group", "chunk").groupBy("group", "chunk")
    tails = cut_lineage(
        part(spread).cogroup(part(copies))
        .applyInPandas(_tails, "group string, n_a bigint, n_b bigint, n_ab bigint, pairs bigint, expected double, p_value double, residual double")
    )
    ranked = tails.join(model.select("group", "tests"), "group")
    by_p = Window.partitionBy("group").orderBy("p_value").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("group").orderBy(F.col("p_value").desc()).rangeBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("rank", F.sum("pairs").over(by_p))
    ranked = ranked.withColumn("q_bound", F.least(F.lit(1.0), F.min(F.col("p_value") * F.col("tests") / F.col("rank")).over(down)))
    return pairs.join(ranked.select("group", "n_a", "n_b", "n_ab", "expected", "p_value", "q_bound", "residual"), ["group", "n_a", "n_b", "n_ab"])

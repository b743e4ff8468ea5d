"""Percentiles of large numeric columns by mergeable digests over a dyadic tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leading bits of a number that a leaf keeps: whole numbers below 2**BITS are exact.
BITS = 11
#: Any double has a leaf below 2**LEVELS: its sign, exponent and leading bits, in order.
LEVELS = 22
_ZERO = 1 << (LEVELS - 1)
_STEP = 1 << (BITS - 1)
_LEAST_EXPONENT, _MOST_EXPONENT = -1022, 1023
NODE_SCHEMA = "level int, node long, n long"


def quantize(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the leaf of a number in the ordered universe; order is kept and a leaf is under 0.1 percent wide.

    Any sign and fraction. Numbers nearer to zero than 2**-1022 count as zero, infinite ones are the ends; NaN and null have no leaf.
    """
    # in steps, so that nothing is computed twice where it is used twice
    v, a, e, p = (F.col(f"{name}_{part}") for part in ("v", "a", "e", "p"))
    out = rows.withColumn(f"{name}_v", F.col(value).cast("double")).withColumn(f"{name}_a", F.abs(v))
    out = out.withColumn(f"{name}_e", F.least(F.greatest(F.floor(F.log2(a)), F.lit(_LEAST_EXPONENT)), F.lit(_MOST_EXPONENT)))
    out = out.withColumn(f"{name}_p", F.pow(F.lit(2.0), e))
    # a logarithm may fall on the wrong side of a power of two
    place = (e - _LEAST_EXPONENT) * _STEP + 1
    inside = F.when(a < p, place - _STEP + F.floor(a / p * (2 * _STEP)) - _STEP).when(a / p >= 2, place + F.floor(a / p * (_STEP // 2))).otherwise(place + F.floor(a / p * _STEP) - _STEP)
    size = F.when(a == float("inf"), _ZERO - 1).when(a < 2.0**_LEAST_EXPONENT, 0).otherwise(inside)
    leaf = F.when(v.isNull() | F.isnan(v), None).otherwise(_ZERO + F.when(v < 0, -size).otherwise(size)).cast("long")
    return out.withColumn(name, leaf).drop(*[f"{name}_{part}" for part in ("v", "a", "e", "p")])


def leaf_value(leaf: np.ndarray) -> np.ndarray:
    """The number of a leaf that is nearest to zero; whole numbers below 2**BITS come back as they were."""
    place = np.asarray(leaf, dtype=np.int64) - _ZERO
    size = np.abs(place)
    exponent = (size - 1) // _STEP + _LEAST_EXPONENT
    with np.errstate(over="ignore"):
        out = np.ldexp(((size - 1) % _STEP + _STEP) / _STEP, exponent)
    out = np.where(size == 0, 0.0, np.where(size >= _ZERO - 1, np.inf, out))
    return np.where(place < 0, -out, out)


def compress(level: np.ndarray, node: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Moves light siblings into their parents, from the leaves up.

    A node, its sibling and its parent that together hold at most total / k are one. So every count that is not at a leaf is
    at most total / k, and a rank is wrong by at most LEVELS * total / k.
    """
    limit = int(n.sum()) // k
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ids, counts = node[level == 0], n[level == 0]
    for at in range(LEVELS):
        up, m = node[level == at + 1], n[level == at + 1]
        parents = np.union1d(ids >> 1, up)
        own = np.bincount(np.searchsorted(parents, ids >> 1), counts, len(parents)).astype(np.int64)
        has = np.bincount(np.searchsorted(parents, up), m, len(parents)).astype(np.int64)
        merge = own + has <= limit
        stays = ~merge[np.searchsorted(parents, ids >> 1)]
        kept.append((np.full(int(stays.sum()), at), ids[stays], counts[stays]))
        has = has + np.where(merge, own, 0)
        ids, counts = parents[has > 0], has[has > 0]
    kept.append((np.full(len(ids), LEVELS), ids, counts))
    return tuple(np.concatenate(x) for x in zip(*kept))  # type: ignore[return-value]


def _compressor(groups: list[str], k: int):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        level, node, n = compress(pdf["level"].to_numpy(), pdf["node"].to_numpy(), pdf["n"].to_numpy(), k)
        out = pd.DataFrame({"level": level, "node": node, "n": n})
        for i, g in enumerate(groups):
            out.insert(i, g, pdf[g].iloc[0])
        return out

    return one


def _compressed(nodes: DataFrame, groups: list[str], eps: float) -> DataFrame:
    kinds = dict(nodes.dtypes)
    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in groups), NODE_SCHEMA])
    # a group has at most as many rows as its values have leaves, and never more than 2 ** LEVELS, however many values it holds
    return nodes.groupBy(*groups).applyInPandas(_compressor(groups, int(np.ceil(LEVELS / eps))), schema)


def build_digests(values: DataFrame, groups: list[str], value: str, *, eps: float = 0.001) -> DataFrame:
    """Digest ``(groups, level, node, n)`` per group; ranks found in it are wrong by at most ``eps`` of the group's size.

    Any numeric column, negative and fractional values too. Null and NaN values are left out; a null group is a group. No values give
    no digest. Counting per leaf combines before the shuffle, so a group with a third of all values sends no more than its leaves.
    """
    rows = values.select(*groups, F.col(value).alias("node_of"))
    if dict(rows.dtypes)["node_of"] in ("tinyint", "smallint", "int", "bigint"):
        # whole numbers repeat: counted as they are, each is placed in the tree once
        rows = rows.groupBy(*groups, "node_of").agg(F.count("*").alias("times"))
    else:
        rows = rows.withColumn("times", F.lit(1).cast("long"))
    leaves = quantize(rows, "node_of", "node").where("node is not null").groupBy(*groups, "node").agg(F.sum("times").alias("n"))
    return _compressed(leaves.select(*groups, F.lit(0).alias("level"), "node", "n"), groups, eps)


def merge_digests(digests: DataFrame, groups: list[str], *, eps: float = 0.001) -> DataFrame:
    """Digests of parts put together by adding equal nodes, per ``groups``; the error bound stays ``eps`` of the whole plus that of the parts."""
    added = digests.groupBy(*groups, "level", "node").agg(F.sum("n").alias("n"))
    return _compressed(added, groups, eps)


def percentiles(digests: DataFrame, groups: list[str], pcts: list[int]) -> DataFrame:
    """``(groups, pct, value, size)``; the percentile of n sorted values is the one at index floor(n * pct / 100), and at most the last."""
    kinds = dict(digests.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        level, node, n = (pdf[c].to_numpy() for c in ("level", "node", "n"))
        right = ((node + 1) << level) - 1
        order = np.lexsort((level, right))
        reached = np.cumsum(n[order])
        size = int(reached[-1])
        rank = np.minimum([size * p // 100 for p in pcts], size - 1)
        out = pd.DataFrame({"pct": pcts, "value": leaf_value(right[order][np.searchsorted(reached, rank, side="right")]), "size": size})
        for i, g in enumerate(groups):
            out.insert(i, g, pdf[g].iloc[0])
        return out

    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in groups), "pct int, value double, size long"])
    return digests.groupBy(*groups).applyInPandas(one, schema)


def counted_queries(metrics: DataFrame, value: str, *, key: str = "query_id", ts: str = "ts") -> DataFrame:
    """``(metric_day, value)`` once per query: null and negative values are left out, of copies that disagree the earliest time and smallest value count."""
    ok = metrics.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & (F.col(value) >= 0))
    once = ok.groupBy(key).agg(F.min(ts).alias("t"), F.min(value).alias("value"))
    return once.select(F.date_format("t", "yyyy-MM-dd").alias("metric_day"), "value")


def rank_errors(found: DataFrame, values: DataFrame, groups: list[str], value: str) -> DataFrame:
    """``(groups, pct, size, error)``: by how many ranks each row of ``percentiles`` is off, counted over all values.

    0 where the leaf that was found holds the rank asked for. Groups and percentiles are joined to counts per leaf, not to values.
    """
    leaves = quantize(values.select(*groups, F.col(value).alias("leaf_of")), "leaf_of", "leaf").where("leaf is not null").groupBy(*groups, "leaf").agg(F.count("*").alias("n"))
    asked = quantize(found.select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)], "pct", "size", "value"), "value", "at")
    same = [F.col(g).eqNullSafe(F.col(f"g{i}")) for i, g in enumerate(groups)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    both = leaves.join(asked, on).groupBy(*groups, "pct", "size")
    counted = both.agg(F.sum(F.when(F.col("leaf") < F.col("at"), F.col("n")).otherwise(0)).alias("below"), F.sum(F.when(F.col("leaf") <= F.col("at"), F.col("n")).otherwise(0)).alias("upto"))
    rank = F.least(F.expr("size * pct div 100"), F.col("size") - 1)
    return counted.select(*groups, "pct", "size", F.greatest(F.lit(0), F.col("below") - rank, rank - F.col("upto") + 1).alias("error"))

"""Exact top-k by inner product with vector-approximation files.

Two files are written: the exact vectors, and their approximation, which has one byte per component. A vector's
numbers are cut to cells of 2**shift numbers, its own shift being as small as the bytes allow, so that a
few large vectors do not blur the others. Only the approximation is scanned: blocks of it meet blocks of queries and give
bounds from below and above for every score. A vector whose upper bound lies under the kth lower bound of its query
is out. Exact vectors are then read from the highest upper bound down: first a few per query, which give a
kth exact score, then those whose bound still reaches it. After these the kth result is certain.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gainsay.llm.common import staged

BLOCK_ROWS = 8192
QUERY_ROWS = 1024
CELL_BITS = 6
_QUERIES_AT_ONCE = 64
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1

_BOUNDED = "query bigint, place bigint, same boolean, lower double, upper double"


def whole_vectors(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256
) -> DataFrame:
    """``vec_id``, ``v`` (each component as floor(scale * x)) and ``copies``, the rows that have both alike.

    Rows without a vec_id and those with a null or non-finite part go.
    """
    x = F.col(embedding)
    good = F.col(vec_id).isNotNull() & x.isNotNull() & F.forall(
        x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False))
    )
    return (
        vectors.filter(good)
        .select(
            F.col(vec_id).cast("bigint").alias("vec_id"),
            F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("bigint")).alias("v"),
        )
        .groupBy("vec_id", "v")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def _matrix(rows: list[np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def cells(rows: list[np.ndarray], bits: int = CELL_BITS) -> tuple[list[bytes], list[int]]:
    """The cells of each vector, a signed byte per component, and the vector's shift."""
    found, shifts = [], []
    for row in rows:
        # ~x has the bits of a negative x without its sign.
        longest = int(np.where(row < 0, ~row, row).max(initial=0)).bit_length()
        shifts.append(max(0, longest + 1 - bits))
        found.append((row >> shifts[-1]).astype(np.int8).tobytes())
    return found, shifts


def bounds(queries: np.ndarray, cell: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of ``queries`` (a row each) with the vectors of ``cell``.

    Floats are widened by more than their rounding can be, so the bounds hold for numbers of any size. They are held
    within 64 bits as the scores are.
    """
    asked, scale = queries.astype(np.float64), np.exp2(shift.astype(np.float64))
    corner = (asked @ cell.T.astype(np.float64)) * scale
    rounding = np.abs(asked).sum(axis=1)[:, None] * scale * (130.0 * (asked.shape[1] + 8) * 2.0**-52)
    below = np.minimum(asked, 0).sum(axis=1)[:, None] * (scale - 1)
    above = np.maximum(asked, 0).sum(axis=1)[:, None] * (scale - 1)
    held = lambda x: np.clip(x, float(_LOWEST), float(_HIGHEST))
    return held(corner + below - rounding), held(corner + above + rounding)


def possible(lower: np.ndarray, upper: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Places of the vectors that may be among the ``k`` best: those that reach the kth lower bound.

    ``own`` vectors have the query's id and may be its own row, so they do not raise the threshold.
    """
    sure = lower[~own]
    least = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) >= k else -np.inf
    return np.flatnonzero(upper >= least)


def _approximations(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, shifts = cells(list(batch["v"]), bits)
            yield pd.DataFrame({"place": batch["place"], "vec_id": batch["vec_id"], "shift": shifts, "cells": found})

    return run


def _scan(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"query": [], "place": [], "same": [], "lower": [], "upper": []})]
        if len(left) and len(right):
            asked = list(right["asked"])
            dims = max(max(map(len, left["cells"])), max(map(len, asked)))
            cell = _matrix([np.frombuffer(c, dtype=np.int8) for c in left["cells"]], dims)
            shift, place, vec_id = (left[c].to_numpy() for c in ("shift", "place", "vec_id"))
            numbers, query, query_id = _matrix(asked, dims), right["query"].to_numpy(), right["query_id"].to_numpy()
            for first in range(0, len(query), _QUERIES_AT_ONCE):
                some = slice(first, first + _QUERIES_AT_ONCE)
                for q, i, low, up in zip(query[some], query_id[some], *bounds(numbers[some], cell, shift)):
                    own = vec_id == i
                    at = possible(low, up, own, k)
                    parts.append(pd.DataFrame(
                        {"query": q, "place": place[at], "same": own[at], "lower": low[at], "upper": up[at]}
                    ))
        return pd.concat(parts, ignore_index=True).astype({"query": "int64", "place": "int64", "same": "bool"})

    return run


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exact scores of pairs of a query and a vector, held within 64 bits, and whether both are alike."""
    for batch in batches:
        scores, alike = [], []
        for v, asked in zip(batch["v"], batch["asked"]):
            shared = min(len(v), len(asked))
            a, b = v[:shared], asked[:shared]
            # Wide numbers as Python's, which have no limit; the others cannot leave 64 bits.
            reach = np.abs(a.astype(np.float64)) @ np.abs(b.astype(np.float64))
            score = int(a @ b) if reach < 2.0**62 else sum(x * y for x, y in zip(a.tolist(), b.tolist()))
            scores.append(min(max(score, _LOWEST), _HIGHEST))
            alike.append(np.array_equal(v, asked))
        found = batch.drop(columns=["v", "asked"])
        found["score"], found["alike"] = np.array(scores, dtype=np.int64), np.array(alike, dtype=bool)
        yield found


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
    bits: int = CELL_BITS,
) -> DataFrame:
    """The ``k`` highest inner products of every query with all rows but its own, ranked from 1, ties to smaller ids.

    Both frames have ``vec_id``, ``v`` and ``copies`` (see ``whole_vectors``). Every row is a candidate and
    every row of ``queries`` a query: repeated rows are candidates for each other and get results of their own.
    Shorter vectors count as filled with zeros. Scores beyond 64 bits are held at the limit. Without vectors or queries
    there are no rows. ``exact_reads`` is the number of exact vectors that the query has read.
    """
    # Of equal vectors a result holds at most the k smallest ids beside the query's own: a group of copies of
    # any size is cut to these in the map tasks, and no query reads more of it.
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    kept = vectors.withColumn("_nth", place).filter(F.col("_nth") <= k + 1).drop("_nth")
    exact = staged(kept.withColumn("place", F.monotonically_increasing_id()), "vectors")
    asking = staged(
        queries.select(
            F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"),
            F.col("v").alias("asked"), F.col("copies").alias("times"),
        ), "queries",
    )
    approximated = staged(
        exact.select("place", "vec_id", "v")
        .mapInPandas(_approximations(bits), "place bigint, vec_id bigint, shift int, cells binary"), "cells",
    )
    candidates = staged(_candidates(approximated, asking, k, block_rows, query_rows), "candidates")

    best = Window.partitionBy("query").orderBy(F.desc("upper"), "place")
    ordered = candidates.withColumn("nth", F.row_number().over(best))
    first = staged(_read(ordered.filter(F.col("nth") <= 2 * k), exact, asking), "first")
    others = first.filter(~(F.col("same") & F.col("alike")))
    nth = Window.partitionBy("query").orderBy(F.desc("score"))
    certain = (
        others.withColumn("nth_score", F.row_number().over(nth))
        .filter(F.col("nth_score") == k)
        .select("query", F.col("score").alias("kth"))
    )
    open_ = ordered.filter(F.col("nth") > 2 * k).join(certain, "query", "left").filter(
        F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))
    ).drop("kth")
    return _ranked(first.unionByName(_read(open_, exact, asking)), k)


def _candidates(approximated: DataFrame, asking: DataFrame, k: int, block_rows: int, query_rows: int) -> DataFrame:
    """Pairs whose upper bound reaches the kth lower bound of the query over all blocks."""
    n = approximated.select(F.count(F.lit(1))).first()[0]
    m = asking.select(F.count(F.lit(1))).first()[0]
    blocks, query_blocks = max(1, ceil(n / block_rows)), max(1, ceil(m / query_rows))

    def dealt(key: str, number: int, others: int) -> tuple[Column, Column]:
        place = F.pmod(F.xxhash64(key), F.lit(number)).cast("int")
        return place, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))

    own, every = dealt("place", blocks, query_blocks)
    stored = approximated.select("*", own.alias("block"), every.alias("query_block"))
    own, every = dealt("query", query_blocks, blocks)
    asked = asking.select("query", "query_id", "asked", own.alias("own_block"), every.alias("against"))
    found = (
        stored.groupBy("block", "query_block")
        .cogroup(asked.groupBy("against", "own_block"))
        .applyInPandas(_scan(k), _BOUNDED)
    )
    # Own rows come last and so raise no threshold; where others are fewer than k there is none.
    sure = Window.partitionBy("query").orderBy(F.col("same"), F.desc("lower"))
    held = Window.partitionBy("query")
    threshold = F.max(F.when((F.col("_nth") == k) & ~F.col("same"), F.col("lower"))).over(held)
    return (
        found.withColumn("_nth", F.row_number().over(sure))
        .withColumn("_least", threshold)
        .filter(F.col("_least").isNull() | (F.col("upper") >= F.col("_least")))
        .select("query", "place", "same", "upper")
    )


def _read(pairs: DataFrame, exact: DataFrame, asking: DataFrame) -> DataFrame:
    """The pairs with the exact scores of their vectors."""
    return (
        pairs.select("query", "place", "same")
        .join(exact.select("place", "vec_id", "v", "copies"), "place")
        .join(asking.select("query", "query_id", "asked", "times"), "query")
        .mapInPandas(
            _scored,
            "query bigint, place bigint, same boolean, vec_id bigint, copies bigint, query_id bigint, times bigint, "
            "score bigint, alike boolean",
        )
    )


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    own = F.when(F.col("same") & F.col("alike"), F.lit(1)).otherwise(F.lit(0))
    reads = F.count(F.lit(1)).over(Window.partitionBy("query"))
    rows = F.least(F.col("copies") - own, F.lit(k)).cast("int")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (
        scored.withColumn("exact_reads", reads)
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(0), rows)))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .withColumn("_time", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
        .select("query_id", "rank", "vec_id", "score", "exact_reads")
    )

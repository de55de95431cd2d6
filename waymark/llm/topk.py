"""Exact top-k inner-product search by pivot-table elimination.

The distances of every vector to a set of pivots are computed once.  For a
query, the largest difference of pivot distances is a lower bound of its
distance to a candidate, and |q|^2 + |x|^2 - distance^2 = 2 q.x turns that into
an upper bound of the inner product.  Candidates are evaluated in bound order
until the next bound is below the query's k-th best score, so the result is exact.

Vectors are laid out by their nearest pivot and the distance to it, so that a
batch of them is narrow: one bound for the whole batch, from the ranges of its
pivot distances, rules it out for most queries.  Queries go to the candidates in
passes of a bounded number; candidates never move for a pass, so what is
shuffled grows with the vectors and with k rows a query and task.  In each pass
a bounded set of candidates first gives every query a k-th score to start from.

Defined cases: vectors that are null or hold null or non-finite components take
no part; shorter vectors count as filled up with zeros, an empty one too;
scores are exact at any size and cut to the range of a long;
repeated ids are separate rows and only a query's own id is left out; fewer than
k candidates give fewer rows; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K = 10
PIVOTS = 32
#: Queries of a pass, and candidates that give them their first k-th score (both with their vectors on the driver).
QUERY_BLOCK = 4096
FIRST = 2048
#: Candidates that one bound rules out together, and candidates evaluated between two looks at the stopping bound.
CANDIDATE_BLOCK = 1024
STEP = 256

_BEST = "query_id long, vec_id long, score long, evaluated long"


def integer_vectors(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v: floor(scale * component) of the vectors that take part."""
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~bad)
    # from 2^53 on a double is whole, and a long would not hold all of them
    whole = lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale)
    return good.select("vec_id", F.transform("e", whole).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), dims)


def _distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((m * m).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * m @ pivots.T, 0))


def _with_pivots(pivots: np.ndarray, dims: int):
    """vec_id, v, the distances to the pivots, the nearest pivot and its distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_matrix(batch.column(1), dims), pivots)
            cell = d.argmin(1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32)), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["vec_id", "v", "d", "cell", "near"])

    return run


#: The largest score; smaller and larger products are cut to its range.
_LONG = (1 << 63) - 1


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products as longs, exact: doubles hold them as far as no sum can pass 2^53, else Python's numbers do."""
    if np.abs(x).max(initial=0.0) * np.abs(q).max(initial=0.0) * max(1, len(q)) < 2.0**53:
        return (x @ q).astype(np.int64)
    wide = [int(c) for c in q.tolist()]
    return np.array([min(_LONG, max(-_LONG, sum(int(a) * b for a, b in zip(row, wide, strict=True)))) for row in x.tolist()], np.int64)


def _best(score: np.ndarray, who: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    top = np.lexsort((who, -score))[:k]
    return score[top], who[top]


def _pass(query_ids: np.ndarray, q: np.ndarray, own: np.ndarray, least: np.ndarray, k: int, step: int, block: int, pivots: int):
    """A task's best candidates of each query; ``least`` is a score that k other candidates reach already."""
    q2, dims = (q * q).sum(1), q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = [np.zeros(0, np.int64)] * len(q)
        names = [np.zeros(0, np.int64)] * len(q)
        floor = least - np.where(np.isfinite(least), np.abs(least), 0) * 1e-12  # a score past 2^53 is rounded
        evaluated = np.zeros(len(q), np.int64)
        for batch in (b.slice(a, block) for b in batches for a in range(0, b.num_rows, block)):
            ids, x, to = np.asarray(batch.column(0)), _matrix(batch.column(1), dims), _matrix(batch.column(2), pivots)
            x2 = (x * x).sum(1)
            low, high = to.min(0), to.max(0)
            gap = np.maximum(np.maximum(low[None, :] - own, own - high[None, :]), 0).max(1)
            # rounding of the distances must never lower a bound below the true score
            most = (q2 + x2.max() - np.maximum(gap - 1e-6 * (1 + gap), 0) ** 2) / 2 + 1e-3 + 1e-12 * (q2 + x2.max())
            most = np.where(most > _LONG, np.inf, most)  # cut scores tie
            for i in np.flatnonzero(most >= floor).tolist():
                bound = np.abs(to - own[i]).max(1)
                each = (q2[i] + x2 - np.maximum(bound - 1e-6 * (1 + bound), 0) ** 2) / 2 + 1e-3 + 1e-12 * (q2[i] + x2)
                each = np.where(each > _LONG, np.inf, each)
                near = np.flatnonzero((each >= floor[i]) & (ids != query_ids[i]))
                near = near[np.argsort(-each[near], kind="stable")]
                for at in range(0, len(near), step):
                    if each[near[at]] < floor[i]:
                        break
                    some = near[at : at + step]
                    evaluated[i] += len(some)
                    scores[i], names[i] = _best(np.concatenate((scores[i], _scores(x[some], q[i]))), np.concatenate((names[i], ids[some])), k)
                    if len(scores[i]) == k:
                        floor[i] = max(floor[i], scores[i][-1] - abs(float(scores[i][-1])) * 1e-12)
        n = [len(s) for s in scores]
        first = np.zeros(sum(n), np.int64)
        first[np.cumsum([0, *n[:-1]])[np.array(n) > 0]] = evaluated[np.array(n) > 0]
        some = [(s, w) for s, w in zip(scores, names, strict=True) if len(s)]
        if some:
            score, who = (np.concatenate(c) for c in zip(*some, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, n)), pa.array(who, pa.int64()), pa.array(score, pa.int64()), pa.array(first)], ["query_id", "vec_id", "score", "evaluated"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, first: int = FIRST) -> DataFrame:
    """The k best candidates of each query: query_id, rank, vec_id, score, evaluated.

    Both inputs: vec_id, v (whole numbers as doubles).  The pivots are the
    ``pivots`` vectors that come first by a hash of their ids, the first
    candidates the ``first`` that do; any choice gives the same result.
    ``evaluated`` is the number of inner products that the tasks with results
    computed for the query.
    """
    spark = vectors.sparkSession
    dims = max(1, *(t.agg(F.coalesce(F.max(F.size("v")), F.lit(1))).first()[0] for t in (vectors, queries)))
    filled = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("v"))).alias("v")
    vectors, queries = (t.select("vec_id", filled) for t in (vectors, queries))
    known = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(max(first, pivots)).collect()
    if not known:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, evaluated long")
    known_ids, x = np.array([r["vec_id"] for r in known], np.int64), np.array([r["v"] for r in known], np.float64).reshape(len(known), dims)
    table = x[:pivots]
    placed = vectors.mapInArrow(_with_pivots(table, dims), "vec_id long, v array<double>, d array<double>, cell int, near double")
    # copies of one vector differ in their ids, so a range never has to hold all of them
    laid = cut(placed.repartitionByRange("cell", "near", "vec_id").sortWithinPartitions("cell", "near", "vec_id"))

    asked = cut(queries)
    blocks = max(1, -(-asked.count() // query_block))
    numbered = cut(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))))
    out = None
    for block in range(blocks):
        rows = numbered.where(F.col("block") == block).select("vec_id", "v").collect()  # about query_block of them
        if not rows:
            continue
        ids, q = np.array([r["vec_id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.float64).reshape(len(rows), dims)
        score = q @ x.T
        score[ids[:, None] == known_ids[None, :]] = -np.inf
        score = np.clip(score, -float(_LONG), float(_LONG), out=score, where=np.isfinite(score))
        least = np.partition(score, -k, 1)[:, -k] if len(known) >= k else np.full(len(q), -np.inf)
        found = laid.select("vec_id", "v", "d").mapInArrow(_pass(ids, q, _distances(q, table), least, k, STEP, candidate_block, len(table)), _BEST)
        found = cut(found) if blocks > 1 else found  # a pass leaves its rows, not its queries
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, evaluated long")
    by = Window.partitionBy("query_id")
    ranked = out.withColumn("evaluated", F.sum("evaluated").over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "evaluated")

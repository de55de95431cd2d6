"""Hard-negative mining over k-means inverted lists with stored radii.

Every vector lies in the list of its nearest centroid; a centroid keeps the
largest distance of its list's vectors.  By Cauchy-Schwarz an anchor's product
with any vector of a list is within |anchor| * radius of its product with the
centroid.  An anchor visits lists in the order of that upper bound and stops when
the bound falls strictly below its k-th score; for negatives it leaves out lists
whose bounds lie outside all of its windows.  Visits come in waves: the first few
lists, more of them, then whatever the k-th score leaves.  So the result is exact
for any centroids, which are fitted to a bounded sample.

Lists are cut into parts by a hash of the row, so a list with very many copies
of one vector is spread, and anchors are dealt into blocks; a task meets a part of
a list with a block of anchors.  Only centroids and radii, of which there are
``lists`` at most, are known to all tasks.

Defined cases: rows with a null label, a null id, a null vector or a null or
non-finite component take no part; shorter vectors count as filled with zeros, an
empty one too; repeated ids are rows of their own, and an anchor leaves out all
rows with its id; ties go to the smaller id; products are exact whole numbers at
any size, cut to the range of a long; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K = 5
#: Most vectors to which centroids are fitted, most of their components that count, most lists, rounds of the fit.
SAMPLE, DIMS, LISTS, FIT_ROUNDS = 10_000, 4096, 256, 8
#: Rows of a part of a list, anchors of a block, lists that an anchor visits in the first waves (None: all that the bound leaves).
PART, BLOCK, WAVES = 4096, 2048, (4, 24, None)
#: Anchors whose products with a part are held at once.
STEP = 128

_LONG = (1 << 63) - 1


def whole_vectors(embeddings: DataFrame, scale: int, label: Column) -> DataFrame:
    """id, label, v: floor(scale * component), whole numbers as doubles, of the rows that take part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & ~bad)
    return good.mapInArrow(_floors(scale), "id long, label long, v array<double>")


def _floors(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            flat = np.floor(np.asarray(column.flatten(), np.float64) * scale)
            offsets = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "label", "v"])

    return run


@dataclass
class Vectors:
    """Vectors of any lengths: the first components as a matrix, what is longer apart."""

    head: np.ndarray
    tails: dict[int, np.ndarray]

    def norms(self) -> np.ndarray:
        out = (self.head * self.head).sum(1)
        for i, tail in self.tails.items():
            out[i] += tail @ tail
        return np.sqrt(out)

    def take(self, rows: np.ndarray) -> Vectors:
        return Vectors(self.head[rows], {k: self.tails[int(i)] for k, i in enumerate(rows) if int(i) in self.tails} if self.tails else {})


def vectors(column: pa.Array, dims: int) -> Vectors:
    """The vectors of a list column, with a head of ``dims`` components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), np.float64)
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (n == dims).all():
        return Vectors(flat.reshape(len(n), dims), {})
    start = np.concatenate(([0], np.cumsum(n)))[:-1]
    head, kept = np.zeros((len(n), dims)), np.minimum(n, dims)
    row = np.repeat(np.arange(len(n)), kept)
    at = np.arange(len(row)) - np.repeat(np.cumsum(kept) - kept, kept)
    head[row, at] = flat[start[row] + at]
    return Vectors(head, {int(i): flat[start[i] + dims : start[i] + n[i]] for i in np.flatnonzero(n > dims)})


def products(q: Vectors, x: Vectors) -> np.ndarray:
    """Inner products, exact: doubles hold them as far as no sum can pass 2^53, else Python's numbers do (cut to the range of a long)."""
    reach = lambda v: max([np.abs(v.head).max(initial=0.0), *(np.abs(t).max(initial=0.0) for t in v.tails.values())])
    length = q.head.shape[1] + max([0, *(len(t) for t in q.tails.values())])
    if float(reach(q)) * float(reach(x)) * max(1, length) < 2.0**53:
        out = q.head @ x.head.T
        for i, a in q.tails.items():
            for j, b in x.tails.items():
                out[i, j] += a[: len(b)] @ b[: len(a)]
        return out
    wide = lambda m: [[int(c) for c in row] for row in m.tolist()]
    out = np.zeros((len(q.head), len(x.head)), object)
    left, right = wide(q.head), wide(x.head)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            out[i, j] = sum(map(int.__mul__, a, b))
            if i in q.tails and j in x.tails:
                out[i, j] += sum(int(c) * int(d) for c, d in zip(q.tails[i], x.tails[j], strict=False))
            out[i, j] = min(_LONG, max(-_LONG - 1, out[i, j]))
    return out


def fit(sample: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from rows that lie apart in the sample's order; empty ones keep their place."""
    distinct = np.unique(sample, axis=0)
    centroids = distinct[np.linspace(0, len(distinct) - 1, min(lists, len(distinct))).astype(int)]
    for _ in range(rounds):
        near = _nearest(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(centroids))
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def _nearest(head: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids * centroids).sum(1)[None, :] - 2 * head @ centroids.T).argmin(1)


def _listed(centroids: np.ndarray):
    """id, label, v, the nearest centroid and a distance to it that rounding has not made less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors(batch.column(2), centroids.shape[1])
            near = _nearest(x.head, centroids)
            gap = Vectors(x.head - centroids[near], x.tails)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(gap.norms() * (1 + 1e-9))], [*batch.schema.names, "list", "far"])

    return run


def _bounded(centroids: np.ndarray, radii: np.ndarray, first: int, last: int | None):
    """The lists that an anchor visits in a wave: places first .. last-1 in the order of the upper bound, none outside [least, most].

    least and most are the anchor's k-th score, or the bounds of its windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = vectors(batch.column(batch.schema.get_field_index("v")), centroids.shape[1])
            least, most = (np.asarray(batch.column(batch.schema.get_field_index(c)), np.float64) for c in ("least", "most"))
            middle, norm = q.head @ centroids.T, q.norms()[:, None]
            # rounding must never bring a bound below the true product
            slack = 1e-9 * norm * (np.sqrt((centroids * centroids).sum(1)) + radii)[None, :] + 1e-3
            reach = np.where(radii < 0, np.nan, norm * np.maximum(radii, 0)) + slack
            upper, lower = (np.clip(b, -float(_LONG), float(_LONG)) for b in (middle + reach, middle - reach))
            place = np.argsort(np.argsort(-np.where(np.isnan(upper), -np.inf, upper), axis=1, kind="stable"), axis=1, kind="stable")
            near = [1e-12 * np.where(np.isfinite(x), np.abs(x), 0)[:, None] for x in (least, most)]
            visit = (upper >= least[:, None] - near[0]) & (lower <= most[:, None] + near[1]) & (place >= first)
            if last is not None:
                visit &= place < last
            row, which = np.nonzero(visit)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(row)) for c in batch.columns] + [pa.array(which.astype(np.int32))], [*batch.schema.names, "list"])

    return run


_FOUND = "anchor long, slot int, id long, score long, other_score long"


def _rows(out: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["anchor", "slot", "id", "score", "other_score"])


def _first(score: np.ndarray, ids: np.ndarray, some: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``some`` the k that come first by score, then by id."""
    if len(some) > k and score.dtype != object:
        some = some[score[some] >= np.partition(score[some], len(some) - k)[len(some) - k]]
    return np.array(sorted(some.tolist(), key=lambda j: (-score[j], ids[j]))[:k], np.int64)


def _meet(dims: int, k: int, windows: bool):
    """Products of a part of a list with the anchors that visit it: the k first of the same label, or of other labels in each window."""

    def run(part: pa.Table, anchors: pa.Table) -> pa.Table:
        if not part.num_rows or not anchors.num_rows:
            return _rows([])
        x, ids, labels = vectors(part.column("v"), dims), part.column("id").to_numpy(), part.column("label").to_numpy()
        asked, own, own_id = anchors.column("anchor").to_numpy(), anchors.column("label").to_numpy(), anchors.column("anchor_id").to_numpy()
        all_q, out = vectors(anchors.column("v"), dims), []
        least = np.asarray(anchors.column("least").combine_chunks(), np.float64)
        least = least - np.where(np.isfinite(least), np.abs(least), 0) * 1e-12  # a k-th score past 2^53 is rounded
        wanted = anchors.column("windows").to_pylist() if windows else None
        for at in range(0, len(asked), STEP):
            rows = np.arange(at, min(at + STEP, len(asked)))
            scores = products(all_q.take(rows), x)
            for i, score in zip(rows.tolist(), scores, strict=True):
                if not windows:
                    some = np.flatnonzero((labels == own[i]) & (ids != own_id[i]) & (score >= least[i]).astype(bool))
                    out += [(asked[i], 0, ids[j], s, 0) for j, s in _best(score, ids, some, k)]
                    continue
                other = np.flatnonzero(labels != own[i])
                for w in wanted[i]:
                    p = int(w["score"])
                    if score.dtype == object:
                        fits = np.array([80 * p <= 100 * s <= 100 * p for s in score[other]], bool)
                    else:  # doubles hold the products exactly, and ceil(0.8 p) and p are whole
                        fits = (score[other] >= -(-80 * p // 100)) & (score[other] <= p)
                    out += [(asked[i], w["slot"], ids[j], s, p) for j, s in _best(score, ids, other[fits], k)]
        return _rows(out)

    return run


def _best(score: np.ndarray, ids: np.ndarray, some: np.ndarray, k: int) -> list[tuple[int, int]]:
    first = _first(score, ids, some, k)
    return list(zip(first.tolist(), map(int, score[first]), strict=True))


@dataclass
class InvertedLists:
    """Vectors by list and part, with what every task knows of the lists."""

    rows: DataFrame  # id, label, v, list, part
    centroids: np.ndarray
    radii: np.ndarray  # -1: no vector
    parts: list[int]

    @classmethod
    def build(cls, table: DataFrame, lists: int = LISTS, sample: int = SAMPLE, part_rows: int = PART) -> InvertedLists:
        """table: id, label, v, as checkpointed.  Centroids are fitted to the ``sample`` rows that come first by a hash."""
        some = table.orderBy(F.xxhash64("id"), "id", "label").limit(sample).select(F.slice("v", 1, DIMS).alias("v")).collect()
        dims = max(1, sorted(len(r["v"]) for r in some)[len(some) // 2]) if some else 1
        head = np.zeros((len(some), dims))
        for i, r in enumerate(some):
            head[i, : len(r["v"])] = r["v"][:dims]
        count = table.count()
        centroids = fit(head, min(lists, max(1, math.isqrt(count))), FIT_ROUNDS) if some else np.zeros((1, 1))
        listed = cut(table.mapInArrow(_listed(centroids), "id long, label long, v array<double>, list int, far double"))
        radii, parts = np.full(len(centroids), -1.0), [1] * len(centroids)
        for r in listed.groupBy("list").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # a row a list
            radii[r["list"]], parts[r["list"]] = r["far"], -(-r["n"] // part_rows)
        of = F.element_at(F.array(*map(F.lit, parts)), F.col("list") + 1)
        rows = listed.withColumn("part", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), of).cast("int"))
        return cls(cut(rows.select("id", "label", "v", "list", "part")), centroids, radii, parts)

    def resident(self, blocks: int) -> DataFrame:
        """The parts, once for each block of anchors, kept where the anchors of all waves come to them."""
        rows = self.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(tasks, "list", "part", "block").persist()

    def visit(self, resident: DataFrame, anchors: DataFrame, first: int, last: int | None, k: int, windows: bool) -> DataFrame:
        """What the anchors find in the lists of one wave."""
        kept = [c for c in ("anchor", "anchor_id", "label", "v", "block", "least", "most", "windows") if c in anchors.columns]
        asking = anchors.select(kept)
        kinds = {f.name: f.dataType.simpleString() for f in asking.schema}
        visits = asking.mapInArrow(_bounded(self.centroids, self.radii, first, last), ", ".join(f"{c} {kinds[c]}" for c in kept) + ", list int")
        parts = F.element_at(F.array(*map(F.lit, self.parts)), F.col("list") + 1)
        visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        key = ["list", "part", "block"]
        return resident.groupBy(*key).cogroup(visits.groupBy(*key)).applyInArrow(_meet(self.centroids.shape[1], k, windows), _FOUND)


def _merge(found: list[DataFrame], k: int) -> DataFrame:
    """The k first of all that was found for an anchor (and window)."""
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(table: DataFrame, is_anchor: Column, k_positive: int = K, k_negative: int = K, waves: tuple = WAVES, block: int = BLOCK, **lists) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    table: id, label, v.  An anchor's positives are its first rows of the same
    label; a positive's negatives are the first rows of other labels with a score
    from 80 to 100 percent of the positive's.
    """
    table = cut(table)
    index = InvertedLists.build(table, **lists)
    low, high = F.lit(float("-inf")).alias("least"), F.lit(float("inf")).alias("most")
    anchors = cut(table.where(is_anchor)).select(F.monotonically_increasing_id().alias("anchor"), F.col("id").alias("anchor_id"), "label", "v")
    anchors = cut(anchors)
    blocks = max(1, -(-anchors.count() // block))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int"))

    resident = index.resident(blocks)
    positives = None
    for first, last in zip((0, *waves), waves, strict=False):
        asking = anchors.select("*", low, high)
        if positives is not None:  # lists whose bound is strictly below the k-th score are over
            kth = positives.where(F.col("rank") == k_positive).select("anchor", F.col("score").cast("double").alias("kth"))
            asking = anchors.join(kth, "anchor", "left").select(*anchors.columns, F.coalesce("kth", low).alias("least"), high)
        found = index.visit(resident, asking, first, last, k_positive, False)
        positives = cut(_merge([found] if positives is None else [positives.drop("rank"), found], k_positive))

    kept = positives.where("score >= 0").select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), "score")  # below 0 no window is open
    # one search for equal scores of an anchor; the windows of an anchor travel with it
    asked = kept.groupBy("anchor", "score").agg(F.min("slot").alias("slot"))
    opened = asked.groupBy("anchor").agg(F.collect_list(F.struct("slot", "score")).alias("windows"), F.min("score").alias("least"), F.max("score").alias("high"))
    negatives = None
    for first, last in zip((0, *waves), waves, strict=False):
        open_ = opened
        if negatives is not None:  # a window with all its negatives asks for what its last one leaves open
            kth = negatives.where(F.col("rank") == k_negative).select("anchor", "slot", F.col("score").alias("kth"))
            floors = asked.join(kth, ["anchor", "slot"], "left").withColumn("floor", F.coalesce(F.col("kth").cast("double"), F.col("score") * 0.8))
            open_ = floors.groupBy("anchor").agg(F.collect_list(F.struct("slot", "score")).alias("windows"), F.min("floor").alias("least"), F.max("score").alias("high"))
        else:
            open_ = opened.withColumn("least", F.col("least") * 0.8)
        asking = anchors.join(open_, "anchor").select(*anchors.columns, "windows", F.col("least").cast("double").alias("least"), F.col("high").cast("double").alias("most"))
        found = index.visit(resident, asking, first, last, k_negative, True)
        negatives = cut(_merge([found] if negatives is None else [negatives.drop("rank"), found], k_negative))

    resident.unpersist()
    same = asked.withColumnRenamed("slot", "of")
    each = kept.join(same, ["anchor", "score"]).select("anchor", F.col("of").alias("slot"), "positive_id", F.col("score").alias("positive_score"))
    named = anchors.select("anchor", "anchor_id")
    told = each.join(negatives, ["anchor", "slot"]).join(named, "anchor")
    return told.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

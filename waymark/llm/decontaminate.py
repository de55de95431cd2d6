"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are runs of a-z, 0-9 and non-ASCII characters after A-Z are lower-cased.
A window is ``size`` consecutive words of a benchmark item; an item with fewer
words, but not none, is one window of its own length.  Every window of every
document is looked up by hash and each hit is verified against the words.

Defined cases: null or wordless texts have no words, hits or items and are not
contaminated; items whose id is null or that have no words take no part; rows
that repeat an item id are one item; repeated documents are judged row by row;
an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_and_text, names_apart
from .kernels import LETTERS_DIGITS, inside_documents, window_hashes, words

WINDOW = 13
#: Largest window table that is broadcast, in windows and in bytes of their words; a larger benchmark is joined by a shuffle.
BROADCAST_WINDOWS = 500_000
BROADCAST_BYTES = 64 << 20

_WINDOWS = "item_id long, size int, hash long, words binary"
_HITS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _item_windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for part in words(batch.column(1), LETTERS_DIGITS):
                hashes = part.hashes()
                for k in range(part.first, part.last):
                    a, b = part.edges[k - part.first], part.edges[k - part.first + 1]
                    width = min(size, b - a)
                    if width and ids[k] is not None:
                        for i, h in zip(range(a, b - width + 1), window_hashes(hashes[a:b], width).view(np.int64), strict=True):
                            rows.append((ids[k], width, int(h), part.text(i, i + width)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["item_id", "size", "hash", "words"]
            )

    return run


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows of each item: item_id, size, hash, words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(_item_windows(size), _WINDOWS).distinct()


def _digest(items: set) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def _scan(table: list[tuple[int, int, int, bytes]]):
    """A scan of document windows against the broadcast table of (item_id, size, hash, words)."""
    by_words: dict[bytes, list[int]] = {}
    for item, _, _, text in table:
        by_words.setdefault(text, []).append(item)
    keys = {size: np.unique(np.array([h for _, s, h, _ in table if s == size], np.int64).view(np.uint64)) for size in sorted({r[1] for r in table})}
    none = _digest(set())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words, n_hit, n_items, digests = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [none] * n
            for part in words(batch.column(1), LETTERS_DIGITS):
                n_words[part.first : part.last] = np.diff(part.edges)
                hashes = part.hashes()
                cover = np.zeros(len(hashes) + 1, np.int64)
                found: dict[int, set] = {}
                for size, wanted in keys.items():
                    own = window_hashes(hashes, size)
                    # most windows miss: a table of 16 hash bits decides before the search
                    gate = np.zeros(1 << 16, bool)
                    gate[wanted >> np.uint64(48)] = True
                    maybe = np.flatnonzero(gate[own >> np.uint64(48)])
                    at = np.searchsorted(wanted, own[maybe])
                    maybe = maybe[wanted[np.minimum(at, len(wanted) - 1)] == own[maybe]]
                    maybe = maybe[inside_documents(part.edges, len(own), size)[maybe]]
                    docs = np.searchsorted(part.edges, maybe, "right") - 1
                    for i, d in zip(maybe.tolist(), docs.tolist(), strict=True):
                        if (items := by_words.get(part.text(i, i + size))) is not None:
                            cover[i] += 1
                            cover[i + size] -= 1
                            found.setdefault(d, set()).update(items)
                if found:
                    hit = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
                    n_hit[part.first : part.last] = hit[part.edges[1:]] - hit[part.edges[:-1]]
                    for d, items in found.items():
                        n_items[part.first + d] = len(items)
                        digests[part.first + d] = _digest(items)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_hit), pa.array(n_items), pa.array(digests, pa.string()), pa.array((n_hit > 0) & (20 * n_hit >= n_words))],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return run


def _document_windows(sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array(batch.column(0))
            for part in words(batch.column(1), LETTERS_DIGITS):
                hashes = part.hashes()
                owner = np.repeat(keys[part.first : part.last], np.diff(part.edges))
                place = np.arange(len(hashes)) - np.repeat(part.edges[:-1], np.diff(part.edges))
                for size in sizes:
                    own = window_hashes(hashes, size)
                    good = np.flatnonzero(inside_documents(part.edges, len(own), size))
                    texts = [part.text(i, i + size) for i in good.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(owner[good]), pa.array(np.full(len(good), size, np.int32)), pa.array(own[good].view(np.int64)), pa.array(texts, pa.binary()), pa.array(place[good])],
                        ["row", "size", "hash", "words", "place"],
                    )

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words = np.zeros(batch.num_rows, np.int64)
        for part in words(batch.column(2), LETTERS_DIGITS):
            n_words[part.first : part.last] = np.diff(part.edges)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words)], ["row", "doc_id", "n_words"])


def _joined(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """The same result by a shuffle join on window hashes, for a benchmark too large to broadcast; rows(row, doc_id, text) have fixed numbers."""
    counted = rows.mapInArrow(_count_words, "row long, doc_id long, n_words long")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())
    places = rows.select("row", "text").mapInArrow(_document_windows(sizes), "row long, size int, hash long, words binary, place long")
    hits = cut(places.join(windows, ["size", "hash", "words"]).select("row", "item_id", "place", "size"))
    before = Window.partitionBy("row").orderBy("place", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("row", "place", (F.col("place") + F.col("size")).alias("end")).distinct()
    fresh = spans.withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(0)))
    covered = fresh.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("place", "reach"))).alias("n_hit"))
    items = hits.select("row", "item_id").distinct().groupBy("row").agg(F.count("*").alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list(F.col("item_id").cast("string")))).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return (
        counted.join(covered, "row", "left")
        .join(items, "row", "left")
        .select(
            "row",
            "doc_id",
            "n_words",
            n_hit.alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).alias("n_items"),
            F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
            ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        )
    )


def _numbered(docs: DataFrame) -> DataFrame:
    """row, doc_id, text with numbers that a lost executor does not change."""
    return cut(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())).select("row", "doc_id", "text")


def _table(windows: DataFrame, most_windows: int, most_bytes: int) -> list[tuple] | None:
    """The windows for the driver to broadcast, None if they are too many or too long."""
    count, size = windows.agg(F.count("*"), F.coalesce(F.sum(F.length("words")), F.lit(0))).first()
    return [tuple(r) for r in windows.collect()] if count <= most_windows and size <= most_bytes else None


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = cut(benchmark_windows(benchmark, size))
    docs = id_and_text(docs)
    table = _table(windows, broadcast_windows, broadcast_bytes)
    if table is None:
        return _joined(_numbered(docs), windows).drop("row")
    return docs.mapInArrow(_scan(table), _HITS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Documents that are not contaminated, all columns kept whatever their names; each row is judged by its own text."""
    windows = cut(benchmark_windows(benchmark, size))
    table = _table(windows, broadcast_windows, broadcast_bytes)
    if table is None:
        text = F.col("text").cast("string")
        texts = _numbered(docs.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text")).where("text is not null").distinct())
        bad = _joined(texts, windows).where("contaminated").select("row")
        named, back = names_apart(docs)
        return back(named.join(texts.join(bad, "row", "left_semi").select(F.col("text").alias("_bad")), text == F.col("_bad"), "left_anti"))
    scan, at = _scan(table), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.nulls(batch.num_rows, pa.int64())
            judged = next(scan(iter([pa.RecordBatch.from_arrays([ids, batch.column(at)], ["doc_id", "text"])])))
            yield batch.filter(pc.invert(judged.column(5)))

    return docs.mapInArrow(run, docs.schema)

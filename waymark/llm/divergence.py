"""Audit of how a language's sources differ in their terms, by systolic rotation.

Occurrences are counted where the texts lie and summed by (lang, source, term);
a language keeps the terms of enough of its documents.  Kept terms are dealt into
slices of a bounded size and sources into blocks of a bounded number, so that a
cell (language, slice, block) is small however large the corpus is.  Cells stay
resident in their partitions.  In each round of a round-robin tournament half of
the blocks travel, as compressed vectors, to the seats of the others; a meeting
gives its pairs in both directions.  Sums over slices give the value of a pair.
Each cell keeps a heap of its sources' best terms, and the heaps are merged.

All arithmetic is on whole numbers.  A share is p = 1 + floor(SCALE * (count + 2) /
(N + 2 V)), the divergence of two shares is floor((p - q)^2 / (p + q)), which is
less than 2^30, so sums fit a long; quotients are taken of decimals.

Defined cases: null texts, languages and sources are empty strings; groups without
terms have shares of count 0, and without kept terms all values are 0; repeated
rows are documents of their own; ties go to the smaller item in the order of UTF-8;
texts of any length are read whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .kernels import LOWER, PIECE_BYTES, text_buffers

#: Fixed values of the contract: the documents that keep a term, the terms listed for a group, the scale of shares.
LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Sources of a block, kept terms of a slice.
BLOCK, SLICE = 8, 1 << 13
#: Parts into which a language's (or a group's) terms are dealt where they meet its totals.
SALTS = 64

#: Bytes of terms, lower-cased; all others become spaces.
_SPACED = np.full(256, 32, np.uint8)
_SPACED[97:123] = np.arange(97, 123)
_SPACED[65:91] = LOWER[65:91]
_SPACED[128:] = np.arange(128, 256)

_COUNTS = "lang string, source string, term string, n long, docs long"


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    encoded = column.fill_null("").dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, for a piece of texts; an empty term stands for the group itself."""
    for batch in batches:
        lang, langs = _codes(batch.column(0))
        source, sources = _codes(batch.column(1))
        group = lang * max(1, len(sources)) + source
        at, data = text_buffers(batch.column(2))
        first, rows = 0, batch.num_rows
        while first < rows:
            last = min(rows, max(first + 1, int(np.searchsorted(at, at[first] + PIECE_BYTES, "right")) - 1))
            spaced = _SPACED[data[at[first] : at[last]]]
            offsets = at[first : last + 1] - at[first]
            texts = pa.LargeStringArray.from_buffers(last - first, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(spaced))
            lists = pc.ascii_split_whitespace(texts)
            doc = np.repeat(np.arange(last - first), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            terms = lists.flatten().dictionary_encode()
            term, names = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), terms.dictionary
            real = pc.not_equal(names, "").to_numpy(zero_copy_only=False)[term] if len(term) else np.zeros(0, bool)
            doc, term = doc[real], term[real]
            of, many = group[first:last], max(1, len(names))
            pairs, n = np.unique(of[doc] * many + term, return_counts=True)
            once = np.unique(doc * many + term)
            _, docs = np.unique(of[once // many] * many + once % many, return_counts=True)
            groups = np.unique(of)
            g = np.concatenate((pairs // many, groups))
            zero = np.zeros(len(groups), np.int64)
            columns = (
                langs.take(pa.array(g // max(1, len(sources)))), sources.take(pa.array(g % max(1, len(sources)))),
                pa.concat_arrays([names.take(pa.array(pairs % many)).cast(pa.string()), pa.array([""] * len(groups), pa.string())]), pa.array(np.concatenate((n, zero))), pa.array(np.concatenate((docs, zero))),
            )
            yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if k < 3 else c for k, c in enumerate(columns)], ["lang", "source", "term", "n", "docs"])
            first = last


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); the empty term stands for each group."""
    rows = docs.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    found = rows.mapInArrow(_count, _COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count, total, terms):
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)) on decimals, as a long."""
    wide = [f"cast({x} as decimal(19, 0))" for x in (count, total, terms)]
    return F.expr(f"1 + (({wide[0]} + 2) * {SCALE}) div nullif({wide[1]} + 2 * {wide[2]}, 0)").cast("long")


def _pack(ids: np.ndarray, shares: np.ndarray) -> bytes:
    """Ids in order as differences, and their shares."""
    return zlib.compress(np.diff(ids, prepend=0).astype("<u4").tobytes() + shares.astype("<u4").tobytes(), 1)


def _unpack(packed: bytes | None, rest: int, terms: int) -> np.ndarray:
    """The shares of a slice's terms; those that the vector does not hold have the share of count 0."""
    out = np.full(terms, rest, np.int64)
    if packed:
        raw = np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64)
        out[np.cumsum(raw[: len(raw) // 2])] = raw[len(raw) // 2 :]
    return out


def _met(terms: DataFrame, totals: DataFrame, key: list[str]) -> DataFrame:
    """terms with the totals of their language or group, which may own a third of all terms."""
    salted = terms.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)))
    return salted.join(totals.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [*key, "salt"]).drop("salt")


_CELL = "lang string, slice int, block int, source string, vector binary, item string, value long"


def _cell(top: int):
    def run(table: pa.Table) -> pa.Table:
        """A cell's vectors by source, and its heap of each source's best terms."""
        source, names = _codes(table.column("source").combine_chunks())
        ids, share, value = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("id", "p", "value"))
        leads = table.column("leads").combine_chunks().to_numpy(zero_copy_only=False)
        term = table.column("term").combine_chunks()
        out = []
        for k, name in enumerate(names.to_pylist()):
            own = np.flatnonzero(source == k)
            own = own[np.argsort(ids[own])]
            out.append((name, _pack(ids[own], share[own]), None, None))
            own = own[leads[own]]
            if len(own) > top:  # all that tie with the last one stay for the heap
                own = own[value[own] >= np.partition(value[own], -top)[-top]]
            best = heapq.nsmallest(top, ((-int(value[i]), term[int(i)].as_py()) for i in own))
            out += [(name, None, item, -v) for v, item in best]
        lang, part, block = (table.column(c)[0].as_py() for c in ("lang", "slice", "block"))
        kinds = (pa.string(), pa.binary(), pa.string(), pa.int64())
        columns = [pa.array([r[i] for r in out], kinds[i]) for i in range(4)]
        fixed = [pa.array([v] * len(out), kind) for v, kind in ((lang, pa.string()), (part, pa.int32()), (block, pa.int32()))]
        return pa.Table.from_arrays(fixed + columns, ["lang", "slice", "block", "source", "vector", "item", "value"])

    return run


_PAIRS = "lang string, source string, item string, value long"


def _read(table: pa.Table) -> list[tuple[str, np.ndarray]]:
    rows = table.select(["source", "vector", "rest", "terms"]).to_pylist()
    return [(r["source"], _unpack(r["vector"], r["rest"] or 0, r["terms"])) for r in rows]


def _told(lang: str, pairs: list[tuple[str, str, int]]) -> pa.Table:
    both = [(a, b, v) for a, b, v in pairs] + [(b, a, v) for a, b, v in pairs]
    columns = [pa.array([lang] * len(both), pa.string()), *(pa.array([r[i] for r in both], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64())))]
    return pa.Table.from_arrays(columns, ["lang", "source", "item", "value"])


def _apart(a: np.ndarray, b: np.ndarray) -> int:
    return int(((a - b) ** 2 // np.maximum(a + b, 1)).sum())


def _inside(table: pa.Table) -> pa.Table:
    """The pairs within a block."""
    rows = _read(table)
    return _told(table.column("lang")[0].as_py(), [(a, b, _apart(x, y)) for i, (a, x) in enumerate(rows) for b, y in rows[i + 1 :]])


def _meeting(resident: pa.Table, visiting: pa.Table) -> pa.Table:
    """The pairs of a resident block and the one that visits it."""
    if not resident.num_rows or not visiting.num_rows:
        return _told("", [])
    here, come = _read(resident), _read(visiting)
    return _told(resident.column("lang")[0].as_py(), [(a, b, _apart(x, y)) for a, x in here for b, y in come])


def meets(block, turn: int, seats: int):
    """Whom a block meets in a round of a tournament of an even number of seats, by the circle method.

    Expression or number; rounds are 0 .. seats - 2 and every two blocks meet once.
    """
    around = (2 * turn - block) % (seats - 1)
    if isinstance(block, int):
        return turn if block == seats - 1 else seats - 1 if block == turn else around
    return F.when(block == seats - 1, turn).when(block == turn, seats - 1).otherwise(F.pmod(2 * turn - block, F.lit(seats - 1)))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, slice_terms: int = SLICE) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language (pair) and the terms that a source has more of (term)."""
    spark = docs.sparkSession
    # what a language keeps is known where its counts of a term meet, so that the many rare terms are written nowhere
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumns({"m": F.sum("n").over(of_term), "in_docs": F.sum("docs").over(of_term)})
    counts = cut(counts.where((F.col("term") == "") | (F.col("in_docs") >= least_docs)).select("lang", "source", "term", "n", "m"))
    kept = cut(counts.where("term <> ''").select("lang", "term", "m").distinct())
    langs = cut(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("m").alias("total")))
    # terms in slices, numbered within each; a slice has about slice_terms of them
    slices = F.ceil(F.col("v") / slice_terms).cast("int")
    dealt = _met(kept, langs, ["lang"]).withColumn("slice", F.pmod(F.xxhash64("term"), slices).cast("int")).withColumn("q", _share("m", "total", "v"))
    numbered = cut(dealt.select("lang", "term", "slice", "q", (F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1).alias("id")))
    occurs = cut(counts.where("term <> ''").select("lang", "source", "term", "n").join(numbered, ["lang", "term"]))
    # the groups with their totals; a language's sources in blocks
    totals = occurs.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = counts.where("term = ''").select("lang", "source", F.floor(nth / block).cast("int").alias("block"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left").fillna(0, ["total", "v"])
    groups = cut(groups.withColumn("rest", _share("0", "total", "v")))
    shares = _met(occurs, groups.select("lang", "source", "block", "total", "v"), ["lang", "source"]).withColumn("p", _share("n", "total", "v"))
    apart = F.expr("(p - q) * (p - q) div (p + q)")
    cells = shares.select("lang", "slice", "block", "source", "id", "term", "p", (F.col("p") > F.col("q")).alias("leads"), apart.alias("value"))
    built = cut(cells.groupBy("lang", "slice", "block").applyInArrow(_cell(top), _CELL))
    # every group has a vector in every slice of its language, if only that of count 0
    sizes = numbered.groupBy("lang", "slice").agg(F.count("*").cast("int").alias("terms"))
    grid = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("v") / slice_terms)).cast("int") - 1)))
    vectors = built.where("vector is not null").select("lang", "slice", "source", "vector")
    seats = cut(grid.join(vectors, ["lang", "slice", "source"], "left").join(sizes, ["lang", "slice"], "left").fillna(0, ["terms"]).select("lang", "slice", "block", "source", "rest", "terms", "vector"))
    blocks = seats.agg(F.max("block")).first()[0]
    found = []
    if blocks is not None:
        resident = seats.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "lang", "slice", "block").persist()
        found.append(cut(resident.groupBy("lang", "slice", "block").applyInArrow(_inside, _PAIRS)))
        even = blocks + 1 + (blocks + 1) % 2
        for turn in range(even - 1 if blocks else 0):
            to = meets(F.col("block"), turn, even)
            stays = resident.where(F.col("block") < to).groupBy("lang", "slice", "block")
            travels = resident.where(F.col("block") > to).withColumn("seat", to.cast("int")).groupBy("lang", "slice", "seat")
            found.append(cut(stays.cogroup(travels).applyInArrow(_meeting, _PAIRS)))
        resident.unpersist()
    ranked = built.where("item is not null").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    for pairs in found[:1]:
        for more in found[1:]:
            pairs = pairs.unionByName(more)
        summed = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        ranked = ranked.unionByName(summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return ranked.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))

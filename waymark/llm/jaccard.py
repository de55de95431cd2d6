"""Size-aware n-gram Jaccard join with heavy and light sets.

A document's set holds its distinct word shingles.  Documents with one set are
one class, and classes are joined.  Two classes link when their Jaccard
similarity reaches the threshold; every candidate is verified on whole sets.

Elements have one global order, rare before common, so two linked sets share
an element among their first few, and two elements among one more.  Small sets
enumerate the pairs (subsets of two) of those first elements that other sets
share, which are far rarer than single elements; large sets scan the inverted
lists of their single elements.  The boundary is the size up to which
enumerating costs less than scanning: subset rows against the pairs that meet
in inverted lists, counted over all classes of every size.

A group of near copies is not expanded into its pairs.  First each inverted
list links its members to its most central member; the exact round then looks
only at pairs that lie in different components.  A pair within a component
cannot change the components, so the result is the one of all pairs.

Rarity comes from a table of counters over all shingles: its size is fixed, any
counts give a valid order, and only speed depends on it.  Shingles are 64-bit
hashes of their words, classes 128-bit sums of these; prefix elements keep 56
bits, and what they let through is verified on whole sets.

Defined cases: null, empty and blank texts have an empty set and link with
nothing; a text of fewer words is one shingle; repeated rows and ids are
judged by their text; a null id never becomes a component id unless the
component has no other; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, names_apart
from .components import connected_components
from .kernels import NOT_SPACE, mix, window_hashes, words

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
#: Counters of the rarity table: 2 MB once it is quantised.
COUNTERS = 1 << 21
_CHUNK = 1 << 14
#: What a subset row costs, in pairs that meet in an inverted list: it is written, shuffled and grouped, and
#: most pairs of a list are settled by its centre.  Measured, not exact; any price gives the same result.
SUBSET_PRICE = 64.0
#: Class keys that are broadcast to pick the sets to verify (16 bytes each); more are joined by a shuffle.
BROADCAST_CLASSES = 1_000_000

_ROWS = "doc_id long, d1 long, d2 long, n long, chunk int, counts binary"
_PREFIX = "d1 long, d2 long, n long, keys array<long>"


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for part in words(column, NOT_SPACE):
        hashes = part.hashes()
        windows = window_hashes(hashes, size)
        for a, b in zip(part.edges[:-1].tolist(), part.edges[1:].tolist(), strict=True):
            yield np.unique(windows[a : b - size + 1]) if b - a >= size else window_hashes(hashes[a:b], b - a) if b > a else hashes[:0]


def digest(elements: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set."""
    first = mix(elements ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    second = mix(elements * np.uint64(0xDA942042E4DD58B5) + np.uint64(1)).sum(dtype=np.uint64)
    return int(first.astype(np.int64)), int(second.astype(np.int64))


def _counters(elements: np.ndarray, counters: int) -> np.ndarray:
    return (elements & np.uint64(counters - 1)).astype(np.int64)


def _rows_and_counts(size: int, counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(counters, np.uint32)
        for batch in batches:
            d1, d2, n = [], [], []
            for elements in shingle_sets(batch.column(1), size):
                np.add.at(seen, _counters(elements, counters), 1)
                one, two = digest(elements)
                d1.append(one)
                d2.append(two)
                n.append(len(elements))
            none = [None] * len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(n, pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], _ROWS_NAMES)
        for k in range(0, counters, _CHUNK):
            if seen[k : k + _CHUNK].any():
                none = pa.nulls(1, pa.int64())
                packed = zlib.compress(np.minimum(seen[k : k + _CHUNK], 65535).astype(np.uint16).tobytes(), 1)
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([k // _CHUNK], pa.int32()), pa.array([packed], pa.binary())], _ROWS_NAMES)

    return run


_ROWS_NAMES = [x.split()[0] for x in _ROWS.split(", ")]


def _sum_counts(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_CHUNK, np.uint64)
    for batch in batches:
        for packed in batch.column(batch.schema.get_field_index("counts")).to_pylist():
            total += np.frombuffer(zlib.decompress(packed), np.uint16)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.log2(1 + total).astype(np.uint8).tobytes()], pa.binary())], ["chunk", "counts"])


def _prefix_size(n: int, threshold: Fraction, shared: int) -> int:
    """Elements of a set of n of which any linked set holds ``shared``."""
    return min(n, n - -(-n * threshold.numerator // threshold.denominator) + shared)


def _ordered(elements: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Elements as numbers in their global order: by rarity level, then by hash."""
    level = rarity[_counters(elements, len(rarity))].astype(np.uint64)
    return np.sort((level << np.uint64(56)) | (elements >> np.uint64(8))).view(np.int64)


def _prefixes(size: int, threshold: Fraction, rarity: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for elements in shingle_sets(batch.column(0), size):
                n = len(elements)
                if n:
                    keep = _prefix_size(n, threshold, 2)
                    for column, value in zip(out, (*digest(elements), n, _ordered(elements, rarity)[:keep]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.list_(pa.int64()))], ["d1", "d2", "n", "keys"])

    return run


def _wanted_sets(size: int, wanted: np.ndarray | None):
    """Sets of the texts whose class is wanted, each once in a task where ``wanted`` (sorted d1) is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for elements in shingle_sets(batch.column(0), size):
                name = digest(elements)
                if wanted is not None:
                    at = int(np.searchsorted(wanted, name[0]))
                    if at == len(wanted) or wanted[at] != name[0] or name in done:
                        continue
                    done.add(name)
                if len(elements):
                    for column, value in zip(out, (*name, elements.view(np.int64)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], ["d1", "d2", "elements"])

    return run


def _plausible(threshold: Fraction):
    """Pairs whose prefixes leave room for the overlap that a link needs."""
    up, down = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            n_left, n_right, left, right = (batch.column(k) for k in range(6, 10))
            for i in range(batch.num_rows):
                a, b = np.asarray(left[i].values), np.asarray(right[i].values)
                # up to the nearer end all common elements are in both prefixes
                reach = min(a[-1], b[-1])
                a, b = a[: np.searchsorted(a, reach, "right")], b[: np.searchsorted(b, reach, "right")]
                n, m = n_left[i].as_py(), n_right[i].as_py()
                most = len(np.intersect1d(a, b)) + min(n - len(a), m - len(b))
                good.append((up + down) * most >= up * (n + m))
            yield batch.select(range(6)).filter(pa.array(good, pa.bool_()))

    return run


def _similar(threshold: Fraction):
    up, down = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                a, b = np.asarray(left[i].values), np.asarray(right[i].values)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(down * both >= up * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


class JaccardJoin:
    """The join of one document table; ``components`` is its result."""

    def __init__(self, docs: DataFrame, size: int = SHINGLE, threshold: Fraction = THRESHOLD, counters: int = COUNTERS, broadcast_classes: int = BROADCAST_CLASSES, subset_price: float = SUBSET_PRICE):
        self.docs, self.size, self.threshold = id_and_text(docs), size, threshold
        self.counters, self.broadcast_classes, self.subset_price = counters, broadcast_classes, subset_price
        self.boundary: int | None = None  # the largest small set, once it is chosen

    def _classes(self, counts: DataFrame) -> DataFrame:
        """cid, d1, d2, n, keys of each distinct non-empty set."""
        rarity = np.zeros(self.counters, np.uint8)
        summed = counts.groupBy("chunk").applyInArrow(_sum_counts, "chunk int, counts binary")
        for chunk, levels in summed.collect():  # a byte for each counter, whatever the input
            rarity[chunk * _CHUNK : chunk * _CHUNK + _CHUNK] = np.frombuffer(levels, np.uint8)
        prefixes = self.docs.select("text").mapInArrow(_prefixes(self.size, self.threshold, rarity), _PREFIX)
        classes = cut(prefixes.groupBy("d1", "d2").agg(F.first("n").alias("n"), F.first("keys").alias("keys")))
        return classes.withColumn("cid", F.monotonically_increasing_id())

    def _prefix_column(self, shared: int):
        up, down = self.threshold.numerator, self.threshold.denominator
        return F.least(F.col("n"), F.col("n") - F.expr(f"(n * {up} + {down - 1}) div {down}") + shared).cast("int")

    def _boundary(self, shared: DataFrame) -> int:
        """The size up to which subsets cost less than lists, from (cid, n, pos, members, single) of shared elements.

        Sizes beyond 256 are taken together in steps of a sixteenth of their logarithm, so the driver gets few rows.
        """
        step = F.when(F.col("n") <= 256, F.col("n")).otherwise(F.ceil(F.exp(F.ceil(F.log2("n") * 16) / 16 * F.log(F.lit(2.0)))))
        each = shared.groupBy("cid", "n").agg(F.count("*").alias("k"), F.sum(F.when(F.col("single"), F.col("members") - 1).otherwise(0)).alias("met"))
        by_size = each.groupBy(step.cast("long").alias("step")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("subsets"), F.sum(F.col("met") / 2).alias("pairs"))
        best, boundary, saved = 0.0, 0, 0.0
        for step, subsets, pairs in sorted(map(tuple, by_size.collect())):
            saved += pairs - self.subset_price * subsets
            if saved >= best:
                best, boundary = saved, step
        return boundary

    def _postings(self, classes: DataFrame) -> DataFrame:
        """key, cid, n, pos, small, subset: members of the inverted lists that have several members."""
        firsts = classes.select("cid", "n", F.posexplode("keys").alias("pos", "key")).withColumn("single", F.col("pos") < self._prefix_column(1))
        lists = firsts.groupBy("key").agg(F.count("*").alias("all"), F.count(F.when(F.col("single"), 1)).alias("members")).where("all > 1")
        shared = cut(firsts.join(lists.drop("all"), "key"))
        self.boundary = boundary = self._boundary(shared)

        # a small set still scans for large ones that it may link with
        bridge = int((boundary + 1) * self.threshold)
        singles = shared.where("single and members > 1").where(F.col("n") >= bridge).select("key", "cid", "n", "pos", (F.col("n") <= boundary).alias("small"), F.lit(False).alias("subset"))
        if not boundary:
            return singles
        # a set's first elements are few, a fifth of it and one; of the first two that a link shares the second is at most one further
        keys = shared.where(F.col("n") <= boundary).groupBy("cid", "n").agg(F.array_sort(F.collect_set(F.struct("pos", "key"))).alias("k"))
        each = keys.select("cid", "n", F.expr("explode(flatten(transform(k, (x, i) -> transform(slice(k, i + 2, size(k)), y -> struct(xxhash64(x.key, y.key) as key, y.pos - 1 as pos)))))").alias("p"))
        pairs = each.groupBy("cid", "n", F.col("p.key").alias("key")).agg(F.min("p.pos").alias("pos"))
        repeated = pairs.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
        subsets = cut(pairs.join(repeated, "key", "left_semi").select("key", "cid", "n", "pos", F.lit(True).alias("small"), F.lit(True).alias("subset")))
        return singles.unionByName(subsets)

    def _may_link(self, a: str, b: str):
        """Size and position bounds of a pair, and the route by which the pair is looked for."""
        up, down = self.threshold.numerator, self.threshold.denominator
        sizes = f"{down} * least({a}.n, {b}.n) >= {up} * greatest({a}.n, {b}.n)"
        need = f"(({up} * ({a}.n + {b}.n) + {up + down - 1}) div {up + down})"
        places = f"({a}.pos <= {a}.n - {need} and {b}.pos <= {b}.n - {need})"
        return F.expr(f"{a}.subset = {b}.subset and ({a}.subset or not ({a}.small and {b}.small)) and {sizes} and {places}")

    def _verified(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """The pairs (a, b) of class ids whose sets are similar enough.

        A bound from the prefixes comes first.  Sets travel once by the name of their class; a's set then goes to b,
        so that a class in very many pairs as a is read by no task more than once.
        """
        pairs = cut(pairs)
        ids = cut(pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct())
        few = F.broadcast(ids) if ids.count() <= self.broadcast_classes else ids
        heads = cut(classes.select("cid", "d1", "d2", "n", "keys").join(few, "cid"))
        ends = [heads.select(*(F.col(c).alias(f"{side}_{c}") for c in heads.columns)) for side in "ab"]
        met = pairs.join(ends[0], F.col("a") == F.col("a_cid")).join(ends[1], F.col("b") == F.col("b_cid"))
        met = met.select("a", "b", F.col("a_d1").alias("a1"), F.col("a_d2").alias("a2"), F.col("b_d1").alias("b1"), F.col("b_d2").alias("b2"), "a_n", "b_n", "a_keys", "b_keys")
        named = cut(met.mapInArrow(_plausible(self.threshold), "a long, b long, a1 long, a2 long, b1 long, b2 long"))

        names = cut(named.select(F.col("a1").alias("d1"), F.col("a2").alias("d2")).unionByName(named.select(F.col("b1").alias("d1"), F.col("b2").alias("d2"))).distinct())
        texts = self.docs.select("text")
        if names.count() <= self.broadcast_classes:
            wanted = np.unique(np.array([r["d1"] for r in names.select("d1").collect()], np.int64))
            found = texts.mapInArrow(_wanted_sets(self.size, wanted), "d1 long, d2 long, elements array<long>")
        else:
            found = texts.mapInArrow(_wanted_sets(self.size, None), "d1 long, d2 long, elements array<long>").join(names, ["d1", "d2"], "left_semi")
        sets = found.groupBy("d1", "d2").agg(F.first("elements").alias("elements"))
        left = named.join(sets.select(F.col("d1").alias("a1"), F.col("d2").alias("a2"), F.col("elements").alias("left")), ["a1", "a2"]).drop("a1", "a2")
        full = left.join(sets.select(F.col("d1").alias("b1"), F.col("d2").alias("b2"), F.col("elements").alias("right")), ["b1", "b2"])
        return cut(full.select("a", "b", "left", "right").mapInArrow(_similar(self.threshold), "a long, b long"))

    def _labelled(self, postings: DataFrame, links: DataFrame) -> DataFrame:
        found = connected_components(links)
        named = postings.join(found.withColumnRenamed("node", "cid"), "cid", "left")
        return named.withColumn("component", F.coalesce("component", "cid"))

    def links(self, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Classes, and verified links that connect every component of the similarity graph."""
        classes = self._classes(counts)
        postings = self._postings(classes)
        # the member whose shared element comes first has the fewest elements of its own
        centre = postings.groupBy("key", "subset", "small").agg(F.min(F.struct("pos", "n", "cid")).alias("c"))
        centre = centre.select("key", "subset", "small", "c.*").alias("x")
        y = postings.alias("y")
        near = centre.join(y, F.expr("x.key = y.key and x.cid <> y.cid") & self._may_link("x", "y"))
        stars = near.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
        links = self._verified(stars, classes)

        labelled = self._labelled(postings, links)
        several = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        labelled = cut(labelled.join(several, "key", "left_semi"))
        groups = labelled.groupBy("key", "subset", "small", "component").agg(F.min("pos").alias("pos"), F.min("n").alias("least_n"), F.max("n").alias("most_n"))
        # a member is held against another component's best case before it meets that component's members
        up, down = self.threshold.numerator, self.threshold.denominator
        x, g = labelled.alias("x"), groups.alias("g")
        best = f"{down} * g.most_n >= {up} * x.n and {down} * x.n >= {up} * g.least_n"
        need = f"(({up} * (x.n + greatest(g.least_n, ({up} * x.n) div {down})) + {up + down - 1}) div {up + down})"
        fits = f"x.key = g.key and x.subset = g.subset and x.component < g.component and (x.subset or not (x.small and g.small)) and {best} and x.pos <= x.n - {need} and g.pos <= g.most_n - {need}"
        across = x.join(g, F.expr(fits)).select("x.*", F.col("g.component").alias("other"), F.col("g.small").alias("other_small"))
        x, y = across.alias("x"), labelled.alias("y")
        met = x.join(y, F.expr("x.key = y.key and x.other = y.component and x.other_small = y.small") & self._may_link("x", "y"))
        rest = met.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()
        return classes, links.unionByName(self._verified(rest, classes))

    def _rows(self) -> tuple[DataFrame, DataFrame]:
        """doc_id, d1, d2, n of every document, and the counters' parts."""
        first = cut(self.docs.mapInArrow(_rows_and_counts(self.size, self.counters), _ROWS))
        return first.where("chunk is null").select("doc_id", "d1", "d2", "n"), first.where("chunk is not null").select("chunk", "counts")

    def judged(self) -> tuple[DataFrame, DataFrame]:
        """Every document as doc_id, d1, d2, n, and of each linked class d1, d2, component, component_id."""
        rows, counts = self._rows()
        classes, links = self.links(counts)
        linked = connected_components(links).withColumnRenamed("node", "cid")
        named = classes.select("cid", "d1", "d2").join(linked, "cid")
        least = rows.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("least"))
        joined = cut(named.join(least, ["d1", "d2"]))
        over = joined.groupBy("component").agg(F.min("least").alias("component_id"))
        known = least.join(joined.select("d1", "d2", "component"), ["d1", "d2"], "left").join(over, "component", "left")
        return rows, known.select("d1", "d2", "component", F.coalesce("component_id", "least").alias("component_id"))

    def components(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every document."""
        rows, known = self.judged()
        names = known.select("d1", "d2", "component_id")
        full = rows.where("n > 0").join(names, ["d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        return full.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))

    def all_links(self) -> tuple[DataFrame, DataFrame]:
        """Every link, exact: members (doc_id, cid, n_links), a row for each document, and the pairs (a < b) of linked classes.

        Documents link when they are of one class or of two linked ones; a document without words has no class and no
        link.  All members of an inverted list meet, so time grows with the number of pairs of near copies.
        """
        rows, counts = self._rows()
        classes = self._classes(counts)
        postings = cut(self._postings(classes))
        x, y = postings.alias("x"), postings.alias("y")
        met = x.join(y, F.expr("x.key = y.key and x.cid < y.cid") & self._may_link("x", "y"))
        pairs = self._verified(met.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct(), classes)
        named = cut(rows.where("n > 0").join(classes.select("cid", "d1", "d2"), ["d1", "d2"]).select("doc_id", "cid"))
        sizes = cut(named.groupBy("cid").agg(F.count("*").alias("size")))
        ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        others = ends.join(sizes.withColumnRenamed("cid", "b"), "b").groupBy(F.col("a").alias("cid")).agg(F.sum("size").alias("others"))
        n_links = sizes.join(others, "cid", "left").select("cid", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        members = named.join(n_links, "cid").select("doc_id", "cid", "n_links")
        alone = rows.where("n = 0").select("doc_id", F.lit(None).cast("long").alias("cid"), F.lit(0).cast("long").alias("n_links"))
        return members.unionByName(alone), pairs


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id that a document reaches by links."""
    return JaccardJoin(docs, **options).components()


def _digests(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [(*digest(elements), len(elements)) for elements in shingle_sets(batch.column(2), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[k] for x in names], pa.int64()) for k in range(3))], ["h1", "h2", "d1", "d2", "n"])

    return run


def keep_one_of_each(docs: DataFrame, broadcast_ids: int = 2_000_000, **options) -> DataFrame:
    """docs, all columns, with one row of each group of linked documents and every document that links with nothing.

    The row with the smallest id stays, a null id last; of several such rows the one whose set has the smallest name,
    and any one of rows with one id and set.  Rows are judged by id and set, so different texts may share an id.
    Other columns may have any names.
    """
    docs, back = names_apart(docs)
    join = JaccardJoin(docs, **options)
    rows, known = join.judged()
    sets = cut(rows.where("n > 0").groupBy("doc_id", "d1", "d2").agg(F.count("*").alias("rows")).join(known, ["d1", "d2"]))
    # a set without a link is a group of its own
    group = [F.col("component"), F.when(F.col("component").isNull(), F.col("d1")).alias("g1"), F.when(F.col("component").isNull(), F.col("d2")).alias("g2")]
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "d1", "d2")
    best = sets.groupBy(*group).agg(F.min(first).alias("best")).select("best.doc_id", "best.d1", "best.d2")
    stay = cut(best)

    # an id with one row and one set decides for its row; the rows of other ids are looked at one by one
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("n").alias("n"))
    several = cut(ids.where("rows > 1 or doc_id is null").select(F.col("doc_id").alias("_id")))
    gone = cut(ids.where("rows = 1 and n > 0 and doc_id is not null").select("doc_id").join(stay.select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("_id")))
    few = lambda names: F.broadcast(names) if names.count() <= broadcast_ids else names
    number = F.col("doc_id").cast("long")
    single = docs.join(few(gone.unionByName(several.where("_id is not null"))), number == F.col("_id"), "left_anti").where(number.isNotNull())
    if several.isEmpty():
        return back(single)
    text = F.col("text").cast("string")
    looked = docs.join(few(several), number.eqNullSafe(F.col("_id")), "left_semi").withColumns({"_h1": F.xxhash64(text), "_h2": F.xxhash64(text, F.lit(1))})
    texts = looked.select(F.col("_h1").alias("h1"), F.col("_h2").alias("h2"), text.alias("text")).dropDuplicates(["h1", "h2"])
    named = cut(texts.mapInArrow(_digests(join.size), "h1 long, h2 long, d1 long, d2 long, n long"))
    named = named.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), F.col("n").alias("_n"))
    looked = looked.join(named, ["_h1", "_h2"])
    wins = stay.select(F.col("doc_id").alias("_id"), F.col("d1").alias("_s1"), F.col("d2").alias("_s2"))
    full = looked.where("_n > 0").join(wins, number.eqNullSafe(F.col("_id")) & (F.col("_d1") == F.col("_s1")) & (F.col("_d2") == F.col("_s2")), "left_semi")
    full = full.withColumn("_long", number).dropDuplicates(["_long", "_d1", "_d2"])
    return back(single.unionByName(full.select(docs.columns)).unionByName(looked.where("_n = 0").select(docs.columns)))

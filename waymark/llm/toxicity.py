"""Counterfactual-regularised toxicity classifier.

A logistic regression over words and word beginnings of labelled documents.
Every labelled sentence with an identity term also counts with the term
swapped for each other term of its kind; every labelled document also counts
with a term put in and with that term swapped.  The squared changes of the
score (before the sigmoid) are added to the loss, so that naming a group does
not make a text toxic.  The words of a sentence around a term stand on both
sides of a swap, so they need no template of their own.

Features are chosen by their document counts under either label, over all
labelled documents of the sample; the sample is the ``SAMPLE`` labelled
documents that come first by a hash of their ids.  Identity terms always are
features, so the penalty can work on them.  Equal swaps of all documents are
counted together before they leave the executors.

Defined cases: a null text is empty and is scored as the intercept alone;
documents with a null or contradictory label are not learned from, documents
that repeat an id are each learned from; without both labels every score is
the share of toxic ones (0 with none at all); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, id_and_text
from .kernels import LETTERS_DIGITS, Words, mix, powers, words

#: Most labelled documents that are learned from, and most features.
SAMPLE = 40_000
FEATURES = 4096
#: Least documents that hold a feature, and least absolute log odds of the labels given it.
LEAST_DOCS = 6
LEAST_ODDS = 2.0
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.7
PENALTY = 10.0
RIDGE = 1e-5
FOLDS = 3
HELD_OUT = 1

# Identity terms by kind, English, German, French and Spanish.
IDENTITY = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "transgender", "queer"),
    ("immigrants", "refugees", "natives", "foreigners", "citizens"),
    ("deaf", "blind", "disabled", "elderly", "young", "old"),
    ("frauen", "männer", "mädchen", "jungen", "mütter", "väter"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    ("muslimische", "christliche", "jüdische", "hinduistische", "buddhistische", "katholische"),
    ("schwarze", "weiße", "asiatische", "afrikanische", "europäische", "arabische"),
    ("schwule", "lesbische", "bisexuelle", "heterosexuelle", "queere"),
    ("einwanderer", "flüchtlinge", "einheimische", "ausländer", "bürger"),
    ("gehörlose", "blinde", "behinderte", "junge", "alte"),
    ("femmes", "hommes", "filles", "garçons", "mères", "pères"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("noirs", "blancs", "asiatiques", "africains", "européens", "arabes"),
    ("gays", "lesbiennes", "bisexuels", "hétérosexuels", "transgenres"),
    ("immigrés", "réfugiés", "autochtones", "étrangers", "citoyens"),
    ("sourds", "aveugles", "handicapés", "jeunes", "vieux"),
    ("mujeres", "hombres", "chicas", "chicos", "madres", "padres"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos", "árabes"),
    ("gais", "lesbianas", "bisexuales", "heterosexuales", "transexuales"),
    ("inmigrantes", "refugiados", "nativos", "extranjeros", "ciudadanos"),
    ("sordos", "ciegos", "discapacitados", "jóvenes", "ancianos"),
)

_FEATURES = "label int, feature long"


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray, salt: int) -> np.ndarray:
    _, down = powers(len(data) + 1)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) + np.uint64(salt << 32))


def features(part: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature hash and document number of each word and word beginning of a piece."""
    up, _ = powers(len(part.data) + 1)
    sums = np.zeros(len(part.data) + 1, np.uint64)
    np.cumsum(part.data.astype(np.uint64) * up[:-1], out=sums[1:])
    owner = np.repeat(np.arange(part.last - part.first), np.diff(part.edges))
    hashes, owners = [_hash(part.data, part.start, part.end, sums, 0)], [owner]
    for n in BEGINNINGS:
        long = part.end - part.start > n
        hashes.append(_hash(part.data, part.start[long], part.start[long] + n, sums, 1))
        owners.append(owner[long])
    return np.concatenate(hashes), np.concatenate(owners)


def term_features(term: str) -> np.ndarray:
    """The features of one word."""
    part = next(words(pa.array([term]), LETTERS_DIGITS))
    return np.unique(features(part)[0])


class Terms:
    """Identity terms by the hash of their word, their features, and the terms each is swapped for."""

    def __init__(self, kinds=IDENTITY):
        self.own: list[set[int]] = []
        self.others: list[list[int]] = []
        number: dict[int, int] = {}
        for kind in kinds:
            members = range(len(self.own), len(self.own) + len(kind))
            for term, k in zip(kind, members, strict=True):
                self.own.append(set(term_features(term).tolist()))
                self.others.append([m for m in members if m != k])
                part = next(words(pa.array([term]), LETTERS_DIGITS))
                number.setdefault(int(features(part)[0][0]), k)
        self.words = np.array(sorted(number), np.uint64)
        self.numbers = np.array([number[int(h)] for h in self.words])
        self.features = np.array(sorted({f for own in self.own for f in own}), np.uint64)

    def counts(self, hashes: np.ndarray, owner: np.ndarray, documents: int) -> list[dict[int, int]]:
        """How often each document has each feature that a term has."""
        at = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
        hit = np.flatnonzero(self.features[at] == hashes)
        out: list[dict[int, int]] = [{} for _ in range(documents)]
        pairs, n = np.unique(owner[hit].astype(np.int64) * len(self.features) + at[hit], return_counts=True)
        for pair, count in zip(pairs.tolist(), n.tolist(), strict=True):
            out[pair // len(self.features)][int(self.features[pair % len(self.features)])] = count
        return out

    def pick(self, seed: int) -> tuple[int, int]:
        """A term and one that it is swapped for."""
        a = seed % len(self.own)
        return a, self.others[a][seed // len(self.own) % len(self.others[a])]


def swaps(part: Words, terms: Terms) -> Iterator[tuple[int, list[int], list[int]]]:
    """(document, features lost, features gained) of each counterfactual; what other words also give is not lost."""
    hashes, owner = features(part)
    n = len(part.start)
    documents = part.last - part.first
    counts = terms.counts(hashes, owner, documents)
    at = np.minimum(np.searchsorted(terms.words, hashes[:n]), len(terms.words) - 1)
    named = np.flatnonzero(terms.words[at] == hashes[:n])
    ends = np.cumsum(np.isin(part.data, np.frombuffer(b".!?\n", np.uint8)))
    said: dict[tuple[int, int, int], int] = {}
    for i in named.tolist():  # a term's places in one sentence are swapped together
        key = int(owner[i]), int(ends[part.start[i]]), int(terms.numbers[at[i]])
        said[key] = said.get(key, 0) + 1
    for (k, _, a), times in said.items():
        for b in terms.others[a]:
            lost = [f for f in terms.own[a] - terms.own[b] if counts[k].get(f, 0) <= times]
            yield k, lost, [f for f in terms.own[b] - terms.own[a] if f not in counts[k]]
    seeds = np.add.reduceat(np.append(hashes[:n], np.uint64(0)), np.minimum(part.edges[:-1], n)) if documents else []
    for k in range(documents):
        a, b = terms.pick(int(seeds[k]))
        put = [f for f in terms.own[a] if f not in counts[k]]
        yield k, [], put
        yield k, put, [f for f in terms.own[b] if f not in counts[k]]


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, feature) once for each document that has it."""
    for batch in batches:
        labels = np.asarray(batch.column(1))
        for part in words(batch.column(0), LETTERS_DIGITS):
            hashes, owner = features(part)
            order = np.lexsort((hashes, owner))
            hashes, owner = hashes[order], owner[order]
            first = np.ones(len(hashes), bool)
            first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(labels[part.first : part.last][owner[first]], pa.int32()), pa.array(hashes[first].view(np.int64))], ["label", "feature"])


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    intercept: float

    def scores(self, column: pa.Array) -> np.ndarray:
        raw = np.full(len(column), self.intercept)
        for part in words(column, LETTERS_DIGITS):
            found, owner = found_features(self.keys, part)
            raw[part.first : part.last] += np.bincount(owner, self.weights[found], part.last - part.first)
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def found_features(keys: np.ndarray, part: Words) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``keys`` of the features that each document has, each once, and the document numbers."""
    hashes, owner = features(part)
    if not len(keys) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gate = np.zeros(1 << 16, bool)
    gate[keys >> np.uint64(48)] = True
    maybe = np.flatnonzero(gate[hashes >> np.uint64(48)])
    at = np.minimum(np.searchsorted(keys, hashes[maybe]), len(keys) - 1)
    hit = keys[at] == hashes[maybe]
    pairs = np.unique(owner[maybe][hit].astype(np.int64) * len(keys) + at[hit])
    return pairs % len(keys), pairs // len(keys)


def _encode(keys: np.ndarray):
    """label and the positions of its features, of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: list[np.ndarray] = []
            for part in words(batch.column(0), LETTERS_DIGITS):
                found, owner = found_features(keys, part)
                cuts = np.searchsorted(owner, np.arange(part.last - part.first + 1))
                own += [found[cuts[k] : cuts[k + 1]] for k in range(part.last - part.first)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(own, pa.list_(pa.int32()))], ["label", "place", "own"])

    return run


def _count_swaps(keys: np.ndarray):
    """Distinct swaps of a task, as positions of the features lost and gained, and how often each is."""

    def positions(hashes: list[int]) -> tuple[int, ...]:
        at = np.minimum(np.searchsorted(keys, np.array(hashes, np.uint64)), len(keys) - 1)
        return tuple(sorted(at[keys[at] == np.array(hashes, np.uint64)].tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            seen: dict[tuple, int] = {}
            for part in words(batch.column(0), LETTERS_DIGITS):
                for _, lost, gained in swaps(part, terms):
                    key = positions(lost), positions(gained)
                    seen[key] = seen.get(key, 0) + 1
            many = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in seen], many), pa.array([b for _, b in seen], many), pa.array(list(seen.values()), pa.int64())], ["lost", "gained", "n"])

    return run


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists behind one another, and the number of each one's list."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, np.int64)
    return np.asarray(lists.flatten(), np.int64), np.repeat(np.arange(len(lists)), size)


def _fit(rows: pa.Table, swapped: pa.Table, keys: np.ndarray, penalty: float, ridge: float, steps: int = 1500) -> Model:
    """Gradient descent with momentum estimates (Adam) on label loss, counterfactual penalty and ridge."""
    y = np.asarray(rows["label"], float)
    toxic = y.sum()
    if not 0 < toxic < len(y):
        share = min(max(toxic / max(len(y), 1), 1e-9), 1 - 1e-9)
        return Model(keys[:0], np.zeros(0), float(np.log(share / (1 - share))) if len(y) else -500.0)
    at, row = _flat(rows["own"])
    # a swap's score change is the weights gained minus the weights lost
    lost, lost_by = _flat(swapped["lost"])
    gained, gained_by = _flat(swapped["gained"])
    s_at, s_row, s_sign = np.concatenate((lost, gained)), np.concatenate((lost_by, gained_by)), np.repeat([-1.0, 1.0], [len(lost), len(gained)])
    share = np.asarray(swapped["n"], float) / max(1, np.asarray(swapped["n"]).sum())
    each = np.where(y > 0, 0.5 / toxic, 0.5 / (len(y) - toxic))  # both labels weigh the same
    w, b = np.zeros(len(keys)), 0.0
    m, v = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[at], len(y)), -500, 500)))
        off = each * (p - y)
        gradient = np.append(np.bincount(at, off[row], len(keys)) + ridge * w, off.sum())
        change = share * np.bincount(s_row, s_sign * w[s_at], len(share))
        gradient[:-1] += 2 * penalty * np.bincount(s_at, s_sign * change[s_row], len(keys))
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(keys, w, float(b))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FEATURES, penalty: float = PENALTY, ridge: float = RIDGE) -> Model:
    """A model of labels(doc_id, toxic) over docs(doc_id, text); the caller chooses what may be learned from."""
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    one = clean.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most 12 bytes for each of ``sample`` rows
    texts = id_and_text(docs).where("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "label")
    count = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    good, bad = count.get(0, 0), count.get(1, 0)
    counts = texts.mapInArrow(_count_features, _FEATURES).groupBy("feature").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / F.lit(bad + 1.0)) - F.log((F.col("good") + 0.5) / F.lit(good + 1.0))
    telling = counts.where((F.col("bad") + F.col("good") >= LEAST_DOCS) & (F.abs(odds) >= LEAST_ODDS))
    # the weight of evidence: log odds by the root of the documents that give it
    best = telling.orderBy(F.desc(F.abs(odds) * F.sqrt(F.col("bad") + F.col("good"))), "feature").limit(most).collect()
    named = [term_features(t) for kind in IDENTITY for t in kind]
    keys = np.unique(np.concatenate([np.array([r["feature"] for r in best], np.int64).view(np.uint64), *named]))
    rows = texts.withColumn("place", F.xxhash64("text", "label")).mapInArrow(_encode(keys), "label int, place long, own array<int>").toArrow().sort_by([("place", "ascending")])
    # a task's rows are its distinct swaps: the terms' pairs, whatever the number of documents, but for features that a document has itself
    counted = texts.mapInArrow(_count_swaps(keys), "lost array<int>, gained array<int>, n long").groupBy("lost", "gained").agg(F.sum("n").alias("n"))
    return _fit(rows, counted.toArrow().sort_by([("n", "ascending")]), keys, penalty, ridge)


def _score(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def swap_gap(docs: DataFrame, model: Model) -> DataFrame:
    """n, mean_gap, most_gap: how far the scores of each document with a term put in and with another one are apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
        squash = lambda raw: 1 / (1 + np.exp(-np.clip(raw, -500, 500)))
        for batch in batches:
            gaps = []
            for part in words(batch.column(0), LETTERS_DIGITS):
                found, owner = found_features(model.keys, part)
                raw = model.intercept + np.bincount(owner, model.weights[found], part.last - part.first)
                for k, lost, gained in swaps(part, terms):
                    if lost:
                        with_a, with_b = (raw[k] + sum(weight.get(f, 0.0) for f in put) for put in (lost, gained))
                        gaps.append(abs(float(squash(with_b) - squash(with_a))))
            yield pa.RecordBatch.from_arrays([pa.array(gaps, pa.float64())], ["gap"])

    texts = id_and_text(docs).where("text is not null").select("text")
    return texts.mapInArrow(run, "gap double").agg(F.count("*").alias("n"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("most_gap"))


def learnable(frame: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    return frame.where(crc_mod(F.col("doc_id"), folds) != held_out)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model that never saw the held-out fold's labels."""
    model = fit(learnable(docs), learnable(labels), **options)
    rows = id_and_text(docs).select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(_score(model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Documents that score below the threshold, all columns kept."""
    model = fit(learnable(docs), learnable(labels), **options)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)

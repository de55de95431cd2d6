"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public byte
vocabulary.  The probability of a word is the sum over all its segmentations,
by a forward recursion over its bytes; a text's is the product over its words.
The piece probabilities are fitted by expectation-maximisation (forward and
backward sums) on word counts of a bounded sample of labelled documents.

A word here is a space and a run of non-space bytes, A-Z lower-cased, of any
length.  The recursion goes along a word in steps of ``STEP`` bytes and carries
the sums of the last bytes, as many as the longest piece has.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
documents with null language or text are not learned from, nor are languages
beyond the ``LANGUAGES`` most frequent; ties go to the
language that comes first; without any labelled document every text is
``und``; repeated rows are judged row by row; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, id_and_text
from .kernels import NOT_SPACE, Words, powers, words

#: Documents of each language that are learned from, about (chosen by a hash of their ids).
SAMPLE = 3000
#: Most languages that are learned, those with most documents; a number for each piece and language goes to the driver.
LANGUAGES = 256
#: Bytes of a word between two scalings of its sums.
STEP = 24
ROUNDS = 3
#: Added to a piece's expected count.
SMOOTHING = 0.05
#: Distinct words that are scored at once, and about their bytes.
WORDS_AT_ONCE = 10_000
BYTES_AT_ONCE = 400_000
FOLDS = 5
HELD_OUT = 0
UNKNOWN = "und"


def load_pieces(ranks_path: str) -> list[bytes]:
    """The vocabulary's pieces; all single bytes are among them."""
    with open(ranks_path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]) for line in f}
    return sorted({p for p in pieces if p} | {bytes([b]) for b in range(256)})


class PieceTable:
    """Piece numbers by hash and length; what only begins a piece is known too."""

    def __init__(self, pieces: list[bytes]):
        self.size, self.longest = len(pieces), max(map(len, pieces))
        number = {p[:k]: -2 for p in pieces for k in range(1, len(p))} | {p: k for k, p in enumerate(pieces)}
        data = np.frombuffer(b"".join(number), np.uint8)
        length = np.array([len(p) for p in number])
        end = np.cumsum(length)
        self.keys = _hashes(data, end - length, end)
        order = np.argsort(self.keys)
        self.keys, self.numbers = self.keys[order], np.array(list(number.values()))[order]
        # open addressing by the top bits: a first slot that mostly decides
        self.bits = 21
        self.slot = np.zeros(1 << self.bits, bool)
        self.slot[self.keys >> np.uint64(64 - self.bits)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers, -2 for what only begins a piece, -1 for others."""
        out = np.full(len(hashes), -1)
        maybe = np.flatnonzero(self.slot[hashes >> np.uint64(64 - self.bits)])
        at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == hashes[maybe]
        out[maybe[hit]] = self.numbers[at[hit]]
        return out


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    from .kernels import mix

    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * up[:-1], out=sums[1:])
    return sums, down


@dataclass
class Lattice:
    """Pieces by the byte they end at, then by word: ``row``, bytes but one (``back``) and number; ``edges`` of each byte's pieces."""

    count: int
    width: int
    row: np.ndarray
    back: np.ndarray
    piece: np.ndarray
    edges: np.ndarray


def lattice(table: PieceTable, data, start: np.ndarray, length: np.ndarray, first: int = 0, width: int | None = None) -> Lattice:
    """The pieces of words that end in their bytes first .. first + width - 1; data are bytes or their ``_sums``."""
    from .kernels import mix

    sums, down = data if isinstance(data, tuple) else _sums(data)
    width = int(length.max()) - first if width is None else width
    low = max(0, first - table.longest + 1)
    stop = np.minimum(length, first + width)
    n = np.maximum(stop - low, 0)
    row = np.repeat(np.arange(len(start)), n)
    at = low + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    found = []
    for k in range(table.longest):
        inside = at + k < stop[row]
        row, at = row[inside], at[inside]
        if not len(row):
            break
        a = start[row] + at
        number = table.find(mix((sums[a + k + 1] - sums[a]) * down[a] + np.uint64(k + 1)))
        hit = np.flatnonzero((number >= 0) & (at + k >= first))
        found.append((at[hit] + (k - first), row[hit], np.full(len(hit), k), number[hit]))
        more = number != -1
        row, at = row[more], at[more]
    end, row, back, piece = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
    order = np.argsort(end * len(start) + row, kind="stable")
    return Lattice(len(start), width, row[order], back[order], piece[order], np.searchsorted(end[order], np.arange(width + 1)))


def forward(found: Lattice, length: np.ndarray, p: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """sums[w, i, language]: probability mass of all segmentations of the first i bytes; p[piece, language].

    With ``before``, the sums up to the first byte, these come first.
    """
    return _forward(found, p[found.piece], before)


def _forward(found: Lattice, p: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    had = 1 if before is None else before.shape[1]
    sums = np.zeros((found.count, had + found.width, p.shape[1]))
    sums[:, :had] = 1 if before is None else before
    for i in range(found.width):
        a, b = found.edges[i], found.edges[i + 1]
        if a < b:
            rows = found.row[a:b]
            heads = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            sums[rows[heads], had + i] = np.add.reduceat(sums[rows, had - 1 + i - found.back[a:b]] * p[a:b], heads)
    return sums


def log_mass(table: PieceTable, data, start: np.ndarray, length: np.ndarray, p: np.ndarray, own: np.ndarray | None = None) -> list[np.ndarray]:
    """Log probability of each word in each language, or its own, after each step; the last entry is of whole words."""
    out = [np.zeros((len(start), p.shape[1] if own is None else 1))]
    rows, first, before = np.arange(len(start)), 0, None
    while len(rows):
        width = min(STEP, int(length[rows].max()) - first)
        found = lattice(table, data, start[rows], length[rows], first, width)
        sums = _forward(found, p[found.piece] if own is None else p[found.piece, own[rows][found.row]][:, None], before)
        had, left = sums.shape[1] - width, length[rows] - first
        last = sums[np.arange(len(rows)), had - 1 + np.minimum(left, width)]
        out.append(out[-1].copy())
        out[-1][rows] += np.log(last)
        more = left > width
        rows, first = rows[more], first + width
        before = np.zeros((len(rows), table.longest, sums.shape[2]))
        keep = min(table.longest, sums.shape[1])
        before[:, table.longest - keep :] = sums[more, sums.shape[1] - keep :] / last[more][:, None]
    return out


def expected(table: PieceTable, data, start: np.ndarray, length: np.ndarray, own: np.ndarray, weight: np.ndarray, p: np.ndarray, total: np.ndarray) -> None:
    """Add the words' expected counts of pieces, each in its own language, to total[piece, language]."""
    logs = np.concatenate(log_mass(table, data, start, length, p, own), 1)
    found = lattice(table, data, start, length)
    # sums are scaled along a word by its mass up to there, so that none of them vanishes
    at = np.arange(found.width + 1)[None, :]
    low = np.minimum(at // STEP, logs.shape[1] - 2)
    size = np.clip(length[:, None] - low * STEP, 1, STEP)
    rows = np.arange(len(start))[:, None]
    curve = logs[rows, low] + (logs[rows, low + 1] - logs[rows, low]) * np.minimum((at - low * STEP) / size, 1)
    end = np.repeat(np.arange(found.width), np.diff(found.edges))
    scaled = p[found.piece, own[found.row]] * np.exp(curve[found.row, end - found.back] - curve[found.row, end + 1])
    ahead = _forward(found, scaled[:, None], None)[:, :, 0]
    behind = np.zeros_like(ahead)
    behind[np.arange(len(start)), length] = 1
    shares = np.zeros(len(scaled))
    for i in range(found.width - 1, -1, -1):
        a, b = found.edges[i], found.edges[i + 1]
        row, begin = found.row[a:b], i - found.back[a:b]
        shares[a:b] = behind[row, i + 1] * scaled[a:b]
        behind[row, begin] += shares[a:b]  # a word has one piece of each length here
    whole = ahead[np.arange(len(start)), length]
    np.add.at(total, (found.piece, own[found.row]), weight[found.row] * ahead[found.row, end - found.back] * shares / whole[found.row])


def _runs(part: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a piece of text: bytes with a space before each, start, length, and owner."""
    owner = np.repeat(np.arange(part.last - part.first), np.diff(part.edges))
    return part.data, part.start, part.end - part.start, owner


def _distinct(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the distinct runs, and each run's number."""
    _, first, number = np.unique(_hashes(data, start, start + size), return_index=True, return_inverse=True)
    return first, number


def _spaced(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs behind one another, a space before each."""
    length = size + 1
    to = np.cumsum(length) - length
    out = np.full(int(length.sum()), 32, np.uint8)
    take = np.repeat(start - to - 1, length) + np.arange(len(out))
    inside = np.ones(len(out), bool)
    inside[to] = False
    out[inside] = data[take[inside]]
    return out, to, length


def _by_length(length: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in groups of similar length."""
    order = np.argsort(length, kind="stable")
    a = 0
    while a < len(order):
        part = order[a : a + WORDS_AT_ONCE]
        fit = int(np.searchsorted(length[part] * np.arange(1, len(part) + 1), BYTES_AT_ONCE, "right"))
        part = part[: max(fit, 1)]
        yield part
        a += len(part)


class Model:
    def __init__(self, pieces: list[bytes], languages: list[str], p: np.ndarray):
        self.pieces, self.languages, self.p = pieces, languages, p
        self.table: PieceTable | None = None

    def __getstate__(self):
        return self.pieces, self.languages, self.p

    def __setstate__(self, state):
        self.__init__(*state)

    def word_scores(self, data: np.ndarray, to: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        self.table = self.table or PieceTable(self.pieces)
        out = np.zeros((len(to), len(self.languages)))
        sums = _sums(data)
        for rows in _by_length(length):
            out[rows] = log_mass(self.table, sums, to[rows], length[rows], self.p)[-1]
        return out

    def text_scores(self, column: pa.Array) -> np.ndarray:
        """Log probability of each text in each language."""
        out = np.zeros((len(column), len(self.languages)))
        for part in words(column, NOT_SPACE, (4 << 20) - 2):
            data, start, size, owner = _runs(part)
            if len(start):
                first, number = _distinct(data, start, size)
                scores = self.word_scores(*_spaced(data, start[first], size[first]))[number]
                for k in range(len(self.languages)):
                    out[part.first : part.last, k] = np.bincount(owner, scores[:, k], part.last - part.first)
        return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang = batch.column(1).to_pylist()
        for part in words(batch.column(0), NOT_SPACE):
            data, start, size, owner = _runs(part)
            if not len(start):
                continue
            first, number = _distinct(data, start, size)
            names = sorted(set(lang[part.first : part.last]))
            of = np.array([names.index(x) for x in lang[part.first : part.last]])
            pairs, counts = np.unique(of[owner] * np.int64(len(first)) + number, return_counts=True)
            at = first[pairs % len(first)]
            texts = [data[a : a + n].tobytes() for a, n in zip(start[at].tolist(), size[at].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in pairs // len(first)]), pa.array(texts, pa.binary()), pa.array(counts)], ["lang", "word", "n"])


def _expect(model: Model):
    """Expected counts of the pieces over (lang, word, n) rows; one row for each language and piece of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(model.pieces)
        total = np.zeros((len(model.pieces) + 1, len(model.languages)))
        number = {x: k for k, x in enumerate(model.languages)}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lang = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            n = np.asarray(batch.column(2)).astype(float)
            length = np.array([len(t) + 1 for t in texts])
            data = np.frombuffer(b"".join(b" " + t for t in texts), np.uint8)
            to = np.cumsum(length) - length
            sums = _sums(data)
            for rows in _by_length(length):
                expected(table, sums, to[rows], length[rows], lang[rows], n[rows], model.p, total)
        piece, lang = np.nonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[piece, lang])], ["lang", "piece", "n"])

    return run


def fit(docs: DataFrame, ranks_path: str, sample: int = SAMPLE, rounds: int = ROUNDS, languages: int = LANGUAGES) -> Model:
    """A model of docs(doc_id, text, lang); the caller chooses what may be learned from."""
    pieces = load_pieces(ranks_path)
    rows = id_and_text(docs, F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    rows = rows.where(F.col("lang").isin(list(sizes)))
    names = sorted(sizes)
    if not names:
        return Model(pieces, [], np.zeros((len(pieces) + 1, 0)))
    share = F.create_map(*(F.lit(x) for k in names for x in (k, min(1.0, sample / sizes[k]))))[F.col("lang")]
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    counts = cut(chosen.select("text", "lang").mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    length = np.array([len(x) for x in pieces])
    start = np.append(1e-3 ** np.minimum(length, 3) / len(pieces), 0)  # any start that prefers no language
    p = np.repeat(start[:, None] / start.sum(), len(names), 1)
    for _ in range(rounds):
        got = counts.mapInArrow(_expect(Model(pieces, names, p)), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros((len(pieces) + 1, len(names)))
        total[got["piece"], got["lang"]] = got["n"]
        total[:-1] += SMOOTHING
        p = total / total.sum(0)
    return Model(pieces, names, p)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            lettered = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
            n = batch.num_rows
            lang, score = [UNKNOWN] * n, np.zeros(n)
            if model.languages:
                logs = model.text_scores(texts)
                best = logs.argmax(1)
                score = np.where(lettered, 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1), 0.0)
                lang = [model.languages[k] if has else UNKNOWN for k, has in zip(best.tolist(), lettered.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, ranks_path: str, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, by a model that never saw the held-out fold."""
    model = fit(docs.where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT), ranks_path, **options)
    rows = id_and_text(docs).select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")

"""Best-fit decreasing packing of token pieces into sequences of a fixed capacity.

Tokenising and cutting run per document.  Lengths are whole numbers up to the
capacity, so best-fit decreasing depends only on how many pieces have each
length: the driver packs that histogram (at most ``capacity`` rows at any
input size).  A segment tree over remaining capacities finds the tightest open
bins; equal pieces and bins with equal room are placed as runs.  Pieces then
get their place from their rank among pieces of the same length.

Defined cases: a null text is empty, so its document is the end token alone;
repeated rows and null ids are packed row by row; texts of any length are
encoded whole, by the tokenizers library where the faster encoder gives up;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_and_text

#: Fixed value: how byte-level vocabularies of this family split a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CAPACITY = 1024
END_ID = 2

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_encoders: dict[str, object] = {}


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(vocabulary_path: str, pattern: str):
    """An encoder of the byte-level BPE vocabulary in a tokenizer's json file, made once in a worker process.

    The ids are those of the tokenizers library, by an encoder four times as
    fast: the vocabulary's ids are in the order of its merges, which is what
    byte-pair ranks are.  Tests hold both against each other.
    """
    if vocabulary_path not in _encoders:
        import tiktoken

        with open(vocabulary_path, encoding="utf-8") as f:
            described = json.load(f)
        special = {x["content"]: x["id"] for x in described.get("added_tokens", [])}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): rank for token, rank in described["model"]["vocab"].items() if token not in special}
        encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> list[int]:
            try:
                return encoding.encode(text, allowed_special="all")
            except ValueError:  # its pattern engine gives up on very long runs of white space
                return _plain_encoder(vocabulary_path).encode(text, add_special_tokens=False).ids

        _encoders[vocabulary_path] = encode
    return _encoders[vocabulary_path]


def _plain_encoder(vocabulary_path: str):
    """The tokenizers library's own encoder of the vocabulary, made once in a worker process."""
    from tokenizers import Tokenizer

    key = f"plain {vocabulary_path}"
    if key not in _encoders:
        _encoders[key] = Tokenizer.from_file(vocabulary_path)
    return _encoders[key]


def _cut_documents(vocabulary_path: str, pattern: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary_path, pattern)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            texts = batch.column(1)
            for doc_id, text in zip(batch.column(0).to_pylist(), (x.as_py() for x in texts), strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                first = (len(ids) - 1) % capacity + 1  # only the first piece may be shorter
                starts = [0, *range(first, len(ids), capacity)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    for column, value in zip(out, (doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class RoomTree:
    """Segment tree over remaining capacities 0..capacity: which have open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = np.zeros(2 * self.size, bool)

    def set(self, room: int, is_open: bool) -> None:
        i = room + self.size
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open room of at least ``least``."""
        i = least + self.size
        if self.open[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for counts[length] pieces of each length.

    Runs (length, first rank, pieces, pieces per bin, first bin, offset): piece
    rank r of the run lies in bin first bin + (r - first rank) // per bin, at
    offset + ((r - first rank) % per bin) * length.
    """
    tree = RoomTree(capacity)
    open_bins: dict[int, deque] = {}
    runs = []
    bins = 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            open_bins.setdefault(room, deque()).append((first, count))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                per = capacity // length
                first, count, room = bins, -(-left // per), capacity
                bins += count
            else:
                first, count = open_bins[room].popleft()
                if not open_bins[room]:
                    tree.set(room, False)
            per = room // length
            full, rest = divmod(min(left, per * count), per)
            used = full * per + rest
            runs.append((length, rank, used, per, first, capacity - room))
            put(room - per * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), count - full - bool(rest))
            rank, left = rank + used, left - used
    return runs


def _place(runs: list[tuple[int, int, int, int, int, int]]):
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    # ranks start anew with each length, so (length, rank) is in order
    scale = np.int64(1) << np.int64(50)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] * scale + table[:, 1] if len(table) else None
        for batch in batches:
            length, rank = (np.asarray(batch.column(k)) for k in (3, 5))
            of = table[np.searchsorted(keys, length * scale + rank, "right") - 1] if batch.num_rows else table[:0]
            since = rank - of[:, 1]
            sequence, offset = of[:, 4] + since // np.maximum(of[:, 3], 1), of[:, 5] + since % np.maximum(of[:, 3], 1) * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary_path: str, pattern: str = PATTERN, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Lengths stay below 2 ** 13 and ranks below 2 ** 50.  Ranks come from counts
    of each length in each partition of the checkpointed pieces, so no task
    sees all pieces of a common length.
    """
    pieces = cut(id_and_text(docs).mapInArrow(_cut_documents(vocabulary_path, pattern, capacity, end_id), _PIECES))
    # as checkpointed, a row's partition and order are fixed
    placed = pieces.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    counts = cut(placed.groupBy("length", "part").count())
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("part", "length").orderBy("row")
    ranked = placed.withColumn("rank", F.row_number().over(within) - 1).join(starts, ["part", "length"])
    runs = best_fit_runs({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, (F.col("before") + F.col("rank")).cast("long").alias("rank")).mapInArrow(_place(runs), f"{_PIECES}, sequence_id long, offset long")

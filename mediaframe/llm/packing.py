"""Best-fit packing of token sequences, certified by lower bounds from dual feasible functions.

Documents become token ids and an end mark. Only documents longer than a sequence are cut, into whole sequences after a
first piece of what is left over; whole pieces are sequences of their own. The other pieces are dealt to partitions of
bounded size, each packed by best-fit decreasing. Dual feasible functions of the lengths give a bound that no packing of
a partition can beat; a partition that meets it is certified and hands over its emptiest sequence only, a partition with
a gap all sequences with room left. What is handed over is dealt anew, packed again and certified again, round after
round, until the whole meets the bound of all lengths together or a round saves no sequence.

Defined cases: null and empty texts are the end mark alone; rows without id, repeated ids and repeated rows are packed
like any other, each row by itself; an empty table gives an empty result. A text is encoded whole, in memory of a few
times its size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, field, slices, to_arrow

CAPACITY = 2048
END = 0
#: Pieces that a packing task holds, and rounds of exchange at most (a round that saves nothing is the last).
TASK_PIECES = 20_000
ROUNDS = 4
#: Dual feasible functions: how many of the rounding family are combined with the thresholds.
FAMILY = 8
#: The word pattern of the byte-level vocabulary (a fixed value of its format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ENCODED_BYTES = 1 << 20

_encodings: dict[str, tiktoken.Encoding] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others for
    the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary of a tokenizer file whose merges are ranked by id, held once per process."""
    if path not in _encodings:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        special = {t["content"]: t["id"] for t in found["added_tokens"]}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in found["model"]["vocab"].items() if token not in special}
        _encodings[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encodings[path]


def piece_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """The lengths of the pieces of ``n`` tokens: what is left over first, then whole sequences."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(id, piece, start, length, ids): the pieces of every row; ids are unsigned 32-bit little-endian numbers."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), field("piece", "int"), field("start", "bigint"), field("length", "bigint"), field("ids", "binary")])
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            for part in slices(batch, 1, ENCODED_BYTES):
                rows, pieces, starts, lengths, ids = [], [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    found = np.array([*enc.encode(text or "", allowed_special="all"), end], "<u4")
                    at = 0
                    for number, length in enumerate(piece_lengths(len(found), capacity)):
                        rows.append(row)
                        pieces.append(number)
                        starts.append(at)
                        lengths.append(length)
                        ids.append(found[at : at + length].tobytes())
                        at += length
                arrays = [part.column(0).take(pa.array(rows, pa.int64()))]
                arrays += [pa.array(v, to_arrow(f.dataType)) for v, f in zip((pieces, starts, lengths, ids), schema.fields[1:])]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


# --- best-fit decreasing and its bound ------------------------------------------------------------------------


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece: the longest first, each into the fullest sequence that has room for it. The
    sequence is the index of its first piece."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: dict[int, list[int]] = {}
    free = 0  # bit r is set while some sequence has r tokens of room
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        fits = free >> length
        if fits:
            left = length + (fits & -fits).bit_length() - 1
            name = room[left].pop()
            if not room[left]:
                free ^= 1 << left
        else:
            left, name = capacity, i
        sequence[i], offset[i] = name, capacity - left
        left -= length
        if left:
            room.setdefault(left, []).append(name)
            free |= 1 << left
    return sequence, offset


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY, family: int = FAMILY) -> int:
    """A number of sequences that no packing goes below; ``counts[x]`` pieces have length x.

    Thresholds t lift pieces over capacity - t to the whole and drop those under t; rounding functions k then map x to
    itself where (k + 1) x is a multiple of the capacity, else to floor((k + 1) x / capacity) capacity / k. Both kinds, and
    one after the other, are dual feasible: what fits into a sequence still fits in total after the mapping."""
    x = np.flatnonzero(counts)
    n = counts[x].astype(np.int64)
    if not len(x):
        return 0
    best = 0
    thresholds = np.concatenate(([0], x[x <= capacity // 2]))
    for at in range(0, len(thresholds), 256):
        t = thresholds[at : at + 256, None]
        y = np.where(x > capacity - t, capacity, np.where(x < t, 0, x))
        best = max(best, int(-(-(y @ n).max() // capacity)))
        for k in range(1, family + 1):
            z = np.where((k + 1) * y % capacity == 0, k * y, (k + 1) * y // capacity * capacity)
            best = max(best, int(-(-(z @ n).max() // (capacity * k))))
    return best


ROW = ["__n", "__seq", "offset", "__open", "__gap"]


def packed(pieces: DataFrame, tasks: int, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a unique ``__n``) dealt to ``tasks`` tasks and packed there: ``__seq`` is the number of the
    sequence's first piece, ``__open`` tells the sequences that are handed over, ``__gap`` is the task's count over
    its bound."""
    keep = [c for c in pieces.columns if c not in ROW[1:]]
    schema = T.StructType([pieces.schema[c] for c in keep] + [field("__seq", "bigint"), field("offset", "bigint"), field("__open", "boolean"), field("__gap", "bigint")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        table = table.sort_by("__n")  # the same packing in whatever order the rows come
        lengths, number = (table.column(c).to_numpy() for c in ("length", "__n"))
        sequence, offset = best_fit(lengths, capacity)
        names, which = np.unique(sequence, return_inverse=True)
        filled = np.bincount(which, weights=lengths).astype(np.int64)
        gap = len(names) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        loose = filled < capacity
        if not gap:
            loose &= np.arange(len(names)) == np.argmin(filled)
        fresh = [pa.array(number[sequence]), pa.array(offset), pa.array(loose[which]), pa.array(np.full(len(lengths), gap))]
        yield from pa.Table.from_arrays([*table.columns, *fresh], names=schema.names).to_batches()

    return pieces.select(*keep).repartition(tasks, "__n").mapInArrow(run, schema)


def tasks_for(n: int, most: int = TASK_PIECES) -> int:
    return max(1, -(-n // most))


def sequences_in(rows: DataFrame) -> int:
    """Sequences are named by their first piece."""
    return rows.where("offset = 0").count()


def pack(pieces: DataFrame, capacity: int = CAPACITY, task_pieces: int = TASK_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (any columns, ``length`` from 1 to ``capacity``; best checkpointed) with ``sequence_id`` and ``offset``.

    Pieces are numbered where they lie. Between rounds the driver reads counts only: the lengths' histogram, of at
    most ``capacity`` rows, and the numbers of sequences."""
    numbered = pieces.withColumn("__n", F.monotonically_increasing_id())
    whole = numbered.where(F.col("length") == capacity).select(*pieces.columns, F.col("__n").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = numbered.where(F.col("length") < capacity)
    counts = np.zeros(capacity + 1, np.int64)
    for row in rest.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    bound = lower_bound(counts, capacity)
    now = checkpointed(packed(rest, tasks_for(int(counts.sum()), task_pieces), capacity))
    total, done = sequences_in(now), []
    for _ in range(rounds):
        given = now.where("__open")
        size = given.count() if total > bound else 0
        if not size:
            break
        again = checkpointed(packed(given, tasks_for(size, task_pieces), capacity))
        saved = sequences_in(given) - sequences_in(again)
        if saved <= 0:
            break
        done.append(now.where("not __open"))
        now, total = again, total - saved
    out = whole
    for rows in [*done, now]:
        out = out.unionByName(rows.select(*pieces.columns, F.col("__seq").alias("sequence_id"), "offset"))
    return out


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence, from packed pieces with their ids; a sequence has at most
    its capacity of pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.expr("aggregate(transform(parts, p -> p.ids), cast('' as binary), (a, b) -> concat(a, b))").alias("ids"))


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): every piece's place; the ids themselves stay behind."""
    pieces = token_pieces(docs, path, id_col, text_col, capacity)
    pieces = checkpointed(pieces.select(F.col(id_col).alias("__id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return pack(pieces, capacity).select(F.col("__id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

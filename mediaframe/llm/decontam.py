"""Benchmark decontamination by pigeonhole edit matching over words.

Texts become sequences of words: lower-cased, ASCII punctuation removed. An item of ``n`` words may differ from a
passage by ``k = floor((1 - similarity) * n)`` word edits. Cut into ``k + 1`` pieces, at least one piece of the item
then stands in the passage unchanged. Exact piece hits are found in every text; around each the best passage is
verified with Myers' bit-parallel distance, whose bits are the item's words.

The item set is a query set: it is compiled in blocks of bounded size, each block is broadcast and meets all texts.

Defined cases: null and empty texts match nothing; items without a word match nothing; repeated items with other ids are
reported each; equal texts and repeated rows give equal hits per row; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import bytes_of, slices

SIMILARITY = 0.8
#: Words of the items in one block: what is broadcast at a time stays under about 20 MB.
BLOCK_WORDS = 200_000
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
FACTOR = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(None, PUNCTUATION).split() if text else []


def pieces(n: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of the ``k + 1`` pieces of ``n`` words, as equal as can be."""
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def budget(n: int, similarity: float) -> int:
    return int((1 - similarity) * n + 1e-9)


class Block:
    """Some items compiled: word numbers, hashed pieces by length, and Myers masks."""

    def __init__(self, items: list[tuple[int, str]], similarity: float) -> None:
        self.number: dict[bytes, int] = {}
        self.items: list[tuple[int, int, int, dict[int, int]]] = []
        self.pieces: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            codes = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            k = budget(len(codes), similarity)
            masks: dict[int, int] = {}
            for i, c in enumerate(codes):
                masks[c] = masks.get(c, 0) | 1 << i
            at = len(self.items)
            self.items.append((item_id, len(codes), k, masks))
            for start, length in pieces(len(codes), k):
                key = int(rolling(np.array(codes[start : start + length], np.uint64), length)[0])
                self.pieces.setdefault(length, {}).setdefault(key, []).append((at, start))
        self.keys = {length: np.array(sorted(found), np.uint64) for length, found in self.pieces.items()}

    def hits(self, words: list[bytes]) -> Iterator[tuple]:
        """(item id, words of the item, distance, first word, end word) of the best passage for each item that matches."""
        codes = np.fromiter(map(self.number.get, words, ZERO), np.uint64, len(words)) if words else np.zeros(0, np.uint64)
        regions: dict[int, list[tuple[int, int]]] = {}
        for length, keys in self.keys.items():
            if len(codes) < length:
                continue
            values = rolling(codes, length)
            at = np.searchsorted(keys, values)
            at[at == len(keys)] = 0
            for p in np.flatnonzero(keys[at] == values).tolist():
                for item, start in self.pieces[length][int(values[p])]:
                    _, n, k, _ = self.items[item]
                    regions.setdefault(item, []).append((max(0, p - start - k), min(len(codes), p - start + n + k)))
        listed = codes.tolist() if regions else []
        for item, found in sorted(regions.items()):
            item_id, n, k, masks = self.items[item]
            best = None
            for a, b in merged(found):
                end, distance = myers(masks, n, listed[a:b])
                if distance <= k and (best is None or distance < best[0]):
                    first, _ = backwards(masks, n, listed[a : a + end], distance)
                    best = (distance, a + first, a + end)
            if best:
                yield item_id, n, *best


class _Zero:
    """Yields zero for ever: the number of a word that no item has."""

    def __iter__(self):
        return self

    def __next__(self) -> int:
        return 0


ZERO = _Zero()


def rolling(codes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every run of ``length`` codes."""
    n = len(codes) - length + 1
    out = np.zeros(n, np.uint64)
    factor = np.uint64(FACTOR)
    for i in range(length):
        out = (out ^ codes[i : i + n]) * factor
        out ^= out >> np.uint64(29)
    return out


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def myers(masks: dict[int, int], n: int, text: list[int]) -> tuple[int, int]:
    """(end, distance) of the passage of ``text`` nearest to the item of ``n`` words, the first of the best."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, distance = full, 0, n
    best = (0, n)
    get = masks.get
    for j, code in enumerate(text, 1):
        equal = get(code, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up = up << 1 & full
        down = down << 1 & full
        plus = down | ~(vertical | up) & full
        minus = up & vertical
        if distance < best[1]:
            best = (j, distance)
    return best


def backwards(masks: dict[int, int], n: int, text: list[int], distance: int) -> tuple[int, int]:
    """Where the passage that ends with ``text`` starts: the same search over both sequences reversed."""
    flipped = {c: int(format(m, f"0{n}b")[::-1], 2) for c, m in masks.items()}
    back = text[::-1]
    end, found = myers(flipped, n, back[: n + distance])
    return len(text) - end, found


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", similarity: float = SIMILARITY) -> DataFrame:
    """(id, item_id, distance, similarity, first_word, end_word): every item that a text contains, with its best
    passage (words counted from 0, end exclusive). Item ids keep their own type."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("item_id", items.schema[item_col].dataType), *T._parse_datatype_string("distance int, similarity double, first_word int, end_word int").fields])
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    out = None
    for shared in blocks(items, item_col, similarity):
        found = source.mapInArrow(_finder(shared, schema), schema)
        out = found if out is None else out.unionByName(found)
    return source.sparkSession.createDataFrame([], schema) if out is None else out


def blocks(items: DataFrame, item_col: str, similarity: float) -> Iterator:
    """Broadcast blocks of the item set, each of about ``BLOCK_WORDS`` words."""
    sc = items.sparkSession.sparkContext
    held, size = [], 0
    rows = items.select(F.col(item_col), F.col("text").cast("string")).where("text is not null").distinct().orderBy(item_col, "text")
    for item_id, text in rows.toLocalIterator():
        held.append((item_id, text))
        size += len(words_of(text))
        if size >= BLOCK_WORDS:
            yield sc.broadcast(Block(held, similarity))
            held, size = [], 0
    if held:
        yield sc.broadcast(Block(held, similarity))


def _finder(shared, schema):
    kind = to_arrow_type(schema["item_id"].dataType)

    def run(batches):
        block = shared.value
        for batch in batches:
            for part in slices(batch, 1):
                ids, rows = [], []
                for i, b in enumerate(bytes_of(part, 1)):
                    for hit in block.hits(words_of(b.decode("utf-8", "replace"))):
                        ids.append(i)
                        rows.append(hit)
                columns = [part.column(0).take(pa.array(ids, pa.int64()))]
                item, words, distance, first, end = (list(c) for c in zip(*rows)) if rows else ([], [], [], [], [])
                share = [1 - d / n for d, n in zip(distance, words)]
                columns += [pa.array(item, kind), pa.array(distance, pa.int32()), pa.array(share, pa.float64()), pa.array(first, pa.int32()), pa.array(end, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return run


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with their columns, whose text contains no item."""
    at = docs.columns.index(text_col)
    out = docs
    for shared in blocks(items, "item_id", similarity):
        out = out.mapInArrow(_keeper(shared, at), docs.schema)
    return out


def _keeper(shared, at: int):
    def run(batches):
        block = shared.value
        for batch in batches:
            good = [next(block.hits(words_of(b.decode("utf-8", "replace"))), None) is None for part in slices(batch, at) for b in bytes_of(part, at)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return run

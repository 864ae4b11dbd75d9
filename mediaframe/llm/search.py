"""Ranked lexical search over norm buckets.

A document's impact vector holds, for each term of the items, what one occurrence in an item scores. Vectors are ordered
by their length; an item's score is at most the product of both lengths (Cauchy-Schwarz), so once that product falls under
the item's tenth best score so far, the item is done with this bucket and all shorter ones. In a bucket that is left,
coordinates are grouped in segments, the most frequent terms alone and the others shared: the products of the lengths
inside each segment bound a vector's score more closely. Vectors over the bound are scored exactly, in 64-bit integers.

Terms, counts of documents, weights and impacts cover all rows; items come in blocks of bounded size, each searched in one
pass over the documents. Nothing but per-task best lists is shuffled.

Defined cases: null texts have no terms; rows are ranked as they are, so repeated rows follow each other, by ascending id;
rows without id come after all ids of the same score; equal items have equal rankings, items without terms or without a
match none; an empty table gives an empty result. Texts are read whole, in memory of a few times their size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, checkpointed, field, map_texts, slices

TOP = 10
K_TERM, SCALE, SPREAD, LENGTH_SHARE = 8, 1_000_000_000, 1000, 75
#: Terms of all items of a block, and cells of a dense bucket; a bucket has as many vectors as these allow.
BLOCK_TERMS, CELLS, MOST_VECTORS = 8192, 4 << 20, 1024
#: Segments of the coordinates, and how many of them hold one frequent term alone.
SEGMENTS, ALONE = 512, 128
#: Buckets are a power of this apart in length.
RATIO = 1.1
#: Bounds are widened by this share, so that rounding never drops a vector.
SLACK = 1e-9
SALTS = 32
NO_ID = np.iinfo(np.int64).max

_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Letters A-Z become small, bytes outside terms spaces.
FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _KEPT else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text."""
    return text.translate(FOLD).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term with weight 1 scores, in whole numbers."""
    return SCALE * tf // (SPREAD * tf + K_TERM * m)


class Block:
    """Items that are searched together: their terms in a fixed order, and per item the columns and repeats."""

    def __init__(self, texts: list[bytes]) -> None:
        counts = [Counter(terms_of(t)) for t in texts]
        self.terms = sorted(set().union(*counts)) if counts else []
        column = {t: i for i, t in enumerate(self.terms)}
        self.columns = [np.array([column[t] for t in c], np.int64) for c in counts]
        self.repeats = [np.array(list(c.values()), np.int64) for c in counts]


def term_counts(docs: DataFrame, block: Block, id_col: str, text_col: str) -> DataFrame:
    """(id, n, columns, tf): every row's number of terms, and the block's terms in it as packed numbers."""
    column = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(block.terms)})

    def make():
        of = column.value

        def work(part: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"n": [], "columns": [], "tf": []}
            for b in bytes_of(part, 1):
                words = terms_of(b)
                found, times = np.unique(np.fromiter((of[w] for w in words if w in of), np.int32), return_counts=True)
                out["n"].append(len(words))
                out["columns"].append(found.astype(np.int32).tobytes())
                out["tf"].append(times.astype(np.int32).tobytes())
            return out

        return work

    return map_texts(docs, id_col, text_col, make, [field("n", "bigint"), field("columns", "binary"), field("tf", "binary")])


def document_counts(found: DataFrame, columns: int) -> np.ndarray:
    """How many rows hold each term of the block; tasks add up their own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(columns, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=columns)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["c", "df"])

    out = np.zeros(columns, np.int64)
    for row in found.select("columns").mapInArrow(run, "c bigint, df bigint").groupBy("c").agg(F.sum("df").alias("df")).collect():
        out[row.c] = row.df
    return out


def impact_vectors(found: DataFrame, weights: np.ndarray, docs: int, terms: int) -> DataFrame:
    """(id, bucket, norm, columns, impacts) of rows with a term of the block. Buckets count down from the longest vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [np.frombuffer(b, np.int32) for b in batch.column(2).to_pylist()]
            sizes = np.fromiter(map(len, columns), np.int64, len(columns))
            n = batch.column(1).to_numpy()
            m = 100 - LENGTH_SHARE + np.array([LENGTH_SHARE * int(x) * docs // terms for x in n], np.int64)
            tf = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int32).astype(np.int64)
            values = weights[np.concatenate(columns)] * impact(tf, np.repeat(m, sizes)) if len(tf) else np.zeros(0, np.int64)
            ends = np.cumsum(sizes)
            norms = np.sqrt(np.array([np.square(values[e - s : e].astype(np.float64)).sum() for s, e in zip(sizes, ends)]))
            buckets = -np.floor(np.log(np.maximum(norms, 1)) / math.log(RATIO)).astype(np.int64)
            packed = [values[e - s : e].tobytes() for s, e in zip(sizes, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(buckets), pa.array(norms), batch.column(2), pa.array(packed, pa.binary())], names=["__id", "bucket", "norm", "columns", "impacts"])

    return found.mapInArrow(run, "__id bigint, bucket bigint, norm double, columns binary, impacts binary").where("norm > 0")


class Best:
    """An item's best documents so far: highest scores first, equal scores by ascending id."""

    def __init__(self, top: int, least: int = 1) -> None:
        self.top, self.least = top, least
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids, -scores))[: self.top]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.top:
            self.least = max(self.least, int(self.scores[-1]))


class Searcher:
    """Searches buckets, longest vectors first, for the items of a block."""

    def __init__(self, block: Block, top: int, segments: np.ndarray, least: list[int]) -> None:
        self.block, self.segments, self.width = block, segments, len(block.terms)
        self.n_segments = int(segments.max()) + 1
        self.best = [Best(top, low) for low in least]
        self.lengths = np.array([math.sqrt(float(np.square(r.astype(np.float64)).sum())) for r in block.repeats])
        squares = [np.bincount(segments[c], np.square(r.astype(np.float64)), self.n_segments) for c, r in zip(block.columns, block.repeats)]
        self.parts = np.sqrt(np.array(squares))

    def search(self, ids: np.ndarray, norms: np.ndarray, columns: list[bytes], impacts: list[bytes]) -> int:
        """One bucket, sorted by falling norm. Returns how many pairs of vector and item were scored exactly."""
        least = np.array([b.least for b in self.best], np.float64)
        live = np.flatnonzero(self.lengths * norms[0] * (1 + SLACK) >= least)
        if not len(live):
            return 0
        cols = [np.frombuffer(c, np.int32) for c in columns]
        rows = np.repeat(np.arange(len(ids)), np.fromiter(map(len, cols), np.int64, len(cols)))
        col, values = np.concatenate(cols), np.frombuffer(b"".join(impacts), np.int64)
        parts = np.bincount(rows * self.n_segments + self.segments[col], np.square(values.astype(np.float64)), len(ids) * self.n_segments)
        bounds = self.parts[live] @ np.sqrt(parts).reshape(len(ids), self.n_segments).T
        may = bounds * (1 + SLACK) >= least[live, None]
        dense = np.zeros((len(ids), self.width), np.int64)
        dense[rows, col] = values
        scored = 0
        for i, row in zip(live.tolist(), may):
            at = np.flatnonzero(row)
            if len(at):
                scored += len(at)
                scores = dense[at[:, None], self.block.columns[i]] @ self.block.repeats[i]
                good = scores >= self.best[i].least
                self.best[i].add(scores[good], ids[at[good]])
        return scored


def segments_of(counts: np.ndarray, segments: int = SEGMENTS, alone: int = ALONE) -> np.ndarray:
    """The segment of each column: the most frequent terms by themselves, the others dealt to the segments that are left."""
    place = np.empty(len(counts), np.int64)
    place[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    return place if len(counts) <= segments else np.where(place < alone, place, alone + (place - alone) % (segments - alone))


def best_of_tasks(vectors: DataFrame, block: Block, segments: np.ndarray, least: list[int], top: int) -> DataFrame:
    """(item, __id, score): each task's best rows of every item, over thresholds that some rows are known to reach."""
    shared = vectors.sparkSession.sparkContext.broadcast((block, segments, least))
    size = int(max(1, min(MOST_VECTORS, CELLS // (len(block.terms) + 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, parts, low = shared.value
        found = Searcher(of, top, parts, low)
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                found.search(ids[at : at + size], part.column(2).to_numpy(), part.column(3).to_pylist(), part.column(4).to_pylist())
        for item, best in enumerate(found.best):
            if len(best.ids):
                named = pa.array(best.ids, mask=best.ids == NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best.ids), item)), named, pa.array(best.scores)], names=["item", "__id", "score"])

    return vectors.sortWithinPartitions("bucket", F.desc("norm")).mapInArrow(run, "item bigint, __id bigint, score bigint")


def merged(rows: DataFrame, top: int) -> DataFrame:
    """(item, __id, score, rank) of the best rows of all tasks. The lists of one item are first cut down in ``SALTS``
    parts, so no task gets the lists of all tasks."""

    def ranked(part: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("__id").asc_nulls_last())
        return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("__id", "score"), F.lit(SALTS)))
    return ranked(ranked(salted, ["item", "__salt"]).drop("__salt", "rank"), ["item"])


def longest(vectors: DataFrame, least: int = MOST_VECTORS) -> DataFrame:
    """The first buckets, as many as hold ``least`` vectors; there are as many rows to count as buckets."""
    sizes = sorted((r["bucket"], r["count"]) for r in vectors.groupBy("bucket").count().collect())
    seen = np.cumsum([n for _, n in sizes])
    last = int(np.searchsorted(seen, least)) if sizes else 0
    return vectors.where(F.col("bucket") <= (sizes[min(last, len(sizes) - 1)][0] if sizes else 0))


def search_block(docs: DataFrame, block: Block, id_col: str, text_col: str, top: int) -> DataFrame:
    """(item, rank, __id, score) of one block."""
    found = checkpointed(term_counts(docs, block, id_col, text_col))
    whole = found.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    counts = document_counts(found, len(block.terms))
    weights = np.array([weight(whole.docs, int(df)) for df in counts], np.int64)
    vectors = impact_vectors(found, weights, whole.docs, max(whole.terms, 1))
    # the longest vectors, searched first where they lie, give every task thresholds to start from
    segments, least = segments_of(counts), [1] * len(block.columns)
    first = merged(best_of_tasks(longest(vectors), block, segments, least, top), top)
    for row in first.where(F.col("rank") == top).collect():
        least[row.item] = row.score
    return merged(best_of_tasks(vectors, block, segments, least, top), top).select("item", "rank", "__id", "score")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, id, score): the ``top`` best rows of ``docs`` for every row of ``items``. Ids of ``docs`` are whole
    numbers. Different item texts are searched once, in blocks of about ``block_terms`` terms (a longer text is a block)."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("__item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("__text"))
    texts = checkpointed(asked.groupBy(F.sha2("__text", 256).alias("key")).agg(F.first("__text").alias("text")).withColumn("size", F.size(F.split("text", r"\s+"))))
    blocks = -(-(texts.agg(F.sum("size")).first()[0] or 0) // block_terms)
    out = spark.createDataFrame([], "key string, rank int, __id bigint, score bigint")
    for number in range(blocks):
        own = texts.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == number).orderBy("key").collect()
        if not own:
            continue
        block = Block([r.text.encode() for r in own])
        if not block.terms:
            continue
        keys = spark.createDataFrame([(i, r.key) for i, r in enumerate(own)], "item bigint, key string")
        found = checkpointed(search_block(docs, block, id_col, text_col, top))
        out = out.unionByName(found.join(keys, "item").select("key", "rank", "__id", "score"))
    named = asked.select("__item", F.sha2("__text", 256).alias("key"))
    return named.join(out, "key").select(F.col("__item").alias(item_col), "rank", F.col("__id").alias(id_col), "score")

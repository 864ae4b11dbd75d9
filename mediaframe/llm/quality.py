"""Quality classifier over supervised subword embeddings.

A word's vector is the mean of the learned vectors of its hashed word form and character n-grams; a document's
vector is the mean over its words and its repetition marks; a softmax layer gives the label. Vectors and layer are
trained together by stochastic gradient descent in numpy on a bounded sample of labelled documents. Scoring uses
that the output is linear in the vectors: the layer is applied once to every bucket, so a task needs one number
per bucket, and a document costs one look-up per word.

Defined cases: a null or empty text has no words and gets the score of the bias alone; labels other than 0 and 1,
null labels and labels without a document are left out; with no usable label, or one class only, every score is the
smoothed share of label 1 (0.5 with none); equal texts and repeated rows score alike, one row each; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, map_texts, texts_of

BUCKETS = 1 << 17
DIMENSIONS = 16
GRAMS = (3, 4)
#: At most so many labelled documents are read to fit the model.
SAMPLE = 4000
EPOCHS = 6
RATE = 2.0
THRESHOLD = 0.3
MEMO = 300_000
#: Buckets of the marks for a word equal to the one before, and a run of four words seen before.
SAME, AGAIN = BUCKETS, BUCKETS + 1


def buckets_of(word: str) -> list[int]:
    """The buckets of a word form and of its character n-grams, with marks for the word's ends."""
    whole = f"<{word}>"
    grams = [whole, *(whole[i : i + n] for n in GRAMS for i in range(len(whole) - n + 1))]
    return [zlib.crc32(g.encode("utf-8", "replace")) % BUCKETS for g in grams]


def repetition(words: list[str]) -> tuple[int, int]:
    """How many words equal the word before, and how many runs of four words came before."""
    same = sum(a == b for a, b in zip(words, words[1:]))
    runs = len(words) - 3
    return same, runs - len(set(zip(words, words[1:], words[2:], words[3:]))) if runs > 1 else 0


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of a document; the weights add up to one."""
    words = text.split()
    index, weight = [], []
    for w in words:
        found = buckets_of(w)
        index += found
        weight += [1 / len(found)] * len(found)
    for bucket, times in zip((SAME, AGAIN), repetition(words)):
        index.append(bucket)
        weight.append(times)
    unique, inverse = np.unique(np.array(index, np.int64), return_inverse=True)
    total = np.bincount(inverse, weight)
    return unique, (total / max(total.sum(), 1)).astype(np.float32)


def fit(rows: list[tuple[str, int]], seed: int = 7) -> tuple[np.ndarray, float]:
    """(one number per bucket, bias): embeddings and softmax layer trained on (text, label), folded."""
    ones = sum(y for _, y in rows)
    if not 0 < ones < len(rows):
        share = (ones + 1) / (len(rows) + 2)
        return np.zeros(BUCKETS + 2, np.float32), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS + 2, DIMENSIONS)).astype(np.float32)
    layer = rng.normal(0, 0.1, (2, DIMENSIONS)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    known = [(*features(t), y) for t, y in rows]
    steps, step = EPOCHS * len(known), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(known)):
            index, weight, label = known[i]
            rate = RATE * (1 - step / steps)
            step += 1
            part = vectors[index]
            hidden = weight @ part
            logits = layer @ hidden + bias
            output = np.exp(logits - logits.max())
            output /= output.sum()
            output[label] -= 1
            back = output @ layer
            layer -= rate * np.outer(output, hidden)
            bias -= 0.1 * rate * output
            # the weights of a long text are tiny; scaled up, each of its buckets learns as in a short one
            vectors[index] = part - rate * np.outer(weight / weight.max(), back).astype(np.float32) * 0.5
    return vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0])


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, size: int = SAMPLE) -> list[tuple[str, int]]:
    """(text, label) of the ``size`` labelled rows with the least hash of their id; of several documents with one id
    the text that sorts first, so that ``size`` bounds what comes to the driver."""
    usable = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where(F.col("__id").isNotNull()).distinct()
    chosen = F.broadcast(usable.orderBy(F.xxhash64("__id"), "__id", "__label").limit(size))
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    rows = texts.join(chosen, "__id").groupBy("__id", "__label").agg(F.min("__text").alias("__text")).select("__id", "__text", "__label").collect()
    return [(r[1], r[2]) for r in sorted(rows)]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", size: int = SAMPLE) -> DataFrame:
    """(id, score): how likely label 1 is, for every row of ``docs``. ``labels``: the rows to learn from."""
    table, bias = fit(labelled_sample(docs, labels, id_col, text_col, label_col, size))
    shared = docs.sparkSession.sparkContext.broadcast((table.astype(np.float32), bias))

    def make():
        values, bias = shared.value
        values = values.tolist()
        memo: dict[str, float] = {}

        def of(word: str) -> float:
            found = buckets_of(word)
            if len(memo) >= MEMO:
                memo.clear()
            memo[word] = out = sum(map(values.__getitem__, found)) / len(found)
            return out

        def judge(text: str) -> float:
            words = text.split()
            get = memo.get
            total = 0.0
            for w in words:
                v = get(w)
                total += of(w) if v is None else v
            same, again = repetition(words)
            total += same * values[SAME] + again * values[AGAIN]
            logit = total / max(len(words) + same + again, 1) + bias
            return float(1 / (1 + np.exp(-np.clip(logit, -500, 500))))

        def work(part: pa.RecordBatch) -> dict:
            return {"score": [judge(t or "") for t in texts_of(part, 1)]}

        return work

    return map_texts(docs, id_col, text_col, make, [field("score", "double")])

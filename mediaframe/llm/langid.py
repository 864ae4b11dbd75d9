"""Language of texts by a linear-chain conditional random field over words.

Every word gets a label; emissions are learned weights of the word itself (lexicon), its affixes and its inner
n-grams, all hashed; transitions between neighbouring labels are learned too. Training runs on windows cut from
labelled documents, half of them joined from two languages, so that transitions see code-switching. A
document's prediction is the label with the largest mean posterior over its words, from forward-backward.

Forward-backward is cut into blocks of words: the transfer matrices of all blocks of a slice are multiplied up side
by side, the block borders are passed along each document, and the insides of all blocks are then filled side by
side. That is the exact recursion, for texts of any length.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the label that sorts
first; documents without language are not learned from; with nothing to learn from everything is ``und``; equal texts
and repeated rows are labelled alike, one row each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import field, map_texts, texts_of

BUCKETS = 1 << 16
#: At most so many documents of each language are read to fit the model.
SAMPLE = 400
LENGTH = 24
WINDOWS = 24_000
EPOCHS = 3
BATCH = 256
RATE = 0.2
BLOCK = 32
MEMO = 300_000
UNKNOWN = "und"

letters = regex.compile(r"\p{L}+").findall


def words_of(text: str | None) -> list[str]:
    return letters(text.lower()) if text else []


def features(word: str) -> list[int]:
    """Buckets of the word, its prefixes and suffixes up to three letters, and its inner bigrams and trigrams."""
    n = len(word)
    found = ["=" + word, *("<" + word[:k] for k in (1, 2, 3) if k <= n), *(">" + word[-k:] for k in (1, 2, 3) if k <= n)]
    found += [word[i : i + 2] for i in range(n - 1)] + [word[i : i + 3] for i in range(n - 2)]
    return [zlib.crc32(f.encode("utf-8", "replace")) % BUCKETS for f in found]


class Model:
    """Labels, emission weights by bucket, and transition scores."""

    def __init__(self, labels: list[str], weights: np.ndarray, transitions: np.ndarray) -> None:
        self.labels, self.weights, self.transitions = labels, weights, transitions

    def emissions(self, words: list[str]) -> np.ndarray:
        """Each word's factors, largest one."""
        lists = [features(w) for w in words]
        starts = np.concatenate(([0], np.cumsum([len(f) for f in lists])[:-1]))
        score = np.add.reduceat(self.weights[[f for found in lists for f in found]], starts, axis=0)
        return np.exp(score - score.max(axis=1, keepdims=True))


def windows(rows: list[tuple[str, str]], labels: list[str], rng) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, word numbers, label numbers) of windows of ``LENGTH`` words. Shorter texts of one language are
    joined until they fill a window; what is left over is repeated."""
    number: dict[str, int] = {}
    texts, short = [[] for _ in labels], [[] for _ in labels]
    for text, lang in rows:
        numbered = [number.setdefault(w, len(number)) for w in words_of(text)]
        k = labels.index(lang)
        if len(numbered) < LENGTH:
            numbered = short[k] = short[k] + numbered
        if len(numbered) >= LENGTH:
            texts[k].append(np.array(numbered, np.int32))
            if numbered is short[k]:
                short[k] = []
    for k, left in enumerate(short):
        if left:
            texts[k].append(np.resize(np.array(left, np.int32), LENGTH))
    usable = [k for k, t in enumerate(texts) if t]
    xs, ys = np.zeros((WINDOWS, LENGTH), np.int32), np.zeros((WINDOWS, LENGTH), np.int8)
    for i in range(WINDOWS if usable else 0):
        border = int(rng.integers(4, LENGTH - 4)) if i % 2 else LENGTH
        for a, b in ((0, border), (border, LENGTH)):
            if b > a:
                k = usable[int(rng.integers(len(usable)))]
                text = texts[k][int(rng.integers(len(texts[k])))]
                at = int(rng.integers(len(text) - (b - a) + 1))
                xs[i, a:b], ys[i, a:b] = text[at : at + b - a], k
    return list(number), xs if usable else xs[:0], ys


def fit(rows: list[tuple[str, str]], seed: int = 11) -> Model:
    """Maximum likelihood by AdaGrad on batches of windows."""
    labels = sorted({lang for _, lang in rows})
    k = len(labels)
    weights, transitions = np.zeros((BUCKETS, k), np.float64), np.zeros((k, k))
    rng = np.random.default_rng(seed)
    words, xs, ys = windows(rows, labels, rng) if k > 1 else ([], np.zeros((0, LENGTH), int), None)
    lists = [features(w) for w in words]
    starts = np.concatenate(([0], np.cumsum([len(f) for f in lists]))).astype(np.int64)
    flat = np.array([f for found in lists for f in found], np.int64)
    square, square_t = np.full_like(weights, 1e-6), np.full_like(transitions, 1e-6)
    for _ in range(EPOCHS):
        for at in range(0, len(xs), BATCH):
            x, y = xs[at : at + BATCH], ys[at : at + BATCH]
            known, inverse = np.unique(x, return_inverse=True)
            inverse = inverse.reshape(x.shape)
            sizes = starts[known + 1] - starts[known]
            index = np.concatenate([flat[starts[w] : starts[w + 1]] for w in known])
            edges = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            score = np.add.reduceat(weights[index], edges, axis=0)
            e = np.exp(score - score.max(axis=1, keepdims=True))[inverse]
            posterior, pairs = posteriors(e, np.exp(transitions))
            truth = np.eye(k)[y]
            error = (posterior - truth).reshape(-1, k)
            by_word = np.stack([np.bincount(inverse.reshape(-1), error[:, j], len(known)) for j in range(k)], axis=1)
            spread = np.repeat(by_word, sizes, axis=0)
            step = np.stack([np.bincount(index, spread[:, j], BUCKETS) for j in range(k)], axis=1) / BATCH
            square += step**2
            weights -= RATE * step / np.sqrt(square)
            seen = np.einsum("bti,btj->ij", truth[:, :-1], truth[:, 1:])
            step = (pairs - seen) / BATCH
            square_t += step**2
            transitions -= RATE * step / np.sqrt(square_t)
    return Model(labels, weights.astype(np.float32), transitions)


def posteriors(e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label posteriors (batch, length, labels) of equally long sequences, and expected transitions in all."""
    b, n, k = e.shape
    alpha, beta = np.empty_like(e), np.ones_like(e)
    state = np.ones((b, k)) / k
    for i in range(n):
        state = (state @ t) * e[:, i]
        state /= state.sum(axis=1, keepdims=True)
        alpha[:, i] = state
    for i in range(n - 2, -1, -1):
        state = (e[:, i + 1] * beta[:, i + 1]) @ t.T
        beta[:, i] = state / state.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    pairs = np.zeros((k, k))
    for i in range(1, n):
        joint = alpha[:, i - 1, :, None] * t * (e[:, i] * beta[:, i])[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return gamma, pairs


def mean_posteriors(index: np.ndarray, lengths: np.ndarray, emissions: np.ndarray, t: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Mean label posteriors per document. ``index``: all documents' words one after the other, as rows of
    ``emissions``; ``lengths``: words per document."""
    k, docs = t.shape[0], len(lengths)
    counts = -(-lengths // block)
    total, first = int(counts.sum()), np.concatenate(([0], np.cumsum(counts)[:-1]))
    owner = np.repeat(np.arange(docs), counts)
    place = np.arange(len(index)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row = first[np.repeat(np.arange(docs), lengths)] + place // block
    padded = np.full((block, total), -1, np.int64)
    padded[place % block, row] = index
    real = padded >= 0
    e = np.where(real[:, :, None], emissions[padded], 1.0)

    def forward(state, i):
        new = (state @ t) * e[i][:, None, :] if state.ndim == 3 else (state @ t) * e[i]
        new /= new.sum(axis=tuple(range(1, new.ndim)), keepdims=True)
        keep = real[i].reshape((-1,) + (1,) * (new.ndim - 1))
        return np.where(keep, new, state)

    transfer = np.broadcast_to(np.eye(k), (total, k, k))
    for i in range(block):
        transfer = forward(transfer, i)
    enter, leave = np.empty((total, k)), np.empty((total, k))
    state = np.ones((docs, k)) / k
    order = np.argsort(-counts, kind="stable")
    for j in range(int(counts.max(initial=0))):
        live = order[: int(np.searchsorted(-counts[order], -j, side="left"))]
        at = first[live] + j
        enter[at] = state[live]
        state[live] = np.einsum("bi,bij->bj", state[live], transfer[at])
        state[live] /= state[live].sum(axis=1, keepdims=True)
    state = np.ones((docs, k))
    for j in range(int(counts.max(initial=0)) - 1, -1, -1):
        live = order[: int(np.searchsorted(-counts[order], -j, side="left"))]
        at = first[live] + j
        leave[at] = state[live]
        state[live] = np.einsum("bij,bj->bi", transfer[at], state[live])
        state[live] /= state[live].sum(axis=1, keepdims=True)
    alpha, state = np.empty((block, total, k)), enter
    for i in range(block):
        state = alpha[i] = forward(state, i)
    mean, beta = np.zeros((total, k)), leave
    for i in range(block - 1, -1, -1):
        gamma = alpha[i] * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        mean += np.where(real[i][:, None], gamma, 0)
        back = (e[i] * beta) @ t.T
        beta = np.where(real[i][:, None], back / back.sum(axis=1, keepdims=True), beta)
    out = np.stack([np.bincount(owner, mean[:, j], docs) for j in range(k)], axis=1)
    return out / np.maximum(lengths, 1)[:, None]


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, size: int = SAMPLE) -> list[tuple[str, str]]:
    """(text, language) of the ``size`` documents of each language with the least hash of their id, out of those whose
    text has a letter; of several documents with one id and language the text that sorts first."""
    usable = docs.where(F.col(text_col).cast("string").rlike(r"\p{L}"))
    rows = usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("id").isNotNull()).distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = rows.withColumn("nth", nth).where(F.col("nth") <= size).select("id", F.col("lang").alias("chosen_lang"))
    texts = usable.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    found = texts.join(F.broadcast(chosen), (texts.id == chosen.id) & (texts.lang == chosen.chosen_lang)).groupBy(texts.id, "chosen_lang").agg(F.min("text").alias("text")).select("text", "chosen_lang").collect()
    return sorted((r[0], r[1]) for r in found)


def predict(docs: DataFrame, learn_from: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = SAMPLE) -> DataFrame:
    """(id, lang_pred, score) for every row of ``docs``; the model learns from ``learn_from``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(sample(learn_from, id_col, text_col, lang_col, size)))

    def make():
        model = shared.value
        labels, t = model.labels, np.exp(model.transitions - model.transitions.max(initial=0))
        memo: dict[str, int] = {}
        table = np.empty((1024, len(labels)))

        def known(texts: list[list[str]]) -> np.ndarray:
            """The rows of ``table`` of all words of ``texts``; new words get theirs together."""
            nonlocal table
            if len(memo) > MEMO:
                memo.clear()
            start = len(memo)
            index: list[int] = []
            for words in texts:
                for w in set(words).difference(memo):
                    memo[w] = len(memo)
                index.extend(map(memo.__getitem__, words))
            if len(memo) > start:
                while len(table) < len(memo):
                    table = np.concatenate((table, np.empty_like(table)))
                table[start : len(memo)] = model.emissions(list(islice(memo, start, None)))
            return np.array(index, np.int64)

        def work(part: pa.RecordBatch) -> dict:
            texts = [words_of(x) for x in texts_of(part, 1)]
            lengths = np.array([len(w) for w in texts], np.int64)
            if not labels or not lengths.any():
                return {"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts)}
            mean = mean_posteriors(known(texts), lengths, table, t)
            best = mean.argmax(axis=1)
            return {
                "lang_pred": [labels[b] if n else UNKNOWN for b, n in zip(best.tolist(), lengths.tolist())],
                "score": [float(min(1.0, m)) if n else 0.0 for m, n in zip(mean[np.arange(len(best)), best], lengths.tolist())],
            }

        return work

    return map_texts(docs, id_col, text_col, make, [field("lang_pred", "string"), field("score", "double")])

"""Encoding and decoding with a word-level byte-pair vocabulary, by a transducer lexicon and exact merging.

The corpus' most frequent words are counted over all documents, merged once, and compiled with their ids into a
minimal acyclic transducer. Tasks map that file into memory; a word in it costs one walk, any other word is
merged exactly by rank. The vocabulary file is a parameter and its normaliser, word pattern and special tokens
are read from it.

Defined cases: a null or empty text has no tokens and decodes to the empty text; characters without a token are
impossible, as the vocabulary holds every byte; equal texts and repeated rows encode alike; an empty table gives an
empty result. Texts are encoded whole, in memory of their own size. The memo of unseen words is emptied when
it holds ``MEMO`` words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
import uuid
from collections import Counter

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import transducer
from .common import checkpointed, field, map_texts, slices, texts_of

#: At most so many words enter the lexicon; it bounds what reaches the driver and each task.
LEXICON_WORDS = 50_000
#: Rarer words never enter it.
LEAST_COUNT = 3
#: Words that a task holds before it hands on its counts, and words that it remembers while encoding.
COUNT_WORDS = 400_000
MEMO = 400_000
UNRANKED = 1 << 30
#: Words of more letters are merged by a heap, whose cost grows with the word and not with its square.
LONG = 64


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: printable Latin-1 bytes stand for themselves, the
    others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def normal(text: str) -> str:
    """Composed, and lower-cased letter by letter."""
    text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else "".join(map(str.lower, text))


class Vocabulary:
    """A tokenizer file of this kind: what is needed to split, merge and decode."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        steps = [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or steps != ["Split", "ByteLevel"] or spec["decoder"] is not None:
            raise ValueError(f"not a word-level byte-pair vocabulary: {path}")
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.letters = {b: c for b, c in byte_letters().items()}

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the leftmost pair of least rank is joined until no pair has a rank."""
        parts = [self.letters[b] for b in word]
        parts[-1] += self.end
        if len(parts) > LONG:
            return [self.ids[p] for p in self.merge_long(parts)]
        rank = self.ranks.get
        order = [rank(pair, UNRANKED) for pair in zip(parts, parts[1:])]
        while order and (least := min(order)) < UNRANKED:
            i = order.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del order[i]
            if i:
                order[i - 1] = rank((parts[i - 1], parts[i]), UNRANKED)
            if i < len(order):
                order[i] = rank((parts[i], parts[i + 1]), UNRANKED)
        return [self.ids[p] for p in parts]

    def merge_long(self, parts: list[str]) -> list[str]:
        """The same merges for a word of many letters: a heap of ranked pairs over linked parts, where a pair that has
        changed since it was pushed is passed over."""
        rank = self.ranks.get
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live: list[str | None] = list(parts)
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if live[i] != a or j >= n or live[j] != b:
                continue
            live[i], live[j] = a + b, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (r := rank((live[left], live[right]))) is not None:
                    heapq.heappush(heap, (r, left, live[left], live[right]))
        return [p for p in live if p is not None]

    def splitter(self):
        """A function from a text to its words; special tokens come out as their id."""
        words = regex.compile(self.pattern).findall
        special = self.special
        around = regex.compile("(" + "|".join(regex.escape(s) for s in special) + ")").split
        marks = tuple(special)

        def plain(text: str) -> list[str]:
            return words(normal(text))

        def split(text: str) -> list:
            if not any(m in text for m in marks):
                return plain(text)
            out: list = []
            for piece in around(text):
                if piece in special:
                    out.append(special[piece])
                elif piece:
                    out.extend(plain(piece))
            return out

        return split


def word_counts(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents; each task adds up its own words before the shuffle."""

    def run(batches):
        encoder = Encoder(vocabulary, None)
        pieces, words = Counter(), Counter()

        def counted() -> pa.RecordBatch:
            for piece, n in pieces.items():
                for w in encoder.pattern(piece):
                    words[w] += n
            out = _counts(words)
            pieces.clear()
            words.clear()
            return out

        for batch in batches:
            for part in slices(batch, 0):
                for text in texts_of(part, 0):
                    if not text:
                        continue
                    if encoder.odd(text):
                        words.update(w for w in encoder.split(text) if w.__class__ is str)
                    else:
                        pieces.update(normal(text).split())
                if len(pieces) + len(words) > COUNT_WORDS:
                    yield counted()
        yield counted()

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _counts(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])


def compile_lexicon(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", size: int = LEXICON_WORDS) -> bytes:
    """The transducer block of the most frequent words: all that occur at least ``c`` times, for the smallest
    ``c`` that leaves ``size`` words or fewer."""
    counts = checkpointed(word_counts(docs, vocabulary, text_col).where(F.col("n") >= LEAST_COUNT))
    steps = counts.groupBy("n").agg(F.count("*").alias("words"))
    # 64 steps per doubling: a few thousand rows at any corpus size
    above = steps.groupBy(F.floor(F.log2("n") * 64).alias("step")).agg(F.sum("words").alias("words"), F.min("n").alias("n")).orderBy(F.desc("step")).collect()
    least, total = None, 0
    for row in above:
        total += row.words
        if total > size:
            break
        least = row.n
    if least is None:
        return transducer.build({})
    words = counts.where(F.col("n") >= least).select("word").toLocalIterator()
    return transducer.build({r.word.encode(): vocabulary.merge(r.word.encode()) for r in words})


def ship(spark: SparkSession, block: bytes) -> str:
    """Hand the block to every executor as a file of Spark's own; executors that join later fetch it too."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    folder = os.path.join(SparkFiles.getRootDirectory(), f"from-driver-{os.getpid()}")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(block)
    spark.sparkContext.addFile(path)
    return name


class Encoder:
    """A task's encoder: mapped lexicon first, exact merges for the rest, bounded memos before both.

    No word of the pattern holds white space, so a text is cut at white space first and only pieces that aren't
    words already seen go through the pattern. Texts with special tokens, or with separators that only Python
    takes for white space, are split by the pattern alone."""

    def __init__(self, vocabulary: Vocabulary, lexicon: transducer.Lexicon | None) -> None:
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.split = vocabulary.splitter()
        self.pattern = regex.compile(vocabulary.pattern).findall
        self.odd = regex.compile("[\x1c-\x1f]|" + "|".join(map(regex.escape, vocabulary.special))).search
        self.words: dict = {}

    def word(self, word) -> tuple[int, str, str]:
        """(number of ids, ids, tokens), the last two joined by spaces."""
        if word.__class__ is int:
            return 1, str(word), self.vocabulary.tokens[word]
        data = word.encode()
        ids = self.lexicon.get(data)
        if ids is None:
            ids = self.vocabulary.merge(data)
        if len(self.words) >= MEMO:
            self.words.clear()
        found = self.words[word] = (len(ids), " ".join(map(str, ids)), " ".join(map(self.vocabulary.tokens.__getitem__, ids)))
        return found

    def encode(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids, decoded text) of a whole text."""
        get, make = self.words.get, self.word
        if self.odd(text):
            rows = [get(w) or make(w) for w in self.split(text)]
        else:
            rows, pattern = [], self.pattern
            add = rows.append
            for piece in normal(text).split():
                found = get(piece)
                if found is None:
                    for w in pattern(piece):
                        add(get(w) or make(w))
                else:
                    add(found)
        if not rows:
            return 0, "", ""
        sizes, ids, tokens = zip(*rows)
        return sum(sizes), " ".join(ids), " ".join(tokens)


def _encoded(docs: DataFrame, id_col: str, text_col: str, path: str, size: int, make_rows, fields) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = Vocabulary(path)
    name = ship(spark, compile_lexicon(docs, vocabulary, text_col, size))
    shared = spark.sparkContext.broadcast(vocabulary)

    def make():
        encoder = Encoder(shared.value, transducer.Lexicon.open(SparkFiles.get(name)))

        def work(part: pa.RecordBatch) -> dict:
            return make_rows([encoder.encode(t or "") for t in texts_of(part, 1)])

        return work

    return map_texts(docs, id_col, text_col, make, fields)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = LEXICON_WORDS) -> DataFrame:
    """(id, ids, decoded): every text's ids and what they decode to."""

    def rows(found):
        return {"ids": [[int(x) for x in ids.split()] for _, ids, _ in found], "decoded": [d for _, _, d in found]}

    return _encoded(docs, id_col, text_col, path, size, rows, [field("ids", "array<int>"), field("decoded", "string")])


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = LEXICON_WORDS) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256)."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def rows(found):
        return {"n_tokens": [n for n, _, _ in found], "ids_sha256": [sha(i) for _, i, _ in found], "decoded_sha256": [sha(d) for _, _, d in found]}

    return _encoded(docs, id_col, text_col, path, size, rows, [field("n_tokens", "bigint"), field("ids_sha256", "string"), field("decoded_sha256", "string")])


def decode(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the tokens of an array of ids, joined by spaces; null counts as empty."""
    vocabulary = Vocabulary(path)
    shared = ids.sparkSession.sparkContext.broadcast(vocabulary.tokens)

    def run(batches):
        names = shared.value
        for batch in batches:
            out = [" ".join(names[i] for i in row or []) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=batch.schema.names[:1] + ["decoded"])

    kind = ids.schema[id_col].dataType.simpleString()
    return ids.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded string")

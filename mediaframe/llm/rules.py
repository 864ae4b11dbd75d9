"""Quality rules with a bitmask ledger.

Every rule is evaluated once per text. The ledger row keeps the measurements and one failure bit per rule;
policies are versioned masks over these bits, so changing a policy or asking what a rule contributes reads
the ledger and never the texts again.

Defined cases: a null or empty text has no words, measures zero everywhere and fails ``few_words``; equal
texts and repeated rows get equal ledger rows, one each; an empty table gives an empty ledger. Long texts
are measured whole, in memory of their own size.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, field, map_texts, slices

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
WINDOW = 8

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter", "n_upper", "n_letters"]

#: Rule of each bit, in the order of the bits: (name, failure as a condition on the measurements).
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    ("stutter", "100 * n_stutter > 40 * n_words"),
    ("shouting", "n_letters >= 50 and 2 * n_upper > n_letters"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: a text is rejected when any bit of the mask is set.
POLICIES = {
    "base-1": BIT["few_words"] | BIT["repeated_words"],
    "strict-1": sum(BIT.values()),
}
POLICY = "strict-1"


def measure(text: bytes, window: int = WINDOW) -> tuple[int, ...]:
    """The measurements of one UTF-8 text, in the order of ``MEASURES``."""
    words = text.split()
    n = len(words)
    packed = text.translate(None, SPACE)
    chars = len(packed) if packed.isascii() else len(packed.decode("utf-8", "replace"))
    symbols = len(packed) - len(packed.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip(SPACE)]
    n_upper = len(packed) - len(packed.translate(None, UPPER))
    n_letters = n_upper + len(packed) - len(packed.translate(None, LOWER))
    return n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeated(words, window), sum(map(eq, words, words[1:])), n_upper, n_letters


def repeated(words: list[bytes], window: int) -> int:
    """Words inside a window of ``window`` words that occurs twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    windows = [joined[a:b] for a, b in zip(starts[:n].tolist(), ends[window - 1 :].tolist())]
    if len(set(windows)) == n:
        return 0
    times = Counter(windows)
    twice = np.fromiter((times[w] > 1 for w in windows), bool, n)
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, measurements): one row per row of ``docs``."""

    def make():
        def work(part: pa.RecordBatch) -> dict:
            rows = [measure(b, window) for b in bytes_of(part, 1)]
            return dict(zip(MEASURES, map(list, zip(*rows)))) if rows else {m: [] for m in MEASURES}

        return work

    return map_texts(docs, id_col, text_col, make, [field(m, "bigint") for m in MEASURES])


def failed_bits(rules: list[tuple[str, str]] = RULES) -> Column:
    """The failure bits of a row of measurements."""
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, condition) in enumerate(rules)]
    out = bits[0]
    for bit in bits[1:]:
        out = out.bitwiseOR(bit)
    return out


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, failed): the ledger of ``docs``."""
    return measurements(docs, id_col, text_col).withColumn("failed", failed_bits())


def passes(policy: str = POLICY, failed: str = "failed") -> Column:
    """True where a ledger row breaks no rule of the policy."""
    return F.col(failed).bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(rows: DataFrame, policy: str = POLICY) -> DataFrame:
    """(rule, n_failed, n_only): texts that break each rule of the policy, and those which no other rule
    of it rejects, so dropping the rule would keep them. Rows are first counted per bit pattern, of which
    there are at most two to the number of rules."""
    mask = POLICIES[policy]
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    names = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items() if bit & mask))
    each = patterns.select("bits", "n", F.explode(names).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def with_failures(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs``, its columns named by position (c0, c1, ..), with the ledger's columns beside them. Rows are measured
    where they lie, so nothing is shuffled and repeated or null ids don't matter."""
    at = docs.columns.index(text_col)
    own = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    schema = T.StructType([*own.schema.fields, *(field(m, "bigint") for m in MEASURES)])

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                seen = zip(*(measure(b, window) for b in bytes_of(part, at)))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(m, pa.int64()) for m in seen)], names=schema.names)

    return own.mapInArrow(run, schema).withColumn("failed", failed_bits())


def clean(docs: DataFrame, text_col: str = "text", policy: str = POLICY, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with their columns, whose ledger entry passes the policy's mask."""
    names = docs.columns
    rows = with_failures(docs, text_col, window).where(passes(policy))
    return rows.select(*(f"c{i}" for i in range(len(names)))).toDF(*names)

"""The queries of this package by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, decontam, hosts, html, langid, packing, pii, quality, rules, search, secrets, simhash
from .common import table
from .oracles import ORACLES  # noqa: F401

QUERIES = {}


def vocabulary_path() -> str:
    """The installed word-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_vocabulary_path() -> str:
    """The installed byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; labels of held-out documents are never read."""
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = table(spark, sf_dir, "labels").where(~held)
    scored = quality.score(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document that contains it within the edit budget."""
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets, found by the combined automaton."""
    return secrets.digest(table(spark, sf_dir, "documents"))


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the word-level vocabulary."""
    return bpe.digest(table(spark, sf_dir, "documents"), vocabulary_path())


@query
def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ledger row, with the verdict of the current policy."""
    rows = rules.ledger(table(spark, sf_dir, "documents"))
    base = rules.passes("base-1")
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(*first, (~base).alias("base_failed"), (base & rules.passes()).alias("kept"), "failed", F.lit(rules.POLICY).alias("policy"))


@query
def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; the held-out quarter is never learned from."""
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = langid.predict(docs, docs.where(~held))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op9_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url's verdict by rule, or by its host's place in the link graph."""
    return hosts.judge(table(spark, sf_dir, "pages"))


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data and disclosing terms."""
    return pii.find(table(spark, sf_dir, "documents"))


@query
def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of the five filters, step by step, per language."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences."""
    return packing.digest(table(spark, sf_dir, "documents"), byte_vocabulary_path())

"""Personal data: exact patterns, and terms that the corpus shows to disclose them, in DataFrame functions only.

Patterns mark the protected entities (e-mail and network addresses, card and phone numbers). For every term of the
corpus the counts of documents with the term, and of those that also hold an entity of each kind, give the information
that the term carries about the kind, log2 P(kind | term) / P(kind); for every single entity that several texts share,
the same is counted for the terms that stand in its documents. A term is marked, in documents with entities, where its
certainty, its evidence (documents times bits, so that chance is ruled out) and its gain (bits as a part of all that could
be learned) exceed the disclosure thresholds. Sanitising replaces entities by their kind, generalises such terms, and
removes those that disclose almost surely.

Defined cases: null and empty texts have no spans and stay as they are; spans are in code points, end exclusive;
repeated rows get equal results, one row each, and count in the statistics, but give no evidence about a single entity; rows without id are handled like any other; an
empty table gives an empty result. Texts are matched whole, by patterns that take time in proportion to the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.session import shared_folder

from .common import checkpointed

#: (kind, pattern). Quantifiers are possessive and starts are tied down where that changes no match, so that
#: nothing is tried twice; the matches are those of the plain patterns.
PATTERNS = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
KINDS = [kind for kind, _ in PATTERNS]
TERM = r"\p{L}{2,}+"
#: Disclosure thresholds: share of certainty, bits of evidence against chance, part of the prior's information, and the
#: different texts that a single entity and a term must share.
CERTAIN = 0.8
EVIDENCE = 30.0
GAIN = 0.5
SUPPORT = 3
REMOVE = 0.98


def candidate(kind: str, text: Column) -> Column:
    """A cheap test that no text with a match fails."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]")
    return text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")


def digits(match: Column) -> Column:
    return F.regexp_replace(match, r"[^0-9]", "")


def luhn(number: Column) -> Column:
    """True where a string of digits has a right check digit."""
    places = F.sequence(F.lit(1), F.length(number))

    def value(i: Column) -> Column:
        d = F.substring(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(places, F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"(?:0++|0*+(?:[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5]))"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    return F.when(F.length(digits(match)).between(16, 19), luhn(digits(match))).otherwise(False)


def _valid(kind: str):
    return lambda x: valid(kind, x["m"])


def _span(kind: str):
    def span(x: Column) -> Column:
        entity = digits(x["m"]) if kind in ("card", "phone") else F.lower(x["m"])
        return F.struct(x["s"].alias("s"), (x["s"] + F.length(x["m"])).alias("e"), F.xxhash64(F.lit(kind), entity).alias("h"))

    return span


def located(text: Column, pattern: Column, wanted: Column) -> tuple[Column, Column]:
    """(matches, the pieces of text around them) where ``wanted``; else null."""
    return F.when(wanted, F.regexp_extract_all(text, pattern, F.lit(0))), F.when(wanted, F.split(text, pattern, -1))


def starts(matches: Column, pieces: Column) -> Column:
    """(s, m) of each match: its start in code points and its text."""
    lengths = F.zip_with(pieces, matches, lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0)))
    before = F.transform(matches, lambda m, i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, x: a + x) + F.length(F.get(pieces, i)))
    return F.zip_with(before, matches, lambda s, m: F.struct(s.alias("s"), m.alias("m")))


def with_entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one array (s, e, h) per kind: the spans and a hash of the entity, written plainly; null or empty
    where there is none."""
    out = docs
    for kind, pattern in PATTERNS:
        matches, pieces = located(F.col(text), F.lit(pattern), candidate(kind, F.col(text)))
        out = out.withColumns({f"__m_{kind}": matches, f"__p_{kind}": pieces})
    for kind in KINDS:
        found = F.filter(starts(F.col(f"__m_{kind}"), F.col(f"__p_{kind}")), _valid(kind))
        spans = F.transform(found, _span(kind))
        out = out.withColumn(kind, F.when(F.size(f"__m_{kind}") > 0, spans))
    return out.drop(*(f"__{x}_{k}" for k in KINDS for x in "mp"))


def has(kind: str) -> Column:
    return F.coalesce(F.size(kind) > 0, F.lit(False))


def protected() -> Column:
    out = has(KINDS[0])
    for kind in KINDS[1:]:
        out = out | has(kind)
    return out


def terms_of(text: Column) -> Column:
    """The distinct lower-cased terms of a text outside its entities."""
    bare = text
    for kind, pattern in PATTERNS:
        bare = F.when(candidate(kind, text), F.regexp_replace(bare, pattern, " ")).otherwise(bare)
    return F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(TERM), F.lit(0)))


def thresholds(joint: Column, n: Column, prior: Column, proof: Column) -> tuple[Column, Column, Column]:
    """(over the thresholds, bits, certainty) of a term in ``n`` documents, ``joint`` of them with what has ``prior``;
    ``proof`` counts what speaks for it. The certainty is the Laplace estimate of P(entity | term)."""
    sure = (joint + 1) / (n + 2)
    bits = F.log2(sure / prior)
    return (sure >= CERTAIN) & (proof * bits >= EVIDENCE) & (bits >= -GAIN * F.log2(prior)), bits, sure


def of_kinds(held: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(term, bits, kind, certainty) of the kinds that terms disclose."""
    found = []
    for k, prior in shares.items():
        over, bits, sure = thresholds(F.col(k), F.col("n"), F.lit(prior), F.col(k))
        found.append(F.when(over, F.struct("term", bits.alias("bits"), F.lit(k).alias("kind"), sure.alias("certainty"))))
    return held.select(F.explode(F.array_compact(F.array(*found))).alias("x")).select("x.*")


def of_entities(marked: DataFrame, held: DataFrame, total: int) -> DataFrame:
    """(term, bits, kind, certainty) of the terms ``held`` that disclose a single entity.

    Texts stand for their copies, by hash, with a count. Only entities of at least SUPPORT texts meet terms,
    and only terms that stand almost never without an entity, so a long list of addresses makes no pairs."""
    private = marked.where(protected())
    each = F.array_distinct(F.concat(*(F.transform(spans_of(k), _entity(k)) for k in KINDS)))
    owned = private.select(F.xxhash64("text").alias("h"), F.explode(each).alias("v")).groupBy("h", "v").agg(F.count("*").alias("m"))
    common = owned.groupBy("v").agg(F.count("*").alias("texts"), F.sum("m").alias("docs")).where(F.col("texts") >= SUPPORT)
    owned = owned.join(common, "v")
    words = private.select(F.xxhash64("text").alias("h"), F.explode(terms_of(F.col("text"))).alias("term")).join(held.select("term", "n"), "term").distinct()
    both = owned.join(words, "h").groupBy("term", "v").agg(F.count("*").alias("texts"), F.sum("m").alias("joint"), F.max("n").alias("n"), F.max("docs").alias("docs"))
    over, bits, sure = thresholds(F.col("joint"), F.col("n"), (F.col("docs") + 1) / F.lit(total + 2), F.col("texts"))
    return both.where((F.col("texts") >= SUPPORT) & over).select("term", bits.alias("bits"), F.col("v.kind").alias("kind"), sure.alias("certainty"))


def _entity(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["h"].alias("h"))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, whose size the plans that read it know."""
    path = f"{shared_folder(df.sparkSession)}/pii-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def disclosing(marked: DataFrame) -> DataFrame:
    """(term, kind, certainty): terms over the thresholds, from counts over all documents; of several disclosures of
    a term, the one it says most about."""
    flags = [has(k).cast("long").alias(f"__f_{k}") for k in KINDS]
    some = protected().cast("long").alias("__f")
    each = marked.select(F.explode(terms_of(F.col("text"))).alias("term"), some, *flags)
    counts = each.groupBy("term").agg(F.count("*").alias("n"), F.sum("__f").alias("some"), *(F.sum(f"__f_{k}").alias(k) for k in KINDS))
    # what holds of no entity at all holds of no kind and of no single one
    held = written(counts.where((F.col("some") + 1) / (F.col("n") + 2) >= CERTAIN))
    whole = marked.select(*flags).agg(F.count("*").alias("docs"), *(F.sum(f"__f_{k}").alias(f"all_{k}") for k in KINDS)).first()
    shares = {k: ((whole[f"all_{k}"] or 0) + 1) / (whole["docs"] + 2) for k in KINDS}
    found = of_kinds(held, shares).unionByName(of_entities(marked, held, whole["docs"]))
    best = found.groupBy("term").agg(F.max(F.struct("bits", "kind", "certainty")).alias("best"))
    return written(best.select("term", "best.kind", "best.certainty"))


KEY = ["__id", "__hash"]


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return with_entities(rows)


def with_terms(rows: DataFrame, removed: float | None = None) -> DataFrame:
    """Marked rows with ``terms``: the disclosing terms of each protected document. Only protected documents keep
    their text on the way. With ``removed``, terms of at least that certainty come in ``gone`` instead."""
    listed = disclosing(rows)
    named = rows.withColumn("__hash", F.xxhash64("text")).withColumn("text", F.when(protected(), F.col("text")))
    own = named.where(protected()).select(*KEY, F.explode(terms_of(F.col("text"))).alias("term")).distinct()
    gone = F.col("certainty") >= (2.0 if removed is None else removed)
    sets = own.join(listed, "term").groupBy(*KEY).agg(F.collect_set(F.when(~gone, F.col("term"))).alias("terms"), F.collect_set(F.when(gone, F.col("term"))).alias("gone"))
    sets = sets.select(F.col("__id").alias("__i"), F.col("__hash").alias("__h"), "terms", "gone")
    return named.join(sets, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h")), "left").drop("__i", "__h")


def term_pattern(terms: Column) -> Column:
    return F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(terms, "|"), F.lit(r")(?!\p{L})"))


def term_spans(text: Column, terms: Column) -> tuple[Column, Column]:
    return located(text, term_pattern(terms), F.coalesce(F.size(terms) > 0, F.lit(False)) & text.isNotNull())


def spans_of(kind: str) -> Column:
    return F.coalesce(F.col(kind), F.array().cast("array<struct<s:int,e:int,h:bigint>>"))


def span_texts(kind: str) -> Column:
    """kind:start:end of every span."""
    return F.transform(spans_of(kind), lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_<kind>.., base_sha256, spans): one row per row of ``docs``."""
    rows = with_terms(marked(docs, id_col, text_col))
    matches, pieces = term_spans(F.col("text"), F.col("terms"))
    rows = rows.withColumns({"__m": matches, "__p": pieces})
    within = F.transform(starts(F.col("__m"), F.col("__p")), _span("term"))
    rows = rows.withColumn("term", F.when(F.size("__m") > 0, within))
    base = F.concat(*map(spans_of, KINDS))
    rows = rows.withColumn("term", F.when(F.size("term") > 0, F.filter("term", lambda t: ~F.exists(base, lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))))
    listed = F.concat(*map(span_texts, KINDS))
    counts = [F.coalesce(F.when(F.size(k) > 0, F.size(k)), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select(
        F.col("__id").alias(id_col),
        *counts,
        F.sha2(F.array_join(listed, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(listed, span_texts("term")), ",").alias("spans"),
    )


def _named(kind: str):
    return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("k"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the same columns; entities replaced by their kind, disclosing terms generalised or removed.
    Texts without an entity are the same as before."""
    names = docs.columns
    rows = docs.select(*(F.col(c).alias(f"__c{i}") for i, c in enumerate(names)), F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_entities(rows)
    listed = checkpointed(disclosing(rows.select("text", *KINDS)))
    clean, held = rows.where(~protected()), rows.where(protected())
    hashed = held.withColumn("__hash", F.xxhash64("text"))
    own = hashed.select(*KEY, F.explode(terms_of(F.col("text"))).alias("term")).distinct()
    gone = F.col("certainty") >= REMOVE
    sets = own.join(listed, "term").groupBy(F.col("__id").alias("__i"), F.col("__hash").alias("__h")).agg(F.collect_set(F.when(~gone, F.col("term"))).alias("terms"), F.collect_set(F.when(gone, F.col("term"))).alias("gone"))
    held = hashed.join(sets, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h")), "left")
    spans = F.array_sort(F.concat(*(F.transform(spans_of(k), _named(k)) for k in KINDS)))
    held = held.withColumn("__spans", spans)
    # pieces between the entities, in order; an entity inside or across an earlier one is covered with it
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    cut = F.aggregate(
        "__spans",
        state,
        lambda a, x: F.when(x["s"] < a["at"], F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(x["e"].alias("at"), F.concat(a["out"], F.array(F.substring(F.col("text"), a["at"] + 1, x["s"] - a["at"]), F.concat(F.lit("["), F.upper(x["k"]), F.lit("]")))).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.array(F.substring(F.col("text"), a["at"] + 1, F.length("text")))),
    )
    # every second piece stands for an entity and stays as it is
    none = F.array().cast("array<string>")
    held = held.withColumns({"terms": F.coalesce("terms", none), "gone": F.coalesce("gone", none)})

    def replaced(piece: Column) -> Column:
        piece = F.when(F.size("terms") > 0, F.regexp_replace(piece, term_pattern(F.col("terms")), F.lit("[TERM]"))).otherwise(piece)
        return F.when(F.size("gone") > 0, F.regexp_replace(piece, term_pattern(F.col("gone")), F.lit(""))).otherwise(piece)

    held = held.withColumn("text", F.array_join(F.transform(cut, lambda piece, i: F.when(i % 2 == 0, replaced(piece)).otherwise(piece)), ""))
    out = held.select(*(F.col("text" if c == text_col else f"__c{i}").alias(c) for i, c in enumerate(names)))
    return out.unionByName(clean.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(names))))

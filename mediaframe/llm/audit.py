"""Filter interaction audit by the Hart-Mas-Colell potential.

Five filters may be applied in 120 orders. A text's failures are five bits; the removal game gives a coalition of
filters the number of texts that at least one of them removes. What a filter removes at its place in an order is a
difference of two coalitions, so all orders follow from the 32 coalition values of a part. The potential of a coalition
is (its value + the potentials without each of its members) / its size; a filter's Shapley value is the potential of all
filters minus the potential without it. 120 times a potential is whole, so everything stays in integers.

Defined cases: null texts count as empty; ``part`` is the given column as text, null as the empty string; a row is a
duplicate when a smaller id has the same text, so rows of the smallest id, repeated or not, are none, and rows without id
neither are duplicates nor make any; labels of one id are combined (1 if any is 1); ids without labels are neither good
nor toxic; an empty table gives an empty result. Texts are measured whole.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = "ABCDE"
ORDERS = 120
FULL = (1 << len(LETTERS)) - 1
WORD = r"[^\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """The bits of filters A to D for a text that isn't null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))

    def bits(w: Column) -> Column:
        tests = [F.size(w) < 100, 100 * F.size(F.array_distinct(w)) < 80 * F.size(w), 100 * upper.cast("long") > 10 * F.length(text), text.rlike(r"[#$%&*|]")]
        out = F.lit(0)
        for i, test in enumerate(tests):
            out = out.bitwiseOR(F.when(test, F.lit(1 << i)).otherwise(F.lit(0)))
        return out

    # words are listed once and read by both word tests
    return F.element_at(F.transform(F.array(words), bits), 1)


def failed_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): texts per part, failure bits and label.

    Only a digest of each text moves. Equal rows add up before the shuffle; which row is the first of its text is decided
    by a join on id and digest together, so a text with very many copies is spread over their ids."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failures(F.col("text")).alias("own"))
    rows = rows.groupBy("id", "part", "digest", "own").agg(F.count("*").alias("n"))
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    again = F.col("id").isNotNull() & F.col("first").isNull()
    rows = rows.join(first, ["id", "digest"], "left").select("id", "part", "n", F.col("own").bitwiseOR(F.when(again, F.lit(16)).otherwise(F.lit(0))).alias("mask"))
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = labels.select(F.col(id_col).alias("id"), "quality", "toxic").where("id is not null").groupBy("id").agg(flag("quality"), flag("toxic"))
    marked = rows.join(marks.where("quality or toxic"), "id", "left")
    seen = lambda c: F.coalesce(c, F.lit(False))
    return marked.groupBy("part", "mask", seen("quality").alias("good"), seen("toxic").alias("toxic")).agg(F.sum("n").alias("n"))


def coalition_values(counts: DataFrame) -> DataFrame:
    """(part, total, and one array of 32 values per game): element S + 1 is what coalition S removes. A part has at most
    128 rows of counts, four for each mask."""
    kind = {"removed": lambda c: F.lit(True), "good": lambda c: c["good"], "toxic": lambda c: c["toxic"]}
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("counts"))
    zero = F.lit(0).cast("long")

    def removed(s: Column, counted) -> Column:
        return F.aggregate("counts", zero, lambda sum_, c: sum_ + F.when(counted(c) & (c["mask"].bitwiseAND(s) != 0), c["n"]).otherwise(zero))

    def game(counted) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(FULL)), lambda s: removed(s, counted))

    return parts.select("part", "total", *(game(counted).alias(name) for name, counted in kind.items()))


def potentials(game: str = "removed") -> Column:
    """120 times the potential of each coalition, by recursion: a coalition's number is above those of its subsets."""
    members = F.array(*(F.lit(1 << i) for i in range(len(LETTERS))))

    def of(known: Column, s: Column) -> Column:
        own = F.filter(members, lambda bit: s.bitwiseAND(bit) != 0)
        smaller = F.aggregate(own, F.lit(0).cast("long"), lambda sum_, bit: sum_ + F.element_at(known, s - bit + 1))
        return F.call_function("div", ORDERS * F.element_at(game, s + 1) + smaller, F.size(own))

    return F.aggregate(F.sequence(F.lit(1), F.lit(FULL)), F.array(F.lit(0).cast("long")), lambda known, s: F.concat(known, F.array(of(known, s))))


def report(values: DataFrame) -> DataFrame:
    """One row per part, order and step."""
    orders = F.split(F.lit(" ".join(map("".join, permutations(LETTERS)))), " ")
    rows = values.withColumn("potential", potentials()).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    bits = F.transform(F.split("filter_order", ""), lambda x: F.call_function("shiftleft", F.lit(1), F.ascii(x) - ord(LETTERS[0])))
    rows = rows.withColumns({"bit": F.element_at(bits, F.col("step")), "before": F.aggregate(F.slice(bits, F.lit(1), F.col("step") - 1), F.lit(0), lambda a, x: a + x)})
    at = lambda name, s: F.element_at(name, s + 1)
    before, bit = F.col("before"), F.col("bit")
    after, rest = before.bitwiseOR(bit), F.lit(FULL).bitwiseXOR(bit)
    here = lambda name: at(name, after) - at(name, before)
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - at("removed", after)).alias("kept"),
        here("removed").alias("removed"),
        (at("removed", bit) - here("removed")).alias("redundant"),
        (at("removed", F.lit(FULL)) - at("removed", rest)).alias("unique_fails"),
        here("good").alias("good_lost"),
        here("toxic").alias("toxic_lost"),
        (at("potential", F.lit(FULL)) - at("potential", rest)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    return report(coalition_values(failed_masks(docs, labels, id_col, text_col, part_col)))

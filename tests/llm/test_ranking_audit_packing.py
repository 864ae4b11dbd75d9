"""Ranked search, filter audit and packing against brute force, the tokenizer library and the given rules."""

import math
import re
import zlib
from collections import Counter
from itertools import permutations, product

import numpy as np
import pytest
from tokenizers import Tokenizer

from mediaframe.llm import audit, oracles, packing, queries, search

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "Same words here"), (4, "Same words here"), (5, "Same words here"), (None, "no id, same words"), (None, "Same words here"), (6, "long Words " * 30_000), (7, "é ß 日本 😀 <|endoftext|> A#B")]
CLASH = "doc_id long, text string, lang string, source string, n_chars long, n long, bucket long, norm double, __n string, `offset` string, ids string, part string, mask long, id string, digest string, term string"


def table(spark, rows, langs=("en", None, "")):
    return spark.createDataFrame([(i, t, langs[k % len(langs)], "s", 3, 4, 5, 0.5, "x", "y", "z", "p", 1, "i", "d", "t") for k, (i, t) in enumerate(rows)], CLASH)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# --- ranked search -----------------------------------------------------------------------------------------


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_search(docs, items, top=10):
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags]
    n, total = sum(1 for b in bags if b[2]), sum(b[2] for b in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b, own in bags:
            m = 100 - 75 + (75 * own * n) // max(total, 1)
            score = 0
            for t in plain_terms(text):
                if t in b:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:top], 1)]
    return out


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_equals_brute_force(spark, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert found(queries.op11_search(spark, SF)) == sorted(plain_search(texts, items), key=str)


@pytest.mark.parametrize("block_terms", [4, search.BLOCK_TERMS])
def test_search_odd(spark, odd, block_terms):
    items = [("a", "same WORDS words"), ("b", "same WORDS words"), (None, "日本 😀"), ("c", None), ("d", "..."), ("e", "unheard"), ("f", "long a b é")]
    asked = spark.createDataFrame(items, "item_id string, text string")
    assert found(search.search(odd, asked, block_terms=block_terms)) == sorted(plain_search(ODD, items), key=str)
    assert search.search(odd.where("false"), asked).count() == 0
    assert search.search(odd, asked.where("false")).count() == 0


def test_bounds_prune_and_keep_the_best():
    rng = np.random.default_rng(3)
    terms = [f"t{i}" for i in range(900)]
    texts = [" ".join(rng.choice(terms, 20)).encode() for _ in range(8)]
    block = search.Block(texts)
    vectors = []
    for i in range(3000):
        size = int(rng.integers(1, 40))
        # a few vectors hold an item's own terms
        cols = block.columns[i % 8] if i % 100 == 0 else np.unique(rng.integers(0, len(block.terms), size))
        vectors.append((i, cols.astype(np.int32), rng.integers(1, 10_000, len(cols))))
    vectors.sort(key=lambda v: -float(np.square(v[2].astype(float)).sum()))
    finder = search.Searcher(block, 3, search.segments_of(np.arange(len(block.terms)), 64, 16), [1] * 8)
    scored = 0
    for at in range(0, len(vectors), 100):
        part = vectors[at : at + 100]
        norms = np.sqrt([float(np.square(v[2].astype(float)).sum()) for v in part])
        scored += finder.search(np.array([v[0] for v in part]), norms, [v[1].tobytes() for v in part], [v[2].astype(np.int64).tobytes() for v in part])
    assert scored < 3000 * 8 / 2
    for item in range(8):
        weights = dict(zip(block.columns[item].tolist(), block.repeats[item].tolist()))
        scores = sorted((-sum(int(x) * weights.get(int(c), 0) for c, x in zip(v[1], v[2])), v[0]) for v in vectors)
        assert list(zip((-finder.best[item].scores).tolist(), finder.best[item].ids.tolist())) == scores[:3]


# --- filter audit ------------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    masks = {}
    for i, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and least[t] < i]
        masks.setdefault(lang or "", []).append((i, {c for c, bad in zip("ABCDE", tests) if bad}))
    out = []
    for part, rows in masks.items():
        sums = Counter()
        steps = []
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                sums[f] += len(gone)
                all_fail = sum(f in r[1] for r in rows)
                steps.append((f, (part, "".join(order), step, len(left), len(gone), all_fail - len(gone), sum(r[1] == {f} for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone))))
        out += [(*row, sums[f]) for f, row in steps]
    return sorted(out)


def test_audit_equals_brute_force(spark, texts):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert sorted(map(tuple, queries.op12_audit(spark, SF).collect())) == plain_audit(docs, labels)


def test_audit_odd(spark, odd):
    labels = [(1, 1, 0), (4, 0, 1), (4, 1, None), (5, None, None), (None, 1, 1), (5, 1, 0)]
    marked = spark.createDataFrame([(*r, 9, "m") for r in labels], "doc_id long, quality int, toxic int, mask long, part string")
    docs = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    assert sorted(map(tuple, audit.audit(odd, marked).collect())) == plain_audit(docs, labels)
    assert len(audit.audit(odd, marked.where("false")).collect()) == 2 * 600
    assert audit.audit(odd.where("false"), marked).count() == 0


def test_potential_gives_shapley(spark):
    rng = np.random.default_rng(5)
    values = [0, *map(int, rng.integers(0, 10**12, 31))]
    row = spark.createDataFrame([(values,)], "removed array<long>").select(audit.potentials().alias("p")).first().p
    for i in range(5):
        total = 0
        for order in permutations(range(5)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += values[before | 1 << i] - values[before]
        assert row[31] - row[31 ^ 1 << i] == total


# --- packing -----------------------------------------------------------------------------------------------


def checked(rows, docs, capacity=2048):
    """Every rule of the packing; returns the number of sequences."""
    tokenizer = Tokenizer.from_file(queries.byte_vocabulary_path())
    want = Counter()
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        at, first = 0, len(ids) % capacity or capacity
        for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
            want[i, piece, at, end - at, zlib.crc32(np.array(ids[at:end], "<u4").tobytes())] += 1
            at = end
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_documents(spark, texts):
    rows = queries.op13_packing(spark, SF).collect()
    bound = packing.lower_bound(np.bincount([r.length for r in rows], minlength=2049))
    assert bound <= checked(rows, texts) <= bound + 1


def test_packing_odd(spark, odd):
    path = queries.byte_vocabulary_path()
    checked(packing.digest(odd, path).collect(), ODD)
    assert packing.digest(odd.where("false"), path).count() == 0


def test_vocabulary_equals_library():
    tokenizer = Tokenizer.from_file(queries.byte_vocabulary_path())
    enc = packing.encoding(queries.byte_vocabulary_path())
    for t in ["", "a<|endoftext|>b", "don't  stop\n\n  now ", "x" * 5000, "日本 😀 é́    ١٢", "\x00\x7f'LL 12,5%", " \t\n" * 300]:
        assert enc.encode(t, allowed_special="all") == tokenizer.encode(t, add_special_tokens=False).ids


def fewest(lengths, capacity):
    best = len(lengths)
    for plan in product(range(len(lengths)), repeat=len(lengths)):
        filled = Counter()
        for b, x in zip(plan, lengths):
            filled[b] += x
        if max(filled.values()) <= capacity:
            best = min(best, len(filled))
    return best


def test_bound_never_exceeds_the_optimum():
    rng = np.random.default_rng(7)
    tight = 0
    for _ in range(60):
        lengths = rng.integers(1, 20, int(rng.integers(1, 7)))
        bound, optimum = packing.lower_bound(np.bincount(lengths, minlength=21), 20), fewest(lengths.tolist(), 20)
        sequence, _ = packing.best_fit(lengths, 20)
        assert bound <= optimum <= len(set(sequence.tolist()))
        tight += bound == optimum
    assert tight > 50


def test_exchange_saves_sequences(spark):
    # single tasks of few pieces waste most of a sequence each; together they meet the bound
    lengths = [int(x) for x in np.random.default_rng(1).integers(1, 100, 2000)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    bound = packing.lower_bound(np.bincount(lengths, minlength=129), 128)
    alone = packing.pack(pieces, 128, task_pieces=40, rounds=0).select("sequence_id").distinct().count()
    together = packing.pack(pieces, 128, task_pieces=40).select("sequence_id").distinct().count()
    assert bound <= together < alone


def test_sequences_carry_their_ids(spark):
    pieces = spark.createDataFrame([(1, 0, bytearray(b"ab")), (1, 2, bytearray(b"c")), (2, 0, bytearray(b"d"))], "sequence_id long, offset long, ids binary")
    assert {(r.sequence_id, bytes(r.ids)) for r in packing.sequences(pieces).collect()} == {(1, b"abc"), (2, b"d")}


def test_sql_covers_what_it_can():
    assert {"op11_search", "op12_audit"} <= set(oracles.ORACLES) and "op13_packing" not in oracles.ORACLES

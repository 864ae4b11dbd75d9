"""The training-data operators against brute force, exact round trips and held-out labels."""

import hashlib
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from mediaframe.llm import automaton, bpe, decontam, hosts, html, langid, pii, quality, queries, rules, secrets, simhash, transducer

SF = "/root/testdata/sf0.001"

#: Nulls, empty, blank, ties, repeated rows, a very long text, and columns with clashing names.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "Same words here"), (4, "Same words here"), (5, "Same words here"), (None, "no id"), (6, "long " * 30_000), (7, "é ß 日本 😀 token=abcdef123")]
CLASH = "doc_id long, text string, fp long, spans string, failed long, score double, lang string, source string, n_chars long, word string, n long, key long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "x", 2, 0.5, "en", "s", 3, "w", 4, 5) for i, t in ODD], CLASH)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- main text ---------------------------------------------------------------------------------------------

PAGES = [
    (None, ""),
    ("", ""),
    ("<article><p>One &amp; two<br>three.</p><p>Four.</article>", "One & two three.\nFour."),
    ('<nav><a href="/x">Menu</a></nav><article><h1>T</h1><p>Para.</p></article><footer>&copy; me</footer>', "T\nPara."),
    ('<article><p>Hi there.<script>if(a<b){"</p>"}', "Hi there."),
    ('<main><p>Words of the text.</p><div class="cookie-notice"><p>We use cookies, as all pages do today.</p></div></main>', "Words of the text."),
    ('<article><p>Text.</p></article><section id="comments"><article><p>Nice post, I liked reading it.</p></article></section>', "Text."),
    ("<article><form><input><label>Mail</label></form><p>a < b &lt;i&gt;</p><aside>Side</aside></article>", "a < b <i>"),
    ("<article><ul><li>one item<li>two items</ul><table><tr><td>cell<td>cell</table></article>", "one item\ntwo items\ncell\ncell"),
    ('<div id="site-header"><p>Our site of many words, with a slogan.</p></div><article class="post"><p>Body.</p><div hidden>Not seen.</div><div style="display: none">Nor this.</div></article>', "Body."),
    ("<article><p>Cut off in <b>the mid", "Cut off in the mid"),
    ('<div class="layout has-sidebar"><nav>Menu</nav><article><h1>T</h1><p>Para.</p></article><div class="sidebar"><p>Aside text, as long as it may be.</p></div></div>', "T\nPara."),
    ('<article class="post comments-open category-advertising tag-search"><h1>T</h1><p>Para.</p></article>', "T\nPara."),
    ('<form id="page"><header><p>Site</p></header><article><h1>T</h1><p>Para.</p></article><div class="login"><label>Name of the user</label></div></form>', "T\nPara."),
    ('<article><p>One<svg viewBox="0 0 1 1"/> two.</p><math/><p>Three.</p><svg><text>No</text></svg></article>', "One two.\nThree."),
    ('<div class="sidebar-layout"><h1>T</h1><p>' + "A long paragraph of an article. " * 9 + "</p><nav>Menu</nav></div>", "T\n" + ("A long paragraph of an article. " * 9).strip()),
    ('<article><p>Text of it.</p><div class="comment-list"><p>' + "I liked it very much indeed. " * 20 + "</p></div></article>", "Text of it."),
    ('<article><p>Text of it.</p><div class="adSlot"><p>' + "Buy two of these, pay for one. " * 3 + '</p></div><p>More text.</p></article>', "Text of it.\nMore text."),
    ('<div class="overlay"><main><p>Body.</p></main></div>', "Body."),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_main_text(page, want):
    assert html.main_text(page) == want


def test_deep_pages_take_linear_time():
    page = "<div>text of a block" * 6000
    start = time.perf_counter()
    assert len(html.blocks(page)) == 6000
    assert time.perf_counter() - start < 1.0


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 7))
        root = html.Element("", None)
        parts = [html.Element("div", root), html.Element("div", root)]
        found = [html.Block("x", html.Element("p", parts[rng.integers(2)]), 0, float(np.round(rng.normal(), 2))) for i in range(n)]
        edges = Counter()
        parents = {}
        for i, b in enumerate(found):
            if i:
                edges[i - 1, i] += html.ADJACENT / (1 + html.distance(found[i - 1].place, b.place))
            last = parents.get(b.place.parent)
            if last is not None and last != i - 1:
                edges[last, i] += html.SIBLING
            parents[b.place.parent] = i

        def cost(good):
            own = sum(max(b.score, 0) if not g else max(-b.score, 0) for b, g in zip(found, good))
            return own + sum(w for (i, j), w in edges.items() if good[i] != good[j])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html.label(found)) == pytest.approx(best)


def test_extract_keeps_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "old"), (1, "u", None, "old"), (2, None, "<p>A text.", "old")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.url, r.text, r.n_chars) for r in html.extract(df).collect() if r.url) + [tuple(r) for r in html.extract(df).where("url is null").collect()]
    assert got == [(1, "u", "", 0), (1, "u", "", 0), (2, None, "A text.", 7)]
    assert html.extract(df.where("false")).collect() == []


# --- near-duplicates ---------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def plain_components(marks):
    parent = {i: i for i in marks}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(marks)
    for i in ids:
        for j in ids:
            if i < j and (marks[i] ^ marks[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_documents(spark, texts):
    got = rows(queries.op2_simhash(spark, SF))
    marks = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == marks
    assert all(len(r.fingerprint) == 16 for r in got.values())
    assert {i: r.component_id for i, r in got.items()} == plain_components(marks)


@pytest.mark.parametrize("tile", [8, simhash.TILE])
def test_links_connect_all_near_fingerprints(spark, tile):
    rng = np.random.default_rng(3)
    values = [int(x) for x in rng.integers(0, 1 << 63, 6)]
    for _ in range(300):
        values.append(values[int(rng.integers(len(values)))] ^ sum(1 << int(b) for b in rng.integers(0, 63, int(rng.integers(1, 6)))))
    values = sorted(set(values))
    want = plain_components({v: v for v in values})
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(nodes, tile=tile)).collect()}
    assert {v: got.get(v, v) for v in values} == want


def test_simhash_odd(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got if r.doc_id}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[3].component_id == 1
    assert by[4].component_id == by[5].component_id == 4
    assert simhash.near_duplicates(empty).collect() == []
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 6, 7]


def test_similar_texts_share_a_component(spark):
    """Near copies at 0.8 and more are found among unlike texts, whatever the tile."""
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    texts, groups = {}, {}
    for g in range(25):
        base = [word() for _ in range(200)]
        for c in range(6):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(len(copy)))] = word()
            texts[len(texts)], groups[len(groups)] = " ".join(copy), g
    for g in range(100, 140):
        texts[len(texts)], groups[len(groups)] = " ".join(word() for _ in range(60)), g
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    near = [(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for tile in (4, simhash.TILE):
        got = {r.doc_id: r.component_id for r in simhash.similar_components(df, tile=tile).collect()}
        assert np.mean([got[a] == got[b] for a, b in near]) > 0.99
        assert all(groups[i] == groups[c] for i, c in got.items())


def test_similar_texts_equal_exact_components(spark):
    """Copies with a block appended or words changed, around and under 0.8: the groups are those of brute force."""
    rng = np.random.default_rng(21)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    texts = []
    for size in (20, 60, 150, 400, 800):
        for wanted in (0.75, 0.79, 0.8, 0.805, 0.82, 0.84, 0.86, 0.9):
            base = [word() for _ in range(size)]
            more = int(round((size - 4) / wanted)) - (size - 4)
            edits = max(1, int(round((size - 4) * (1 - wanted) / (1 + wanted) / 5)))
            changed = list(base)
            for i in rng.choice(size, edits, replace=False):
                changed[i] = word()
            texts += [base, base + [word() for _ in range(more)], changed]
    # one common line at the end of many unlike texts, more than a tile of them
    line = [word() for _ in range(15)]
    texts += [[word() for _ in range(8)] + line for _ in range(30)]
    texts = dict(enumerate(map(" ".join, texts)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    root = {i: i for i in texts}
    near = 0
    for a in texts:
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                near += 1
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    assert near > 40
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for tile in (4, simhash.TILE):
        assert {r.doc_id: r.component_id for r in simhash.similar_components(df, tile=tile).collect()} == root


def test_one_of_each_group(spark):
    """Nulls, repeated ids and rows, clashing names and an empty table."""
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One  TWO"), (5, long), (5, long), (6, long + " end"), (7, long), (7, "other words than those of the others"), (None, long), (None, None), (8, "x" * 200_000)]
    names = "node long, size long, `keys` string, `__id` string, members string, c0 long, text_hash long, component_id long"
    df = spark.createDataFrame([(i, t, 1, 2, "k", "i", "m", 3, 4, 5) for i, t in rows], f"doc_id long, text string, {names}")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    want = [(1, None), (3, "one two"), (5, long), (7, "other words than those of the others"), (None, long), (None, None), (8, "x" * 200_000)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.keep_one(df.where("false")).collect() == []


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(4)
    ruled = 0
    for _ in range(400):
        n = int(rng.integers(1, 600))
        base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        share = rng.random()
        other = np.unique(np.concatenate((base[rng.random(len(base)) < share], rng.integers(0, 1 << 63, int(n * (1 - share)) + 1).astype(np.uint64))))
        common = len(np.intersect1d(base, other))
        similar = common >= 0.8 * (len(base) + len(other) - common)
        allowed = simhash.possible(*(simhash.unpacked(simhash.sketch(x)) for x in (base, other)), 0.8)
        assert allowed or not similar
        ruled += not allowed
    assert ruled > 200


def test_runs_deal_out_a_crowded_set(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RUN", 3)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base)] + [" ".join([*base, f"x{i}", f"y{i}"]) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in simhash.similar_components(df, tile=3).collect()} == {0}


def test_keys_over_batches():
    """Runs of a key over any cut into batches give the rows that are not alone, numbered."""
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 30, 60))
    nodes = np.arange(60) * 7
    want = [(k, n, n + 1, int(nodes[keys == k][0]), int(np.flatnonzero(nodes[keys == k] == n)[0])) for k, n in zip(keys.tolist(), nodes.tolist()) if (keys == k).sum() > 1]
    for size in (1, 2, 7, 60):
        whole = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes), pa.array(nodes + 1)], names=["key", "node", "place"])
        got = [tuple(r.values()) for b in simhash.shared_keys(whole.slice(i, size) for i in range(0, 60, size)) for r in b.to_pylist()]
        assert got == want


def test_fingerprints_offer_near_copies(spark):
    """What SimHash links is compared as sets: copies with a changed word join, texts with equal fingerprints alone don't."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows, want = [], {}
    for g in range(12):
        base = [word() for _ in range(500)]
        for c in range(3):
            rows.append((3 * g + c, " ".join([*base, *(f"x{c}" for _ in range(c))])))
    texts = dict(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bits = {i: simhash.fingerprint(t.encode()) for i, t in texts.items()}
    bits[35] = bits[2]  # a chance hit of unlike texts, one of which stands for both
    sets = {i: simhash.shingle_set(t.encode(), 5) for i, t in texts.items()}
    node = {i: simhash._node(s) for i, s in sets.items()}
    marked = spark.createDataFrame([(node[i], bits[i] - (1 << 64) if bits[i] >> 63 else bits[i]) for i in texts], "node long, fp long")
    least = spark.createDataFrame([(node[i], i) for i in texts], "node long, least_id long")
    found = simhash.Sets(df.toDF("__id", "__t"), least, 5, 0.8)
    near = {(min(node[a], node[b]), max(node[a], node[b])) for a in texts for b in texts if a < b and a // 3 == b // 3}
    got = {(r.u, r.v) for r in simhash.fingerprint_links(marked, found).collect()}
    assert got and got <= near
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(list(got), "u long, v long")).collect()}
    linked = {(a, b) for a in texts for b in texts if 2 < a < b < 35 and (bits[a] ^ bits[b]).bit_count() <= 4}
    assert linked and all(roots.get(node[a], node[a]) == roots.get(node[b], node[b]) for a, b in linked)


def test_sketches_rule_out_other_sizes():
    """A small set and a far larger one can't be similar, whatever their folded sketches say."""
    rng = np.random.default_rng(5)
    small, large = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (50, 4000))
    assert not simhash.possible(simhash.unpacked(simhash.sketch(small)), simhash.unpacked(simhash.sketch(large)), 0.8)


def test_keys_keep_rows_with_partners_only():
    rng = np.random.default_rng(3)
    size = rng.integers(5, 60, 400)
    rows = sorted({(int(rng.integers(0, 60)), (int(n) << 32) + int(rng.integers(0, n // 5 + 1)), i, int(rng.integers(0, 200))) for i, n in enumerate(size)})

    def fits(a, b):
        (x, y), (p, q) = (a[1] >> 32, b[1] >> 32), (a[1] & 0xFFFFFFFF, b[1] & 0xFFFFFFFF)
        return a[3] != b[3] and min(x, y) >= 0.8 * max(x, y) - 1e-9 and min(x - p, y - q) >= 0.8 / 1.8 * (x + y) - 1e-9

    want = [r for r in rows if any(fits(r, x) for x in rows if x[0] == r[0])]
    assert 0 < len(want) < len(rows)
    whole = pa.RecordBatch.from_pydict({"key": [r[0] for r in rows], "node": [r[2] for r in rows], "place": [r[1] for r in rows], "group": [r[3] for r in rows]})
    for cut in (1, 7, 400):
        for together in (1, 50, 1000):
            parts = lambda: (whole.slice(i, cut) for i in range(0, len(rows), cut))
            got = [(r["key"], r["place"], r["node"], r["group"]) for b in simhash.partnered(parts(), 0.8, together=together) for r in b.to_pylist()]
            assert got == want
            some = [(r["key"], r["place"], r["node"], r["group"]) for b in simhash.partnered(parts(), 0.8, most=4, together=together) for r in b.to_pylist()]
            assert len(some) == len(set(some)) and set(want) <= set(some) <= set(rows)
            assert all(r in some for r in rows if sum(x[0] == r[0] for x in rows) > 4)


def test_kept_texts_move_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = spark.createDataFrame([(i, f"text {i % 3} " * 9) for i in (0, 1, 2, 3, 3, 4)], "doc_id long, text string")
        kept = simhash.keep_one(df)
        assert len(re.findall(r"Exchange hashpartitioning\(__i#", kept._jdf.queryExecution().executedPlan().toString())) == 1
        assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_mixed_keys_over_batches():
    """Keys of one group go, those of several stay whole, over any cut into batches; runs too long to hold pass whole."""
    rng = np.random.default_rng(4)
    keys = np.sort(rng.integers(0, 25, 90))
    nodes, groups = np.arange(90) * 3, np.where(keys % 2 == 0, keys, rng.integers(100, 103, 90))
    mixed = {k for k in keys.tolist() if len(set(groups[keys == k].tolist())) > 1}
    whole = pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, nodes, nodes + 1, groups)], names=["key", "node", "place", "group"])
    for size in (1, 2, 7, 90):
        got = [r["node"] for b in simhash.mixed_keys(whole.slice(i, size) for i in range(0, 90, size)) for r in b.to_pylist()]
        assert got == [n for k, n in zip(keys.tolist(), nodes.tolist()) if k in mixed]
        some = [r["node"] for b in simhash.mixed_keys((whole.slice(i, size) for i in range(0, 90, size)), most=2) for r in b.to_pylist()]
        assert some == [n for k, n in zip(keys.tolist(), nodes.tolist()) if k in mixed or (keys == k).sum() > 2]


# --- quality ------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    found = queries.op3_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = [(r.quality, r.predicted) for r in found.where("held_out").join(labels, "doc_id").collect()]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found.collect()} == {True}


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (4, 1), (6, 0), (7, None), (99, 1)], "doc_id long, quality int")
    got = quality.score(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    none = quality.score(odd, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score(empty, labels).collect() == []


# --- decontamination ---------------------------------------------------------------------------------------


def edit_distance_inside(item, text):
    column = list(range(len(item) + 1))
    best = len(item)
    for c in text:
        new = [0]
        for i in range(1, len(item) + 1):
            new.append(min(column[i - 1] + (item[i - 1] != c), column[i] + 1, new[i - 1] + 1))
        column, best = new, min(best, new[-1])
    return best


def test_myers_against_dynamic_programme():
    rng = np.random.default_rng(5)
    for _ in range(500):
        item, text = rng.integers(1, 5, int(rng.integers(1, 10))).tolist(), rng.integers(0, 5, int(rng.integers(0, 25))).tolist()
        masks = {}
        for i, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << i
        end, distance = decontam.myers(masks, len(item), text)
        assert distance == edit_distance_inside(item, text)
        start, _ = decontam.backwards(masks, len(item), text[:end], distance)
        assert edit_distance_inside(item, text[start:end]) == distance


def test_decontamination_documents(spark, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.distance for r in queries.op4_decontamination(spark, SF).collect()}
    number = {}
    code = lambda t: [number.setdefault(w, len(number)) for w in decontam.words_of(t)]
    coded = {i: code(t) for i, t in items.items()}
    for d in list(texts)[:30] + [d for d, _ in got][:10]:
        text = code(texts[d])
        for i, item in coded.items():
            if len(set(item) & set(text)) * 2 < len(set(item)):
                continue
            distance = edit_distance_inside(item, text)
            assert got.get((d, i)) == (distance if distance <= decontam.budget(len(item), 0.8) else None)


def test_decontamination_near_and_odd(spark, odd, empty):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    near = "zero One two, three FOUR x six seven eight nine ten eleven y twelve thirteen fifteen. end"
    far = "one two three x four five x six seven x eight nine x ten eleven x twelve"
    df = spark.createDataFrame([(1, near), (2, far), (3, None), (1, near)], "doc_id long, text string")
    items = spark.createDataFrame([(9, item), (10, None), (11, ""), (12, item)], "item_id long, text string")
    got = sorted(tuple(r) for r in decontam.find(df, items).select("doc_id", "item_id", "distance", "first_word", "end_word").collect())
    assert got == [(1, 9, 3, 1, 16), (1, 9, 3, 1, 16), (1, 12, 3, 1, 16), (1, 12, 3, 1, 16)]
    assert sorted(r.doc_id for r in decontam.clean(df, items).collect()) == [2, 3]
    assert decontam.find(empty, items).collect() == [] and decontam.find(df, items.where("false")).collect() == []
    assert decontam.clean(odd, items).count() == len(ODD)


# --- secrets ------------------------------------------------------------------------------------------------

PLAIN = [
    ("assign", re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[1]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def plain_secrets(text):
    found = [(m.start(), n, k, m.end()) for n, (k, p, good) in enumerate(PLAIN) for m in p.finditer(text or "") if good(m)]
    return [(k, s, e) for s, _, k, e in sorted(found)]


@pytest.fixture(scope="module")
def runner():
    return automaton.Scanner(secrets.RULES).compiled()


def test_secrets_against_patterns(runner, texts):
    rng = np.random.default_rng(7)
    parts = ["token", "TOKEN", "=", ":", " ", '"', "'", "secret", "api_key", "é", "abc", "abcdef0123", "0123456789ab", "AKIA", "ABCDEF0123", "passwd", "password", " = ", "-", ".", "\n", "ß"]
    cases = ["".join(rng.choice(parts, int(rng.integers(0, 30)))) for _ in range(3000)] + list(texts.values())
    for text in cases:
        assert [s for s in secrets.spans(runner, text.encode()) if s[0] in secrets.BASE] == plain_secrets(text)


def test_secrets_query(spark, texts, odd, empty):
    got = rows(queries.op5_secrets(spark, SF))
    for i, t in texts.items():
        want = ",".join(f"{k}:{s}:{e}" for k, s, e in plain_secrets(t))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert got[i].n_hex == want.count("hex:")
    assert secrets.find_secrets(odd).where("doc_id = 7").first().spans == "assign:9:24"
    assert secrets.digest(odd).count() == len(ODD) and secrets.digest(empty).collect() == []


# --- encoding -----------------------------------------------------------------------------------------------


def test_bpe_equals_library(spark, texts, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    more = ["<|startoftext|> a<|endoftext|>b", "İstanbul ΣΑΣ", "a\x1cb\x85c", "it's 12.5% don't", "½ ²３ Ⅷ ßẞ", "日本語 😀", "", "%ͱfǞůgXΝíҢКӻ΃ÑĥЄғΎ1ӬǢǮ"]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    got = rows(bpe.encode(df, queries.vocabulary_path()))
    for i, t in list(texts.items()) + [(10_000 + i, t) for i, t in enumerate(more)]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == library.decode(ids, skip_special_tokens=False)
    back = rows(bpe.decode(bpe.encode(df, queries.vocabulary_path()), queries.vocabulary_path()))
    assert all(back[i].decoded == got[i].decoded for i in got)


def test_bpe_odd(odd, empty):
    got = bpe.digest(odd, queries.vocabulary_path())
    nothing = hashlib.sha256(b"").hexdigest()
    assert got.count() == len(ODD)
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.where("doc_id in (1, 2, 3)").collect()} == {(0, nothing, nothing)}
    assert bpe.digest(empty, queries.vocabulary_path()).collect() == []


def test_transducer(tmp_path):
    entries = {w.encode(): [i, -i] for i, w in enumerate("top tops stop stops tap taps é éa".split())} | {b"": [99]}
    block = transducer.build(entries)
    (tmp_path / "lexicon").write_bytes(block)
    lexicon = transducer.Lexicon.open(str(tmp_path / "lexicon"))
    assert all(lexicon.get(w) == o for w, o in entries.items())
    assert lexicon.get(b"to") is None and lexicon.get(b"topsy") is None
    assert lexicon.states < sum(map(len, entries))
    assert transducer.Lexicon(transducer.build({})).get(b"a") is None


# --- quality rules -----------------------------------------------------------------------------------------


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    inside = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_rules_documents(spark, texts):
    got = rows(queries.op7_rules(spark, SF))
    for i, t in texts.items():
        n, chars, symbols, lines, repeat = plain_measures(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeat)
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n) and not (r.base_failed and r.kept)


def test_rules_keep_good_documents(spark):
    found = queries.op7_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    good = found.where("quality = 1 and not base_failed")
    assert good.where("kept").count() >= 0.99 * good.count()
    assert found.where("quality = 0 and kept").count() <= 0.05 * found.where("quality = 0").count()


def test_ledger_policies(odd, empty):
    ledger = rules.ledger(odd)
    assert ledger.count() == len(ODD)
    kept = {r.doc_id: r.ok for r in ledger.select("doc_id", rules.passes("base-1").alias("ok")).collect()}
    assert not any(kept.values())
    counts = {r.rule: (r.n_failed, r.n_only) for r in rules.ablation(ledger).collect()}
    failed = [r.failed for r in ledger.collect()]
    for name, bit in rules.BIT.items():
        assert counts[name] == (sum(bool(f & bit) for f in failed), sum(f == bit for f in failed))
    assert rules.ledger(empty).collect() == [] and rules.clean(odd).columns == odd.columns and rules.clean(odd).collect() == []


def test_clean_follows_ledger(docs):
    kept = {r.doc_id for r in rules.ledger(docs).where(rules.passes()).collect()}
    assert {r.doc_id for r in rules.clean(docs).collect()} == kept


# --- languages ----------------------------------------------------------------------------------------------


def test_blocks_equal_plain_forward_backward():
    rng = np.random.default_rng(9)
    t, emissions = rng.random((3, 3)) + 0.1, rng.random((40, 3)) + 0.05
    lengths = np.array([1, 0, 5, 32, 33, 64, 100, 7])
    index = rng.integers(0, 40, lengths.sum())
    got = langid.mean_posteriors(index, lengths, emissions, t, block=8)
    at = 0
    for row, n in zip(got, lengths):
        if n:
            gamma, _ = langid.posteriors(emissions[index[at : at + n]][None], t)
            assert np.allclose(gamma[0].mean(axis=0), row)
        at += n


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = queries.op8_langid(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").collect()
    assert len(found) > 150 and np.mean([r.lang == r.lang_pred for r in found]) > 0.97


def test_languages_odd(odd, empty):
    learn = odd.withColumn("lang", F.when(F.col("doc_id") == 6, "xx").when(F.col("doc_id") == 4, "aa"))
    got = langid.predict(odd, learn).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}
    assert langid.predict(empty, learn).collect() == []


def test_languages_of_short_texts(spark):
    """A language with short texts only is predicted, and texts without letters take no place in the sample."""
    rng = np.random.default_rng(8)
    say = lambda letters, n: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))
    learn = [(i, say("abcde", 40), "aa") for i in range(30)] + [(100 + i, say("vwxyz", 3), "zz") for i in range(30)]
    learn += [(1000 + i, [None, "", "12 34"][i % 3], "zz") for i in range(300)]
    df = spark.createDataFrame(learn, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, say("abcde", 30)), (2, say("vwxyz", 30)), (3, say("vwxyz", 2))], "doc_id long, text string")
    got = rows(langid.predict(asked, df, size=20))
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["aa", "zz", "zz"]
    assert len(langid.sample(df, "doc_id", "text", "lang", 20)) == 40


# --- bounds and long inputs ----------------------------------------------------------------------------------


def test_samples_hold_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, "copied text here", "aa")] * 500 + [(2, "other words", "zz"), (1, "a text", "aa")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, quality int")
    assert quality.labelled_sample(docs, labels, "doc_id", "text", "quality") == [("a text", 1), ("other words", 0)]
    assert langid.sample(docs, "doc_id", "text", "lang") == [("a text", "aa"), ("other words", "zz")]


def test_long_words_merge_alike():
    vocabulary = bpe.Vocabulary(queries.vocabulary_path())
    rng = np.random.default_rng(11)
    for letters in ("ab", "aaaab", "theingation", "0123456789", "é日本x"):
        for n in (1, 2, 7, 40, 64):
            word = "".join(rng.choice(list(letters), n)).encode()
            parts = [vocabulary.letters[b] for b in word]
            parts[-1] += vocabulary.end
            assert [vocabulary.ids[p] for p in vocabulary.merge_long(parts)] == plain_merge(vocabulary, word)
    assert len(vocabulary.merge(b"ab" * 100_000)) > 0


def plain_merge(vocabulary, word):
    parts = [vocabulary.letters[b] for b in word]
    parts[-1] += vocabulary.end
    while True:
        ranked = [(vocabulary.ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in vocabulary.ranks]
        if not ranked:
            return [vocabulary.ids[p] for p in parts]
        _, i = min(ranked)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_item_ids_of_any_type(spark):
    text = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([("q-1", text), ("q-1", text + " more words at the end of it"), (None, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10")], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"before {text} after"), (2, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance, r.similarity) for r in decontam.find(docs, items).collect()}
    assert got >= {(1, "q-1", 0, 1.0), (2, None, 0, 1.0)}


# --- hosts --------------------------------------------------------------------------------------------------


def test_rules_and_hosts(spark, docs):
    pages = [
        (1, "http://bad.net/x", '<a href="https://good.org/">'),
        (2, "http://A.farm.com/x?y", '<a class=q href="http://bad.net/1"><a href=//bad.net/2>'),
        (3, "http://good.org/fr/", '<a href="http://friend.com">'),
        (4, "http://friend.com", None),
        (5, None, None),
        (6, "nohost", "x"),
        (7, "http://example.net/en/?q", ""),
        (8, "http://x.example.com/de/a#b", ""),
        (8, "http://x.example.com/de/a#b", ""),
        (9, "http://notexample.com/de/", ""),
        (10, "http://other.net", ""),
    ]
    df = spark.createDataFrame([(*p, "h", "v") for p in pages], "page_id long, url string, html string, host string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in hosts.judge(df).fillna("-", ["rule"]).collect())
    assert got == [
        (1, "bad.net", "/x", "net/", "block"),
        (2, "a.farm.com", "/x", "-", "block"),
        (3, "good.org", "/fr/", "org/fr/", "allow"),
        (4, "friend.com", "", "-", "allow"),
        (5, "", "", "-", "allow"),
        (6, "", "", "-", "allow"),
        (7, "example.net", "/en/", "example.net/en/", "allow"),
        (8, "x.example.com", "/de/a", "example.com/de/", "block"),
        (8, "x.example.com", "/de/a", "example.com/de/", "block"),
        (9, "notexample.com", "/de/", "-", "allow"),
        (10, "other.net", "", "-", "allow"),
    ]
    assert hosts.judge(df.where("false")).collect() == []


def test_propagation_equals_dense(spark):
    rng = np.random.default_rng(4)
    n = 12
    links = rng.integers(0, 3, (n, n)) * (rng.random((n, n)) < 0.3)
    np.fill_diagonal(links, 0)
    seed = rng.random(n) * (rng.random(n) < 0.4)
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", int(links[i, j])) for i in range(n) for j in range(n) if links[i, j]], "src string, dst string, n long")
    seeds = spark.createDataFrame([(f"h{i}", float(seed[i])) for i in range(n)], "host string, seed double")
    got = {r.host: r.score for r in hosts.propagated(seeds, edges).collect()}
    share = links / np.maximum(links.sum(axis=1, keepdims=True), 1)
    rank = seed.copy()
    for _ in range(hosts.ROUNDS):
        rank = seed + hosts.DAMPING * share.T @ rank
    assert all(got[f"h{i}"] == pytest.approx(rank[i]) for i in range(n))


def test_distrust_does_not_thin_out(spark):
    """Verdicts by the graph: few or many linkers of a blocked host, mixed links, trust against distrust; as the SQL."""
    link = lambda *to: " ".join(f'<a href="http://{x}/">' for x in to)
    pages = [(f"http://farm{i}.com/", link("spam.net")) for i in range(1000)] + [("http://two.com/", link("lone.net")), ("http://one.com/", link("lone.net"))]
    pages += [("http://mixed.com/", link("spam.net", "a.com", "b.com")), ("http://half.com/", link("spam.net", "a.com")), ("http://trusted.com/", link("spam.net"))]
    pages += [("http://good.org/fr/", link("trusted.com")), ("http://far.com/", link("farm1.com")), ("http://spam.net/", None), ("http://lone.net/", ""), ("http://a.com/", "")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.host: r.verdict for r in hosts.judge(df).collect()}
    assert all(got[f"farm{i}.com"] == "block" for i in range(1000)) and got["two.com"] == got["one.com"] == "block"
    assert got["mixed.com"] == got["a.com"] == got["trusted.com"] == got["far.com"] == "allow"
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    assert {r[1]: r[4] for r in con.execute(queries.ORACLES["op9_hosts"]).fetchall()} == got


# --- personal data ------------------------------------------------------------------------------------------


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


digits = lambda m: re.sub("[^0-9]", "", m)
PRIVATE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
]


def plain_private(text):
    return [(k, m.start(), m.end()) for k, p, good in PRIVATE for m in re.finditer(p, text or "") if good(m[0])]


def test_personal_data_against_patterns(spark, texts):
    rng = np.random.default_rng(5)
    parts = ["a", "b.c", "@", "x@y.z", ".", "+", "1", "22", "4111 1111 1111 1111", "4111-1111-1111-1111-110", " ", "-", "é", "😀", "(", "555", "0123", ".255", "256", "10.0.0.1", "%", "_", "\n", "+1 (706) 555-3138"]
    cases = [(i, "".join(rng.choice(parts, int(rng.integers(0, 25))))) for i in range(1500)]
    cases += [(2000, None), (2001, ""), (2002, "1" * 20_000), (2003, "a." * 10_000 + "@"), (2004, "x@" + "a." * 10_000 + "b")] + [(5000 + i, t) for i, t in texts.items()]
    got = rows(pii.find(spark.createDataFrame(cases, "doc_id long, text string")))
    for i, t in cases:
        want = plain_private(t)
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == x for x, _, _ in want) for k in pii.KINDS)
        assert got[i].spans.startswith(text)


def test_disclosing_terms(spark):
    cases = [(i, f"the courier word{i % 7} wrote to a{i}@b.org") for i in range(60)] + [(100 + i, f"the plain word{i % 7} here") for i in range(600)] + [(900, "courier without data")]
    df = spark.createDataFrame([(i, t.replace("word", "w" + "abcdefg"[i % 7])) for i, t in cases], "doc_id long, text string")
    found = {r.term for r in pii.disclosing(pii.marked(df, "doc_id", "text")).collect()}
    assert "courier" in found and "the" not in found and "plain" not in found
    got = rows(pii.find(df))
    assert "term:4:11" in got[0].spans and got[900].spans == "" and got[100].spans == ""
    clean = rows(pii.sanitise(df))
    assert "@" not in clean[0].text and "[EMAIL]" in clean[0].text and "courier" not in clean[0].text
    assert clean[900].text == "courier without data" and clean[100].text == dict(df.collect())[100]


def test_terms_of_one_entity(spark):
    """A name beside one address in ten texts is marked, with less support it isn't, and copies are no support."""
    filler = lambda i: " ".join("w" + "abcdefghij"[(i * k + k) % 10] * (1 + k % 3) for k in range(6))
    cases = [(i, f"{filler(i)} {'ab'[i % 2] * (i + 1)} zorblax at z@b.org") for i in range(10)]
    cases += [(100 + i, f"{filler(i)} {'cd'[i % 2] * (i + 1)} rarely at r@b.org") for i in range(2)] + [(200 + i, "copied words by c@b.org") for i in range(40)]
    cases += [(1000 + i, filler(i)) for i in range(3000)] + [(5000 + i, f"{filler(i)} mail k{'xyz'[i % 3] * (i % 20 + 1)} to u{i}@b.org") for i in range(300)]
    df = spark.createDataFrame(cases, "doc_id long, text string")
    kinds = {r.term: r.kind for r in pii.disclosing(pii.marked(df, "doc_id", "text")).collect()}
    assert kinds["zorblax"] == "email" and "rarely" not in kinds
    single = {r.term for r in pii.of_entities(pii.marked(df, "doc_id", "text"), df.sparkSession.createDataFrame([("zorblax", 10), ("copied", 40), ("rarely", 2)], "term string, n long"), len(cases)).collect()}
    assert single == {"zorblax"}
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = {r[0]: r[-1] for r in con.execute(queries.ORACLES["op10_pii"]).fetchall()}
    got = rows(pii.find(df))
    assert {i: got[i].spans for i in got} == want and "term:" in got[0].spans


def test_placeholders_stay(spark):
    """Terms are replaced between entities only: words like those that stand for entities are terms too."""
    rows = [(i, f"my phone is +49 30 10{i:05d} thanks") for i in range(200)] + [(1000 + i, "some plain words about nothing") for i in range(2000)]
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("[PHONE]" in out[i] and "[]" not in out[i] and "+49" not in out[i] for i in range(200))
    assert out[1000] == "some plain words about nothing"


def test_personal_data_odd(odd, empty):
    assert pii.find(odd).count() == len(ODD) and pii.find(empty).collect() == []
    out = pii.sanitise(odd)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))


# --- pipeline -----------------------------------------------------------------------------------------------


def test_pipeline(spark, docs, texts):
    import corpus_pipeline as pipeline

    named = dict(pipeline.STAGES)
    after = named["quality_rules"](spark, docs, SF)
    assert after.columns == docs.columns
    kept = {i: texts[i] for i in (r.doc_id for r in after.collect())}

    words = {i: t.encode().lower().split() for i, t in kept.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    root = {i: i for i in kept}
    for a in kept:
        for b in kept:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    after = named["near_duplicates"](spark, after, SF)
    left = {r.doc_id for r in after.collect()}
    assert left == set(root.values()) and len(left) < len(kept)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = {r.doc_id for r in decontam.find(after, items).collect()}
    clean = named["decontamination"](spark, after, SF)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == left - hit
    private = named["personal_data"](spark, clean, SF)
    assert private.columns == docs.columns
    for r in private.collect():
        assert (r.text == texts[r.doc_id]) == (not plain_private(texts[r.doc_id]))
        assert not [s for s in plain_private(r.text) if s[0] != "phone"]
    final = pipeline.run(spark, SF)
    assert {r.doc_id for r in final.collect()} == left - hit


# --- SQL ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    import check

    message, _, ok = check.compare(spark, check.connect(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert ok, message

"""The training-data operators against brute force, on small tables with every awkward case."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelattice.llm import common, decontaminate, extraction, jaccard, lines, packing, passages, phrases, quality, setjoin, sharding, suffixes, suffixtree
from tidelattice.llm import textvec as tv

WORDS = "the of and to in that it was for on are as with his they at be this from have".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "a", "b", "x"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    base = [text(rng, rng.randint(15, 120)) for _ in range(25)]
    passage = text(rng, 45)
    rows = [(i, t, "en") for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "en") for i in range(5)]  # copies
    rows += [(200 + i, base[i] + " tail", "en") for i in range(5)]  # near copies
    rows += [(300 + i, f"{text(rng, 20)}\n{passage}\n{text(rng, 20)}", "de") for i in range(4)]
    rows += [(400, None, "en"), (401, "", None), (402, "   \n\t ", "en"), (403, "word", "en"), (404, "É ñ ü 日本 " * 30, "fr"), (405, text(rng, 4000), "en"), (100, base[0], "en")]
    return spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_words int")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def nothing(docs):
    return docs.where("doc_id < -1")


def test_words_match_split():
    texts = ["", " a  b\n", "x", None, "é z \x0b\x0c q", "\n\n", "end "]
    for _, _, raw, offsets in tv.slices(pa.array(texts)):
        w = tv.Words(raw, offsets, lower=True)
        for i, t in enumerate(texts):
            own = range(w.first[i], w.first[i + 1])
            assert [bytes(w.raw[w.starts[k] : w.ends[k]]) for k in own] == (t or "").encode().lower().split()


def test_minimizers_take_the_first_least():
    rng = np.random.default_rng(0)
    for values in (rng.integers(0, 5, 500), rng.integers(0, 2**60, 500), np.zeros(200, np.int64)):
        h = values.astype(np.uint64)
        assert tv.minimizers(h, 7).tolist() == [i + int(np.argmin(h[i : i + 7])) for i in range(len(h) - 6)]


def test_squeeze():
    for x in (np.zeros(0, np.uint64), np.arange(1000, dtype=np.uint64), np.random.default_rng(1).integers(0, 2**63, 999).astype(np.uint64)):
        assert (tv.unsqueeze(tv.squeeze(x)) == x).all()


def test_flow_is_optimal():
    rng = random.Random(2)
    for _ in range(20):
        m, n = rng.randint(1, 3), rng.randint(1, 3)
        supply = [rng.randint(0, 3) for _ in range(m)]
        demand = sharding.equal_capacities(sum(supply), n)
        rng.shuffle(demand)
        cost = [[rng.randint(0, 5) for _ in range(n)] for _ in range(m)]
        flow = sharding.min_cost_flow(supply, demand, lambda i, j: cost[i][j])
        units = [i for i, s in enumerate(supply) for _ in range(s)]
        slots = [j for j, d in enumerate(demand) for _ in range(d)]
        best = min(sum(cost[i][j] for i, j in zip(units, p, strict=True)) for p in itertools.permutations(slots)) if len(units) <= 7 else None
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(m)] == supply
        if best is not None:
            assert sum(v * cost[i][j] for (i, j), v in flow.items()) == best


def test_reshard(spark, docs, tmp_path):
    out = sharding.reshard(docs, F.pmod("doc_id", F.lit(3)), 3, 4)
    rows = out.collect()
    assert len(rows) == docs.count()
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for j in range(4):
        own = [r for r in rows if r["shard"] == j]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 4) <= 2 * most
    want = Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows_of(docs))
    assert Counter((r["size"], r["text_crc32"]) for r in rows) == want
    assert sharding.reshard(nothing(docs), F.lit(0), 3, 4).count() == 0
    unique = docs.dropDuplicates(["doc_id"])
    layout = sharding.reshard(unique, F.pmod("doc_id", F.lit(3)), 3, 4)
    affected = sharding.rewrite(unique, layout, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == layout.where(F.col("shard").isin(affected)).count()


def test_best_boundaries():
    rng = random.Random(3)
    for _ in range(40):
        x = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        n = [rng.randint(1, 9) for _ in x]
        k = rng.randint(1, 4)
        ends, padding = packing.best_boundaries(x, n, k)
        pad = lambda e: sum(c * (min(b for b in e if b >= v) - v) for v, c in zip(x, n, strict=True))
        best = min(pad((*c, x[-1])) for r in range(k) for c in itertools.combinations(x[:-1], min(r, len(x) - 1)))
        assert padding == best == pad(ends) and len(ends) <= k


def test_pack(docs):
    rows = packing.pack(docs.withColumn("place", F.lit(1)), packing.word_count(), buckets=3, budget=500).collect()
    assert len(rows) == docs.count()
    for (_, _), own in itertools.groupby(sorted(rows, key=lambda r: (r["bucket"], r["batch"], r["place"])), key=lambda r: (r["bucket"], r["batch"])):
        own = list(own)
        assert [r["place"] for r in own] == list(range(len(own)))
        assert len(own) == 1 or len(own) * own[0]["padded_to"] <= 500
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len((t or "").encode().split()) for i, t in rows_of(docs)}
    assert packing.pack(nothing(docs), packing.word_count()).count() == 0


def test_odd_lengths_and_shards(spark):
    rows = spark.createDataFrame([(1, "a", None, 3), (2, None, 99, None), (None, "b" * 100, 1, 7), (2, "a", -1, 3)], "doc_id long, text string, shard int, n_tokens int")
    out = sharding.reshard(rows, F.col("shard"), 2, 3).collect()
    assert len(out) == 4 and {r["old_shard"] for r in out} == {0, 1}
    out = packing.pack(rows, F.col("n_tokens"), buckets=2, budget=10).collect()
    assert sorted(r["n_tokens"] for r in out) == [0, 3, 3, 7]


def test_quality(docs):
    rows = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, t in rows_of(docs):
        t = t or ""
        w = t.encode().split()
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        r = rows[i]
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), dup, len(cover))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality.judge(nothing(docs)).count() == 0


def test_kneser_ney_sums_to_one(spark):
    docs = spark.createDataFrame([(1, "abracadabra abba", "x"), (2, "cadabra bra", "x")], "doc_id long, text string, lang string")
    model = quality.fit(docs, order=3)
    chars = sorted(set("abracadabra abba cadabra bra"))
    for ctx in ("ab", "ra", "zz"):
        g = np.array([(ord(ctx[0]) << 24) | (ord(ctx[1]) << 12) | ord(c) for c in chars], np.uint64)
        p = 10.0 ** model.score(g, "x").astype(float)
        assert 0.5 < p.sum() <= 1 + 1e-5  # the rest is for characters not seen


def classes(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_jaccard(docs):
    for k, percent in ((3, 90), (5, 80)):
        sets = {}
        for i, t in rows_of(docs):
            w = (t or "").encode().lower().split()
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        want = classes(pairs, sets)
        got = {r["doc_id"]: r for r in jaccard.jaccard_classes(docs, k, percent).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert jaccard.jaccard_classes(nothing(docs), 3, 90).count() == 0


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)]
    want = classes(pairs, {x for p in pairs for x in p})
    got = common.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == want


def test_edit_distance():
    rng = random.Random(4)

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        assert lines.edit_distance(a, b) == slow(a, b)


def test_fuzzy_lines(spark):
    long_ = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{long_}\nshort\n\nkeep this line here"), (2, f"x y z w\n{long_.upper()}\nshort"), (3, None), (4, ""), (None, "x y z w"), (5, "x y z w\nlast")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_lines int")
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == ""
    assert got[3]["text"] is None and got[4]["text"] == "" and got[None]["text"] == "x y z w" and got[5]["text"] == "last"
    assert (got[2]["n_lines"], got[2]["n_removed"]) == (3, 3)
    assert lines.dedup_lines(nothing(docs)).count() == 0


def test_contamination(spark, docs):
    source = dict(rows_of(docs))
    items = [(1, source[3][:60]), (2, " ".join(source[300].split()[25:45])), (10, "word"), (11, None), (12, "..."), (13, "no such words anywhere else")]
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    words = lambda t: [x for x in "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split(" ") if x]
    for i, t in source.items():
        w, hit, found = words(t), set(), set()
        for item, u in items:
            v = words(u)
            n = min(13, len(v))
            for s in range(len(v) - n + 1) if n else ():
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == v[s : s + n]:
                        hit |= set(range(k, k + n))
                        found.add(str(item))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["item_ids"]) == (len(w), len(hit), sorted(found)), i
        assert got[i]["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert decontaminate.contamination(nothing(docs), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    # rows that repeat an id are searched each by itself, and those without one too
    odd = spark.createDataFrame([(7, "aa bb cc"), (7, "dd ee ff"), (None, "x aa bb cc dd"), (8, None)], "doc_id long, text string")
    out = decontaminate.contamination(odd, spark.createDataFrame([(1, "bb cc dd ee"), (2, "aa bb cc")], "item_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"]) for r in out.collect()) == [(0, 5, 3), (7, 3, 0), (7, 3, 3), (8, 0, 0)]
    empty = decontaminate.contamination(odd, spark.createDataFrame([], "item_id long, text string"))
    assert [r["n_hit"] for r in empty.collect()] == [0] * 4
    # a benchmark too large for a broadcast
    most, common.is_small.__defaults__ = common.is_small.__defaults__, (0,)
    try:
        shuffled = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    finally:
        common.is_small.__defaults__ = most
    assert {r["doc_id"]: r for r in shuffled} == got


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha one beta"), (2, "alpha one two three beta")], "doc_id long, text string")
    wins = decontaminate.windows(spark.createDataFrame([("a", "alpha x beta".replace("x", "one"))], "item_id string, text string"), 13)
    index = decontaminate.build_index(docs, wins.select(F.explode("terms").alias("term")))
    near = {(r["doc_id"], abs(r["shift"])) for r in decontaminate.proximity(index, wins, 4).collect()}
    assert (1, 0) in near and {d for d, _ in near} == {1, 2}


def test_phrases(docs):
    rows = sorted((i, t) for i, t in rows_of(docs.dropDuplicates(["doc_id"])))
    first, gone = {}, {i: set() for i, _ in rows}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - 19):
            if first.setdefault(tuple(w[k : k + 20]), (i, k)) != (i, k):
                gone[i] |= set(range(k, k + 20))
    got = {r["doc_id"]: r for r in phrases.drop_repeats(docs.dropDuplicates(["doc_id"])).collect()}
    for i, t in rows:
        w = (t or "").split()
        assert got[i]["kept"] == " ".join(x for k, x in enumerate(w) if k not in gone[i]) and got[i]["n_removed"] == len(gone[i])
    assert phrases.drop_repeats(nothing(docs)).count() == 0
    assert phrases.drop_repeats(docs).count() == docs.count()


def test_suffixes(docs):
    rows = sorted((i, (t or "").encode()) for i, t in rows_of(docs.dropDuplicates(["doc_id"])))
    seen, want = set(), {}
    for i, b in rows:
        cover = bytearray(len(b))
        for k in range(len(b) - 49):
            if b[k : k + 50] in seen:
                cover[k : k + 50] = b"\1" * 50
        seen |= {b[k : k + 50] for k in range(len(b) - 49)}
        want[i] = (sum(cover), sum(1 for k, c in enumerate(cover) if c and (k == 0 or not cover[k - 1])), hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest())
    got = suffixes.drop_repeats(docs.dropDuplicates(["doc_id"])).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got} == want
    assert suffixes.drop_repeats(nothing(docs)).count() == 0


def test_deep_shallow_sorts():
    rng = np.random.default_rng(6)
    buf = rng.integers(97, 99, 600).astype(np.uint8)
    buf[300:420] = buf[100:220]
    starts = np.arange(550)
    order, new = suffixes.deep_shallow(buf, starts, 50, shallow=8)
    strings = [buf[s : s + 50].tobytes() for s in starts[order].tolist()]
    assert strings == sorted(strings)
    assert new.tolist() == [True] + [a != b for a, b in itertools.pairwise(strings)]


def test_extraction(spark):
    nav = '<nav class="menu"><a href=/>Home</a></nav><div id="cookie-notice">We use cookies</div>'
    foot = '<div class="comments"><p>First!</p></div><footer>&copy; us</footer>'
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body>%s<article><h1>Head &amp; %s</h1><p>One <b>bo</b>ld\n  word<p>a &lt; b<br>c<ul><li>x<li>y</ul></article>%s</body></html>"
    rows = [(i, f"http://h.example/{i}", page % (nav, i, foot)) for i in range(6)] + [(10, None, None), (11, "x", ""), (12, "//q/1", "plain <i>te</i>xt"), (13, "u", "<div>only<div class=ad>buy</div> this</div>"), (14, "u", "<p>caf&eacute; &#x41; <!-- no --> 1 < 2")]
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")).collect()}
    assert len(got) == len(rows) and got[10] == "" and got[11] == ""
    assert got[12] == "plain text" and got[13] == "only this" and got[14] == "café A 1 < 2"
    big = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_bytes=0).collect()
    assert {r["page_id"]: r["text"] for r in big} == got
    # copies of one page on a host keep their article
    same = spark.createDataFrame([(i, "http://same.example/", page % (nav, 1, foot)) for i in range(6)], "page_id long, url string, html string")
    assert {r["text"] for r in extraction.extract(same).collect()} == {"Head & 1 One bold word a < b c x y"}
    assert got[3] == "Head & 3 One bold word a < b c x y"
    alone = extraction.main_text(page % (nav, 7, foot), [])
    assert alone == "Head & 7 One bold word a < b c x y"


def test_suffix_tree(spark, docs):
    got = {r["doc_id"]: r for r in suffixtree.score_texts(docs.dropDuplicates(["doc_id"])).collect()}
    rows = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in rows_of(docs)}
    train = Counter(x for i, w in rows.items() if zlib.crc32(str(i).encode()) % 10 for x in w)
    n, v = sum(train.values()), len(train)
    for i, w in rows.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(train[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r["score"] < 0
    assert suffixtree.score_texts(nothing(docs)).count() == 0


def tree_by_hand(rows, train, depth, bits):
    """Scores of texts by a suffix tree that is held whole."""
    texts = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in rows}
    counts, n, v = Counter(x for i, w in texts.items() if train(i) for x in w), 0, 0
    n, v = sum(counts.values()), len(counts)
    below = {i: [(counts[x] + 0.1) / (n + 0.1 * (v + 1)) for x in w] for i, w in texts.items()}
    seen = {(b"\n",): counts[b"\n"], **{(x,): c for x, c in counts.items()}}  # how often contexts stand in training texts
    trees = {}
    for d in range(1, depth + 1):
        nexts, cost = {}, Counter()
        ctx = {i: [tuple([b"\n", *w][k + 1 - d : k + 1]) if k >= d - 1 else None for k in range(len(w))] for i, w in texts.items()}
        for i, w in texts.items():
            for k, x in enumerate(w):
                if train(i) and ctx[i][k] is not None and seen.get(ctx[i][k], 0) >= 2:
                    nexts.setdefault(ctx[i][k], Counter())[x] += 1
                    cost[ctx[i][k]] += round(-math.log2(below[i][k]) * 1024)
        kept = {c: m for c, m in nexts.items() if m.total() >= 2 and cost[c] / 1024 + sum(y * math.log2(y / m.total()) for y in m.values()) >= bits * len(m)}
        trees[d] = kept
        for i, w in texts.items():
            for k, x in enumerate(w):
                if ctx[i][k] in kept:
                    m = kept[ctx[i][k]]
                    below[i][k] = max(m[x] - 0.75, 0) / m.total() + 0.75 * len(m) / m.total() * below[i][k]
        seen = {(*c, x): y for c, m in nexts.items() for x, y in m.items()}
    return {i: sum(map(math.log10, p)) for i, p in below.items()}, trees


def test_tree_equals_one_held_whole(docs):
    docs = docs.dropDuplicates(["doc_id"])
    train = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    for depth, bits in ((1, 2.0), (2, 2.0), (3, 0.5)):
        want, trees = tree_by_hand(rows_of(docs), train, depth, bits)
        got = {r["doc_id"]: r["score"] for r in suffixtree.score_texts(docs, depth=depth, bits=bits).collect()}
        assert got == pytest.approx(want, abs=1e-7)
        assert all(trees.values())


def test_tree_is_a_distribution():
    """After each context, the probabilities of all words seen and of the one that stands for the rest add up to one."""
    rows = [(1, "a b a b a c a b " * 9), (2, "b a c a b " * 5)]
    words = [b"a", b"b", b"c", b"\n", b"never"]
    _, trees = tree_by_hand(rows, lambda i: True, 2, 0.5)
    counts = Counter(x for _, t in rows for x in [*t.encode().split(), b"\n"])
    root = {x: (counts[x] + 0.1) / (sum(counts.values()) + 0.1 * (len(counts) + 1)) for x in words}
    p = {(): root}
    for d in (1, 2):
        for c, m in trees[d].items():
            up = p.get(c[1:], p[()])
            p[c] = {x: max(m[x] - 0.75, 0) / m.total() + 0.75 * len(m) / m.total() * up[x] for x in words}
    assert len(p) > 4 and all(sum(x.values()) == pytest.approx(1, abs=1e-9) for x in p.values())


def test_tree_beats_the_base_on_held_out_texts(spark):
    out = suffixtree.op10_suffix_tree(spark, "/root/testdata/sf0.01").where("held_out").collect()
    better = sum(r["score"] > r["base_score"] for r in out)
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) and better > 0.8 * len(out)


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    assert 0 < out.count() <= docs.count()
    assert set(corpus_pipeline.COLUMNS) <= set(out.columns)


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as cp

    rng = random.Random(58)
    one, two, three = (text(rng, 60) for _ in range(3))
    rows = [(None, one, "en", "s", 1), (5, two, "en", None, None), (5, three, None, "s", 1), (6, three + " tail", "en", "s", 1), (7, None, "en", "s", 1), (8, "", "en", "s", 1), (5, two, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sf = "/root/testdata/sf0.001"
    cp._LEFT.clear()
    first = cp.near_duplicates(spark, docs, sf)
    left = list(cp._LEFT)
    assert left and cp.packed(spark, first, sf).count() == 6  # what its input reads is still there
    cp.packed(spark, docs, sf)
    assert not set(left) & set(cp._LEFT)
    kept = cp.near_duplicates(spark, docs, sf).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(0, one), (5, two), (5, two), (5, three), (7, ""), (8, "")])
    assert cp.decontamination(spark, docs, sf).count() == len(rows)
    assert cp.quality_rules(spark, docs, sf).where("doc_id = 7 or doc_id = 8").count() == 0
    none = docs.where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_fuzzy_lines_find_every_similar_pair(spark):
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(60)]
    found = []
    for n in [4, 5, 5, 6, 8, 9, 10, 12, 15, 20, 30, 60] * 4:
        base = [rng.choice(vocab) for _ in range(n)]
        found.append(base)
        for _ in range(2):
            near = list(base)
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(near))
                near[k : k + 1] = rng.choice([[rng.choice(vocab)], [], [near[k], rng.choice(vocab)]])
            found.append(near)
    found = [list(x) for x in dict.fromkeys(map(tuple, found)) if len(x) >= 4]
    pairs = [(a, b) for (a, x), (b, y) in itertools.combinations(enumerate(found), 2) if 5 * lines.edit_distance(x, y) <= max(len(x), len(y))]
    want = classes(pairs, range(len(found)))
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(found)], "doc_id long, text string")
    got = {r["doc_id"] for r in lines.dedup_lines(docs).where("n_removed = 0").collect()}
    assert got == set(want.values()) and 40 < len(pairs)


def test_fuzzy_lines_group_short_lines(spark):
    docs = spark.createDataFrame([(1, "Menu\nshare this"), (2, "share  THIS\nmenu\nother"), (3, "menu x")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()}
    assert got == {1: "Menu\nshare this", 2: "other", 3: "menu x"}


def test_fuzzy_lines_one_fifth_shorter(spark):
    rows = []
    for n in (5, 10, 30, 100):
        w = [f"u{n}of{i}" for i in range(n)]
        rows += [(n, " ".join(w)), (n + 1, " ".join(w[: n - n // 5]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["n_removed"] for r in lines.dedup_lines(docs).orderBy("doc_id").collect()] == [0, 1] * 4


def test_bands_reject_what_base_rules_pass(spark):
    rng = random.Random(21)
    rows = [(i, text(rng, 120)) for i in range(60)]
    symbols = [(100 + i, " ".join(w + rng.choice(["&&&", "###", "$$$", "%%%"]) for w in text(rng, 120).split())) for i in range(12)]
    mash = [(200 + i, " ".join("".join(rng.choice("qxzjkvwpfy") for _ in range(6)) for _ in range(80))) for i in range(3)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame([(*r, "en") for r in rows + symbols + mash], "doc_id long, text string, lang string")).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert {i for i, r in got.items() if r["kept"]} == {i for i, _ in rows}
    spread = [(0.6 + i / 1000, "en", False) for i in range(100)]
    band = quality.bands(spark.createDataFrame(spread, "log10_ppl double, lang string, base_failed boolean"), 6.0, 0.35).first()
    assert 0.2 < band["low"] < 0.6 and 0.7 < band["high"] < 1.1


def test_model_tells_seen_from_unseen(spark, monkeypatch):
    rng = random.Random(22)
    docs = spark.createDataFrame([(i, text(rng, 80), "en") for i in range(8)], "doc_id long, text string, lang string")
    whole = quality.fit(docs)
    seen = {(k, n): set(t.keys.tolist()) for (k, n, _), t in whole.tables.items()}
    held = Counter(c for _, t, _ in docs.collect() for c in [t])
    grams_ = set()
    for t in held:
        raw = np.frombuffer(t.encode(), np.uint8)
        grams_ |= set(quality.packed(*quality.char_ids(raw, np.array([0, len(raw)])), 5).tolist())
    assert seen["p", 5] == grams_  # whole keys, none folded
    want = {r["doc_id"]: r["log10_ppl"] for r in quality.judge(docs).collect()}
    monkeypatch.setattr(common, "MODEL_ROWS", 500)
    got = {r["doc_id"]: r["log10_ppl"] for r in quality.judge(docs).collect()}
    assert got == pytest.approx(want, abs=1e-9)  # many lots score as one


def test_tree_splits(spark):
    """Which rows to learn from can be any condition, null ones are not learned from, and ids may repeat or be null."""
    rows = [(1, "a b a b", True), (1, "a b", None), (None, "a b a", True), (2, None, False), (3, "x" * 3_000_000 + " a b", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    out = suffixtree.score_texts(docs, F.col("train")).collect()
    assert len(out) == 5 and {r["train_tokens"] for r in out} == {9}
    none = suffixtree.score_texts(docs, F.lit(False)).collect()
    assert {round(r["score"] / r["n_tokens"], 9) for r in none} == {0.0}


def test_merge_skip():
    rng = random.Random(8)
    for _ in range(300):
        many = [sorted(rng.sample(range(30), rng.randint(0, 20))) for _ in range(rng.randint(1, 9))]
        need = rng.randint(1, 6)
        want = {x: n for x, n in Counter(v for x in many for v in x).items() if n >= need}
        assert dict(setjoin.merge_skip(many, need)) == want


def test_search_merges_and_probes():
    rng = random.Random(18)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(1, 40))), np.uint64) for _ in range(80)]
    index = setjoin.Index(sets)
    for x in sets:
        for least in (1, max(1, len(x) // 2), len(x)):
            ids, n = index.search(x, least)
            want = {i: len(np.intersect1d(x, y)) for i, y in enumerate(sets)}
            assert dict(zip(ids.tolist(), n.tolist(), strict=True)) == {i: c for i, c in want.items() if c >= least}
    side = np.arange(80) % 3 == 0
    for cell in (None, side):
        got = {(q, int(i)): int(c) for q, ids, n in setjoin.searches(sets, cell, lambda n: max(1, n // 2)) for i, c in zip(ids, n, strict=True)}
        want = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in range(80) for b in range(80) if (b > a if cell is None else side[a] and not side[b])}
        assert got == {p: c for p, c in want.items() if c >= max(1, len(sets[p[0]]) // 2)}


def test_jaccard_counts_links(spark, monkeypatch):
    rng = random.Random(28)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):  # near copies that drift, some of them equal, in blocks of eight
        t = list(base)
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(60)] = f"x{rng.randrange(5)}"
        rows.append((i, " ".join(t)))
    rows += [(7, " ".join(base)), (None, " ".join(base)), (None, "only null here now"), (90, None), (91, " \n"), (92, "two words"), (93, "TWO words"), (7, "another text of the same id")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    pairs = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    of = classes(pairs, range(len(rows)))
    least = {c: min((rows[i][0] for i in of if of[i] == c and rows[i][0] is not None), default=None) for c in of.values()}
    links = Counter(x for p in pairs for x in p)
    want = Counter((rows[i][0], len(sets[i]), rows[i][0] if not sets[i] else least[of[i]], links[i]) for i in of)
    for most in (256, 8):
        monkeypatch.setattr(setjoin, "BLOCK", most)
        got = jaccard.jaccard_classes(docs, 3, 90).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got) == want


def test_passages_survive_other_splits(spark, tmp_path, docs):
    """Scans that are cut otherwise from one job to the next, as when executors come or go, change no result."""
    rng = random.Random(38)
    passage = text(rng, 70)
    rows = [(i, f"{text(rng, 60)} {passage} {text(rng, 40)}") for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(9).write.parquet(str(tmp_path / "d"))
    key, was = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    for operator, column in ((phrases.drop_repeats, "kept"), (suffixes.drop_repeats, "kept")):
        got = []
        for sizes in (("100m", "100m"), ("100m", "2k"), ("2k", "100m")):
            spark.conf.set(key, sizes[0])
            out = operator(spark.read.parquet(str(tmp_path / "d")))
            spark.conf.set(key, sizes[1])
            got.append(Counter((r["doc_id"], r["n_removed"], bytes(r[column]) if column == "kept" and not isinstance(r[column], str) else r[column]) for r in out.collect()))
        spark.conf.set(key, was)
        assert got[0] == got[1] == got[2] and sum(n for _, n, _ in got[0]) > 1000


def test_automata_find_what_is_removed(spark, docs, monkeypatch):
    some = docs.dropDuplicates(["doc_id"])
    assert phrases.drop_repeats(some).agg(F.sum("n_removed")).first()[0] > 0
    x = phrases.Phrases(passages.Slice({"ids": np.zeros(1, np.int64).tobytes(), "there": np.ones(1, np.int64).tobytes(), "lens": np.array([119]).tobytes(), "text": pa.compress(" ".join(f"w{i:02d}" for i in range(30)).encode(), codec="zstd", asbytes=True)}), 20, 6)
    at = x.seed_places()
    spelled = {x.spelled(at[:1]).tobytes()}
    assert np.flatnonzero(x.located(spelled)).tolist() == [int(at[0])]
    assert not x.located(set()).any()


def test_extraction_by_template(spark):
    """A host whose elements have names that say nothing: only its template tells the article."""
    page = '<html><body><div class="a1">Welcome to the site %s<p>All rights are ours</p></div><div class="b2"><p>Story %s runs here with many words of its own.</p><p>Shared closing sentence of all stories.</p><div class="share">Tell a friend</div></div><div class="c3">Tail %s</div></body></html>'
    rows = [(i, f"http://plain.example/{i}", page % (i, i * 7, i)) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i * 7} runs here with many words of its own. Shared closing sentence of all stories." for i in range(8)}
    assert extraction.main_text(rows[0][2], []) != got[0]
    # what all articles of a host say is theirs
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>Title %s</h1><p>All opinions are the author's own and this sentence is part of the article.</p><p>Body %s</p></article><footer>End</footer></body></html>"
    rows = [(i, f"http://six.example/{i}", page % (i, i)) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i} All opinions are the author's own and this sentence is part of the article. Body {i}" for i in range(6)}


def test_template_classes_equal_brute_force(spark):
    rng = random.Random(48)
    rows = []
    for i in range(12):
        items = "".join(f"<li>{rng.choice('abc')}</li>" for _ in range(rng.randint(1, 4)))
        rows.append((i % 11, "http://h.example/", f"<body><div id=x>Top</div><ul>{items}</ul><p>text {i}</p><div>Foot</div></body>", i))
    pages = spark.createDataFrame([(i, "h", h, n) for i, _, h, n in rows], "page_id long, host string, html string, number long")
    known = extraction.templates(pages, 0.8, 5, 2).first()
    vectors = {}
    for k, (_, _, h, _) in enumerate(rows):
        for x, n in Counter(extraction.key_of(t) for t in extraction.parse(h)).items():
            vectors.setdefault(x, [0] * len(rows))[k] = n
    groups = {}
    for x, v in vectors.items():
        if sum(n > 0 for n in v) >= 0.8 * len(rows):
            groups.setdefault(tuple(v), set()).add(x)
    assert {frozenset(c) for c in known["classes"]} == {frozenset(g) for g in groups.values() if len(g) >= 2}


def test_lines_whole(spark):
    """The operator against brute force over all pairs of lines, on a table with nulls, repeats and clashing columns."""
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, "/root/testdata/sf0.001", "documents").limit(60).collect()]
    rows += [(None, rows[0][1]), (rows[1][0], "another text\nof the same id"), (9001, None), (9002, ""), (9003, "\n \n"), (9004, "a b c d e f g h i j\na b c d e f g h x y")]
    docs = spark.createDataFrame([(i, t, "g", 3) for i, t in rows], "doc_id long, text string, gone string, th int")
    forms, places = {}, []
    for r, (i, t) in enumerate(rows):
        for k, line in enumerate((t or "").split("\n")):
            w = tuple(line.encode().lower().split())
            if w:
                places.append((forms.setdefault(w, len(forms)), (-1 if i is None else i, r, k)))
    found = list(forms)
    pairs = []
    by_size = sorted(range(len(found)), key=lambda a: len(found[a]))
    for x, a in enumerate(by_size):
        for b in by_size[x + 1 :]:
            most = len(found[b]) // 5
            if len(found[b]) - len(found[a]) > most:
                break
            both = sum((Counter(found[a]) & Counter(found[b])).values())
            if len(found[b]) - both <= most and lines.edit_distance(found[a], found[b]) <= most:
                pairs.append((a, b))
    of = classes(pairs, range(len(found)))
    stay = {}
    for f, p in places:
        stay[of[f]] = min(stay.get(of[f], p), p)
    gone = Counter(p[1] for f, p in places if p != stay[of[f]])
    got = Counter((r["doc_id"], r["n_removed"], r["gone"], r["th"]) for r in lines.dedup_lines(docs).collect())
    assert got == Counter((i, gone[r], "g", 3) for r, (i, _) in enumerate(rows)) and len(pairs) > 0


def shuffle_files(spark) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return files.count("/shuffle_")


def test_stored_leaves_no_shuffle_files(spark):
    rows = spark.range(1000).groupBy(F.pmod(F.xxhash64("id"), F.lit(7)).alias("k")).count()
    common.sweep(spark)
    before = shuffle_files(spark)
    held = [common.stored(rows), common.stored_by(rows, "k")]
    assert shuffle_files(spark) <= before  # rows is still held
    assert [sum(r["count"] for r in x.collect()) for x in held] == [1000, 1000]


def test_score_reads_slices_without_a_shuffle(spark):
    docs = spark.createDataFrame([(i, f"a b c {i % 3} a b") for i in range(40)], "doc_id long, text string")
    out = suffixtree.score_texts(docs)
    assert out.count() == 40
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(slice") == 1  # the answers, not the texts


def test_small_arrays_are_packed_without_frames_of_their_own():
    # n slices send n buckets such arrays each: what one costs counts with the square of the input
    for x in ([5], [3, 0, 1], [-1, 7], list(range(1000)), [1 << 40, 2]):
        x = np.array(x, np.int64)
        packed = tv.squeeze(x)
        assert len(packed) <= 7 + 8 * len(x)
        assert (tv.unsqueeze(packed).view(np.int64) == x).all()
    assert len(tv.squeeze(np.array([5]))) == 8


def test_scoring_works_on_smaller_slices():
    rows = pa.array(["x" * 1000] * 4000)
    seen = [len(raw) for _, _, raw, _ in tv.slices(rows, quality.SCORE_BYTES)]
    assert sum(seen) == 4_000_000 and max(seen) <= quality.SCORE_BYTES < tv.SLICE


def test_lines_meet_by_runs_of_three_words(spark):
    # lines of one small vocabulary share their pairs of words, but hardly a run of three; what is similar meets nevertheless, at every length
    assert lines.tiers(0.8) == [(3, 6, 1 << 40), (2, 0, 5)]
    rng = random.Random(31)
    vocab = [f"v{i}" for i in range(30)]
    found = [[rng.choice(vocab) for _ in range(rng.randint(4, 40))] for _ in range(900)]
    for base in [[rng.choice(vocab) for _ in range(n)] for n in range(4, 41)]:
        for _ in range(3):
            near = list(base)
            for _ in range(max(1, len(base) // 5)):
                k = rng.randrange(len(near))
                near[k : k + 1] = rng.choice([[rng.choice(vocab)], [], [near[k], rng.choice(vocab)]])
            found.append(near)
        found.append(base)
    found = [list(x) for x in dict.fromkeys(map(tuple, found))]
    first = np.concatenate([[0], np.cumsum([len(x) for x in found])])
    words = tv.mix(np.array([int(w[1:]) for x in found for w in x], np.uint64))
    keys, line = lines.tiered_keys(words, first, np.zeros(len(words), np.uint64), 0.8)
    size = np.diff(first)
    least, kind = lines.least_keys(keys, size[line], 0.8), lines.length_class(size, 0.8)
    held = [{} for _ in found]
    for k, i, n in zip(keys.tolist(), line.tolist(), least.tolist(), strict=True):
        held[i].setdefault(k & 1, (n, set()))[1].add(k)

    def meet(a, b):
        return any(len(held[a][t][1] & held[b][t][1]) >= max(held[a][t][0], held[b][t][0]) for t in held[a].keys() & held[b].keys())

    near = [(a, b) for (a, x), (b, y) in itertools.combinations(enumerate(found), 2) if abs(len(x) - len(y)) <= max(len(x), len(y)) // 5 and 5 * lines.edit_distance(x, y) <= max(len(x), len(y))]
    assert len(near) > 100 and all(meet(a, b) and abs(kind[a] - kind[b]) <= 1 for a, b in near)
    assert kind.max() > 5
    # of the random ones, which pairs of words made meet by thousands
    long_ = [i for i in range(900) if len(found[i]) >= 10]
    assert sum(meet(a, b) for a, b in itertools.combinations(long_, 2)) < 50


def test_a_depth_reads_answers_without_a_shuffle(spark):
    docs = spark.createDataFrame([(i, True, f"a b c {i % 3} a b") for i in range(40)], "doc_id long, train boolean, text string")
    slices = suffixtree.coded(docs)
    made = len(common.MADE)
    answers = common.stored(suffixtree.word_counts(slices, 8)).drop("n", "v")
    first = sorted(map(str, answers.collect()))
    held = suffixtree.by_slice(answers, made)
    assert len(common.MADE) == made + 1 and sorted(map(str, held.collect())) == first
    plan = suffixtree.next_counts(slices, held, 240, 6, 1, 2.0, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(slice") == 0 and plan.count("Exchange hashpartitioning(bucket") == 1


def test_lines_of_a_common_key_are_counted_before_they_are_rows(spark):
    # lines that share a very common passage, in many groups: what a bucket finds grows with lines times groups and must not be a row each
    rng = random.Random(41)
    common_ = [f"c{i}" for i in range(30)]
    rows = []
    for g in range(12):
        own = [f"g{g}w{i}" for i in range(30)]
        for _ in range(6):
            near = list(own)
            near[rng.randrange(30)] = f"x{rng.random()}"
            rows.append(" ".join([*common_, *near] if g % 2 else [*near, *common_]))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("th", F.lit(0).cast("long"))
    slices = lines.line_slices(docs)
    met = lines.meeting(slices, lines.forms(slices, 4), np.zeros(1 << lines.SKETCH_BITS, np.uint64), 0.8, 4)
    _, key, (place, size, label) = lines.ps.unpacked(lines.labelled(met, 0.8).toPandas(), lines.MET)
    _, every, (at, _, _) = lines.ps.unpacked(met.toPandas(), lines.MET)
    assert 0 < len(key) < len(every) and set(place.tolist()) == set(at.tolist())
    members = lines.cells(met, 0.8, 4)
    held = [(r["cell"], r["id"], r["side"]) for r in members.collect()]
    assert len(held) == len(set(held)) and len({i for _, i, _ in held}) == len(rows)
    got = Counter(r["n_removed"] for r in lines.dedup_lines(docs.drop("th")).collect())
    assert got == Counter({0: 12, 1: 60})


def test_lines_leave_out_common_keys_and_still_meet():
    # two lines order their keys alike; each leaves out its last DROP, and of `least` that they share so many are left
    rng = random.Random(43)
    for _ in range(300):
        least = rng.randint(1, 8)
        shared = rng.sample(range(100), least)
        a, b = (sorted({*shared, *rng.sample(range(100), rng.randint(0, 20))}) for _ in range(2))
        out = least - int(lines.left(np.array([least]))[0])
        assert len(set(a[: len(a) - out]) & set(b[: len(b) - out])) >= least - out >= 1


def test_lines_within_some_edits():
    rng = random.Random(47)
    for _ in range(500):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 14))] for _ in range(2))
        if rng.random() < 0.5:
            b = a[: rng.randint(0, len(a))] + b[:2] + a[rng.randint(0, len(a)) :]
        for most in (0, 1, 3, 6):
            assert lines.within(np.array(a, np.uint64), np.array(b, np.uint64), most) == (lines.edit_distance(a, b) <= most)

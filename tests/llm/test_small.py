"""Each operator against SQL or brute force on small tables, with nulls, empty and very long texts, ties, repeats and clashing columns."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spillway.llm import chat, decontaminate, hot, language_id, mixing, ngram_join, pii, quality, sharding, substring_dedup, suffix_array, tokens

WORDS = [f"w{k}" for k in range(400)]


def prose(r, n, words=WORDS):
    return " ".join(r.choice(words) for _ in range(n))


def corpus(seed=1):
    """Documents with shared passages, near and exact copies, and every awkward case."""
    r = random.Random(seed)
    passage, other = prose(r, 70), prose(r, 55)
    base = prose(r, 120)
    near = base.split()
    near[60] = "changed"
    docs = [
        (1, prose(r, 40) + " " + passage + " " + prose(r, 30)), (2, prose(r, 10) + "  \n" + passage.replace(" ", "\t") + " " + prose(r, 5)), (3, base), (4, base), (5, " ".join(near)), (6, prose(r, 60)), (7, None), (8, ""), (9, "   \n"),
        (10, "a"), (11, "a b"), (12, "la " * 130), (13, other + " " + other), (14, prose(r, 30) + " " + other), (None, base), (15, "é ü 日本 " * 30), (16, prose(r, 49)), (17, prose(r, 49)), (3, base), (18, prose(r, 20_000) + " " + passage), (19, "x" * 100_000), (20, base + " " + prose(r, 4)),
    ]
    return docs


@pytest.fixture(scope="module")
def docs():
    return corpus()


# 2. Sharding

def test_sharding(table, duck, rows, docs):
    assert rows(sharding.shard(table(docs).sparkSession, table(docs))) == duck(sharding.SQL.format(docs="documents"), documents=docs)


def test_sharding_is_balanced(spark, table):
    r = random.Random(2)
    out = sharding.shard(spark, table([(k, prose(r, r.randint(1, 40))) for k in range(500)])).collect()
    by = {}
    for x in out:
        by[x.shard] = by.get(x.shard, 0) + x.n_bytes
    total, most = sum(by.values()), max(x.n_bytes for x in out)
    assert len(by) == 64 and all(abs(b - total / 64) <= most + 1 for b in by.values())
    assert [x.shard for x in sorted(out, key=lambda x: x.doc_id)] == sorted(x.shard for x in out)


def test_sharding_defined(spark, table):
    assert sharding.shard(spark, table([])).count() == 0
    assert {x.shard for x in sharding.shard(spark, table([(1, None), (2, "")])).collect()} == {0}


# 7. Mixing

def mixed_corpus():
    r = random.Random(3)
    out = [(k, prose(r, r.randint(1, 60)) + r.choice(["", " | x", " a@b", " 2024", " License"]), r.choice(["en", "en", "de", None]), r.choice(["a", "a", "a", "b", None])) for k in range(300)]
    return out + [(5, "again", "en", "a"), (None, "null id", "en", "a"), (900, None, "en", "a"), (901, "", "xx", "zz")]


def test_mixing_equals_sql(spark, table, duck, rows):
    docs = mixed_corpus()
    assert rows(mixing.mix(spark, table(docs))) == duck(mixing.SQL.format(docs="documents"), documents=docs)


def test_raking_meets_marginals():
    import pandas as pd

    r = np.random.default_rng(1)
    cells = pd.DataFrame([(s, la, t, float(r.integers(10, 500))) for s in "abc" for la in "xy" for t in "pq"], columns=["source", "lang", "topic", "tokens"])
    w = mixing.rake(cells, {"lang": {"x": 3, "y": 1}}, 0.5, 60)
    total = cells.tokens.sum()
    for axis, goal in (("lang", {"x": 0.75 * total, "y": 0.25 * total}), ("source", None)):
        got = pd.Series(w).groupby(cells[axis]).sum()
        want = goal or (cells.groupby(axis).tokens.sum() ** 0.5).pipe(lambda g: g * total / g.sum()).to_dict()
        assert all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)
    factor, p = mixing.probabilities(cells.tokens.to_numpy(), w, 0.4)
    assert (p * cells.tokens).sum() == pytest.approx(0.4 * total) and p.max() <= 1
    np.testing.assert_allclose(p[p < 1] / factor[p < 1], (p[p < 1] / factor[p < 1])[0])


def test_mixing_defined(spark, table):
    assert mixing.mix(spark, table([])).count() == 0 and mixing.sample(spark, table([])).count() == 0
    t = table(mixed_corpus())
    kept = mixing.sample(spark, t)
    drawn = [(x.doc_id, x.source, x.lang, x.tokens) for x in mixing.mix(spark, t).collect() if x.sampled]
    name = lambda s: mixing.NULL if s is None else s
    assert kept.columns == t.columns and sorted(map(str, drawn)) == sorted(str((x.doc_id, name(x.source), name(x.lang), len((x.text or "").split()))) for x in kept.collect())
    long = t.unionByName(table([(7000, "word " * 200_000, "en", "a")]))
    assert {x.doc_id: x.tokens for x in mixing.mix(spark, long).collect()}[7000] == 200_000
    by = {x.topic for x in mixing.mix(spark, t, topics=F.substring("text", 1, 1)).collect()}
    assert mixing.NULL in by and "w" in by and mixing.sample(spark, t, share=1.0, alpha=1.0, topics=F.lit("one")).count() == t.count()


# 9. Decontamination

def leaky():
    r = random.Random(4)
    bench = [(1, prose(r, 30)), (2, prose(r, 7)), (3, "Too short"), (4, None), (5, ""), (6, prose(r, 13) + "!"), (6, prose(r, 13)), (7, "Ünï " + prose(r, 15)), (8, "Quux!"), (None, "a null item of five words")]
    docs = [(k, prose(r, 50)) for k in range(20)] + [
        (20, prose(r, 20) + " " + bench[0][1].upper() + " " + prose(r, 5)), (21, " ".join(bench[0][1].split()[5:20])), (22, bench[1][1]), (23, bench[1][1].replace(" ", ", ")), (24, " ".join(bench[0][1].split()[:12])), (25, "a" + bench[5][1]),
        (26, bench[7][1]), (27, None), (28, ""), (None, bench[0][1]), (20, "other"), (29, prose(r, 30_000) + " " + bench[6][1]), (22, bench[1][1]), (30, "it is too short, quux"), (31, "quuxes are tooshort"), (20, bench[0][1]), (32, "A null item of five words"),
    ]
    return docs, bench


def bench_table(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "'clash' AS w", "'clash' AS s")


def test_decontamination_equals_sql(spark, table, duck, rows):
    docs, bench = leaky()
    want = duck(decontaminate.SQL.format(docs="documents", benchmark="benchmark"), documents=docs, benchmark=bench)
    assert rows(decontaminate.leaks(spark, table(docs), bench_table(spark, bench))) == want and len(want) >= 7
    old = decontaminate.STRINGS
    try:
        decontaminate.STRINGS = 5  # several passes
        assert rows(decontaminate.leaks(spark, table(docs), bench_table(spark, bench))) == want
    finally:
        decontaminate.STRINGS = old
    kept = decontaminate.without_leaks(spark, table(docs), bench_table(spark, bench))
    assert {dict(w)["item_id"]: dict(w)["item_words"] for w in want}.items() >= {2: 7, 3: 2, 8: 1}.items()
    plain = lambda s: " " + " ".join(re.findall(r"[^\W_]+", (s or "").lower())) + " "
    words_ = [plain(b[1]).split() for b in bench]
    strings = {f" {' '.join(w[i : i + 13])} " for w in words_ if len(w) >= 5 for i in range(max(1, len(w) - 12))}
    stay = [(d[0], d[1]) for d in docs if not any(s in plain(d[1]) for s in strings)]
    assert sorted((str(x.doc_id), str(x.text)) for x in kept.collect()) == sorted((str(a), str(b)) for a, b in stay) and len(stay) < len(docs) - 5


def test_decontamination_defined(spark, table):
    docs, bench = leaky()
    assert decontaminate.leaks(spark, table([]), bench_table(spark, bench)).count() == 0
    assert decontaminate.leaks(spark, table(docs), bench_table(spark, [])).count() == 0
    assert decontaminate.without_leaks(spark, table(docs), bench_table(spark, [(1, "x")])).count() == len(docs)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab ", min_size=2, max_size=9), min_size=1, max_size=8, unique=True), st.text("ab ", max_size=4000))
def test_wu_manber_against_find(strings, text):
    found = set()
    for search, of in decontaminate.searches([s.encode() for s in strings]):
        found |= {(a, of[i]) for a, i in search.find(np.frombuffer(text.encode(), np.uint8))}
    want = {(m.start(), k) for k, s in enumerate(strings) for m in re.finditer(f"(?={re.escape(s)})", text)}
    assert found == want


# 5. N-gram Jaccard join

def brute_links(docs, least=0.6):
    """Sorted (doc_id, class_id, links), and the (doc_id, text) that stay, by comparing all sets with all."""
    units = sorted({(d[0], d[1]) for d in docs if d[0] is not None and d[1] is not None})
    grams = {}
    for u in units:
        w = re.findall("[^ \t\n\r\f]+", u[1])
        if w:
            grams[u] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
    near = {a: [b for b in grams if b != a and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= least] for a in grams}
    head = {}
    for a in units:  # in order, so the first that is reached is the class's least
        stack = [a] if a in grams and a not in head else []
        while stack:
            x = stack.pop()
            if x not in head:
                head[x] = a
                stack += near[x]
    return sorted((a[0], head[a][0], len(near[a])) for a in grams if near[a]), sorted(u for u in units if head.get(u, u) == u)


def check_links(spark, t, docs):
    want, stay = brute_links(docs)
    assert sorted(tuple(x) for x in ngram_join.near_links(spark, t).collect()) == want
    kept = ngram_join.keep_one(spark, t)
    nulls = [("None", str(d[1])) for d in docs if d[0] is None]
    lost = {(str(d[0]), str(d[1])) for d in docs if d[0] is not None and d[1] is None}
    assert kept.columns == t.columns and sorted((str(x.doc_id), str(x.text)) for x in kept.collect()) == sorted([(str(a), b) for a, b in stay] + nulls + list(lost))
    return want


def test_near_links_equal_sql(spark, table, duck, rows, docs):
    want = duck(ngram_join.LINKS_SQL.format(docs="documents"), documents=docs)
    assert rows(ngram_join.near_links(spark, table(docs))) == want and len(want) >= 5


def test_near_links_and_kept(spark, table, docs):
    r = random.Random(5)
    chain = [prose(r, 200).split()]
    for k in range(6):  # each like the next, the ends unlike
        chain.append(chain[-1][:170 - 20 * k] + prose(r, 20).split() + chain[-1][190 - 20 * k:])
    many = docs + [(100 + k, " ".join(c)) for k, c in enumerate(chain)] + [(200 + k, prose(r, 3) + " " + docs[2][1]) for k in range(40)]
    assert len(check_links(spark, table(many), many)) > 45


def blocks(seed, n):
    """Copies of two bases that are like each other, changed little or much, so that blocks, rings and single sets meet at every distance."""
    r = random.Random(seed)
    one = prose(r, 150).split()
    two = one[:118] + prose(r, 32).split()
    out = []
    for k in range(n):
        w = list(r.choice([one, one, two]))
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 12])):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append((k, " ".join(w[: r.choice([150, 150, 140, 100])])))
    return out


@pytest.mark.parametrize(("most", "seed"), [(None, 21), (7, 22)])
def test_near_links_of_blocks(spark, table, most, seed):
    """All answers of large groups of near copies, taken whole and in chunks of lists, references and rings."""
    docs, old = blocks(seed, 90), (ngram_join.CHUNK, ngram_join.LIST, ngram_join.BLOCK)
    try:
        if most:
            ngram_join.CHUNK, ngram_join.LIST, ngram_join.BLOCK = most, most, 3
        want = check_links(spark, table(docs), docs)
    finally:
        ngram_join.CHUNK, ngram_join.LIST, ngram_join.BLOCK = old
    assert len(want) > 80 and len({x[2] for x in want}) > 5


def test_lists_in_blocks_lose_no_pair():
    """Every pair of a long list whose sizes and positions allow a link comes once, whole or from pairs of chunks."""
    r = np.random.default_rng(8)
    m = 300
    low = r.integers(1, 60, m)
    high, first = low + r.integers(0, 5, m), r.integers(0, 10, m) % low
    last = np.minimum(first + r.integers(0, 3, m), high - 1)
    want = set()
    for a in range(m):
        for b in range(a + 1, m):
            near = high[a] >= 0.6 * low[b] - 1e-6 and high[b] >= 0.6 * low[a] - 1e-6
            if near and min(last[a], last[b]) + min(high[a] - first[a], high[b] - first[b]) >= 0.375 * (low[a] + low[b]) - 1e-6:
                want.add((a, b))

    def pairs(gram, own, at):
        cols = [np.full(len(at), gram), at, low[at], high[at], first[at], last[at], own]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [*"abcdefg"])

    old = ngram_join.BLOCK
    try:
        ngram_join.BLOCK = 32
        whole = list(ngram_join._lists(0.6)(iter([pairs(5, np.zeros(m, int), np.arange(m))])))
        half = np.arange(m) % 2
        parts = [pairs(g, half[at], at) for g, at in ((1, np.flatnonzero(half == 0)), (2, np.r_[np.flatnonzero(half == 0), np.flatnonzero(half == 1)]), (3, np.flatnonzero(half == 1)))]
        chunked = list(ngram_join._lists(0.6)(iter(parts)))
    finally:
        ngram_join.BLOCK = old
    for got in (whole, chunked):
        found = [(x["a"], x["b"]) for b in got for x in b.to_pylist()]
        assert len(found) == len(set(found)) and set(found) == want and all(x["shared"] == 1 for b in got for x in b.to_pylist())


def test_prefixes_of_linked_sets_meet():
    r = np.random.default_rng(9)
    gram = np.unique(r.integers(0, 2**63, 30).astype(np.uint64))
    heavy = (gram, r.integers(0, 4, len(gram)))
    base = np.concatenate([gram[:20], r.integers(0, 2**63, 40).astype(np.uint64)])
    some = [np.unique(np.concatenate([r.permutation(base)[: r.integers(2, 60)], r.integers(0, 2**63, r.integers(0, 12)).astype(np.uint64)])) for _ in range(200)]
    first = [set(ngram_join.prefix(x, heavy, 0.6).tolist()) for x in some]
    for i in range(200):
        for j in range(i):
            o = len(np.intersect1d(some[i], some[j]))
            if o / (len(some[i]) + len(some[j]) - o) >= 0.6:
                assert first[i] & first[j]


def closed(seed, n, size=60):
    """Sets of grams of a small universe, unlike each other, and a changed copy of each tenth."""
    r = np.random.default_rng(seed)
    universe = r.integers(0, 2**63, 6000).astype(np.uint64)
    some = [np.unique(r.choice(universe, size + int(r.integers(0, size)))) for _ in range(n)]
    return some + [np.unique(np.concatenate([x[r.random(len(x)) > 0.15], r.choice(universe, len(x) // 10)])) for x in some[::10]]


def listed_pairs(some, first, *share):
    """Pairs that the index lists give, of sets listed under `first`."""
    gram, lead = np.concatenate(first), np.repeat(np.arange(len(some)), [len(x) for x in first])
    size, order = np.array([len(x) for x in some])[lead], np.argsort(gram, kind="stable")
    cols = [c[order] for c in (tokens.signed(gram), lead, size, size, np.zeros_like(size), size, np.zeros_like(size))]
    order = np.argsort(cols[0], kind="stable")
    return {(x["a"], x["b"]) for b in ngram_join._lists(0.6, *share)(iter([pa.RecordBatch.from_arrays([pa.array(c[order]) for c in cols], [*"abcdefg"])])) for x in b.to_pylist()}


def test_lists_of_unlike_texts_give_few_pairs():
    """Of texts that have single grams in common by chance few meet, and all links do."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for n in (200, 800):
        some = closed(31, n)
        found = listed_pairs(some, [ngram_join.listed(x, none, 0.6) for x in some], ngram_join.bounds(0.6)[2])
        linked = {(i, j) for j in range(len(some)) for i in range(j) if (o := len(np.intersect1d(some[i], some[j], assume_unique=True))) / (len(some[i]) + len(some[j]) - o) >= 0.6}
        assert linked <= found and len(linked) > n / 20
        assert 20 * len(found - linked) < len(listed_pairs(some, [ngram_join.prefix(x, none, 0.6) for x in some]))  # by single grams


@pytest.mark.parametrize("least", [0.5, 0.6, 0.8, 0.95])
def test_keys_of_linked_sets(least):
    """Linked sets have as many keys in common as the bounds say, at every size, and are listed under one."""
    r = np.random.default_rng(17)
    none, (_, one, share), linked = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), ngram_join.bounds(least), 0
    for _ in range(4000):
        x = np.unique(r.integers(0, 2**63, r.integers(1, 40)).astype(np.uint64))
        y = np.unique(np.concatenate([x[r.random(len(x)) > r.choice([0, 0.1, 0.3])], r.integers(0, 2**63, r.integers(0, 8)).astype(np.uint64)]))
        o = len(np.intersect1d(x, y))
        if len(y) and o / (len(x) + len(y) - o) >= least:
            both = len(np.intersect1d(ngram_join.keys(x, least), ngram_join.keys(y, least)))
            assert both >= share * (len(x) + len(y)) - 1e-6 and both >= one * max(len(x), len(y)) - 1e-6
            assert len(np.intersect1d(ngram_join.listed(x, none, least), ngram_join.listed(y, none, least)))
            linked += 1
    assert linked > 200


def test_join_defined(spark, table):
    assert ngram_join.near_links(spark, table([])).count() == 0 and ngram_join.keep_one(spark, table([])).count() == 0
    assert ngram_join.near_links(spark, table([(1, None), (2, None), (3, ""), (4, "")])).count() == 0


def test_several_texts_of_a_doc_id(spark, table):
    """Each is searched, and none is lost that isn't a copy; the text that stays is the one that was compared."""
    r = random.Random(14)
    a, b, c, d = (prose(r, 80) for _ in range(4))
    docs = [(3, a), (3, b), (9, a), (8, b + " more"), (8, c), (8, c), (4, d), (5, None), (5, d), (None, a), (None, a)]
    docs += [(20 + k, t) for k in range(6) for t in [prose(r, 60)] for _ in range(2)]
    docs += [x for k in range(6) for t in [prose(r, 60)] for x in [(40 + 3 * k, t), (41 + 3 * k, t), (41 + 3 * k, t + f" tail{k}")]]  # (1, A), (2, A), (2, B)
    check_links(spark, table(docs), docs)


def test_overlaps_from_the_leader():
    r = np.random.default_rng(2)
    base = np.unique(r.integers(0, 1 << 40, 500).astype(np.uint64))
    group = [np.unique(np.concatenate([r.permutation(base)[:400], r.integers(0, 1 << 40, 60).astype(np.uint64)])) for _ in range(9)] + [base, base[:3]]
    want = np.array([[len(np.intersect1d(a, b)) for b in group] for a in group])
    pairs = np.triu_indices(len(group), 1)  # a set's overlap with itself isn't asked for
    assert (ngram_join.overlaps(group)[pairs] == want[pairs]).all()


# 6 and 10. Repeated substrings

def test_repeats_equal_sql(spark, table, duck, rows, docs):
    want = duck(substring_dedup.SQL.format(docs="documents"), documents=docs)
    assert rows(substring_dedup.repeats(spark, table(docs))) == want and len(want) > 10
    assert rows(suffix_array.repeats(spark, table(docs))) == want


@pytest.mark.parametrize("salts", [256, 2])
def test_repeats_of_hot_keys(spark, table, duck, rows, docs, monkeypatch, salts):
    """Every repeated window and every group of pieces taken as a hot one, spread over parts."""
    monkeypatch.setattr(substring_dedup, "LEAST_HOT", 1)
    monkeypatch.setattr(substring_dedup, "SHARES", 10**9)
    monkeypatch.setattr(suffix_array, "GROUP", 1)
    monkeypatch.setattr(hot, "SALTS", salts)
    want = duck(substring_dedup.SQL.format(docs="documents"), documents=docs)
    assert rows(substring_dedup.repeats(spark, table(docs))) == want and len(want) > 10
    assert rows(suffix_array.repeats(spark, table(docs))) == want


def test_repeats_on_chance_texts(spark, table, duck, rows):
    r = random.Random(7)
    docs = [(k, prose(r, r.randint(0, 300), ["a", "b"] if k % 3 else WORDS[:3])) for k in range(25)]
    for length, period, cover, gram in ((6, 3, (0, 1), 2), (9, 7, (0, 1, 3), 4)):
        sql = substring_dedup.SQL.replace("50", str(length)).replace("48", str(length - 2)).replace("49", str(length - 1))
        want = duck(sql.format(docs="documents"), documents=docs)
        assert rows(substring_dedup.repeats(spark, table(docs), length, period, cover)) == want
        assert rows(suffix_array.repeats(spark, table(docs), length, gram)) == want


def test_repeats_defined(spark, table):
    for op in (substring_dedup, suffix_array):
        assert op.repeats(spark, table([])).count() == 0 and op.repeats(spark, table([(1, None), (2, ""), (3, "a b")])).count() == 0


def test_cover_is_a_difference_cover():
    p, c = substring_dedup.PERIOD, set(substring_dedup.COVER)
    assert all(any((i + s) % p in c and (j + s) % p in c for s in range(p)) for i in range(p) for j in range(p))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120))
def test_suffix_array_against_sorting(s):
    assert suffix_array.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_array_on_hard_texts():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    for s in ([0] * 300, [0, 1] * 150, fib[-1], list(range(200)), list(range(200, 0, -1)), [1, 0] * 100 + [2]):
        assert suffix_array.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


# Words

@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \n\té", max_size=30)), max_size=8))
def test_words_are_those_of_split(texts):
    w = tokens.Words(pa.array(texts, pa.string()))
    want = [x for t in texts for x in re.split("[ \t\n\r\f]+", t or "") if x]
    assert [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)] == want and w.counts().tolist() == [len([x for x in re.split("[ \t\n\r\f]+", t or "") if x]) for t in texts]
    assert len({(x, h) for x, h in zip(want, w.hash.tolist())}) == len(set(want)) == len(set(w.hash.tolist()))
    for n in (1, 2, 3):
        h = w.windows(n).tolist()
        grams = {}
        for i in range(len(want) - n + 1):
            assert grams.setdefault(tuple(want[i : i + n]), h[i]) == h[i]


# 8. Chats

def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' AS tokens", "'clash' AS mask").repartition(3)


def plain_chats(talk, most):
    """Every conversation by an encoding of its own, turn by turn."""
    t, named = chat.tokenizer(chat.TOKENIZER), chat.ids(chat.TOKENIZER)
    out, by = [], {}
    for k, (conv, turn, role, text) in enumerate(talk):
        ids = t.encode(chat.escape(text or ""), add_special_tokens=False).ids
        by.setdefault(("alone", k) if conv is None else conv, []).append((turn is not None, turn or 0, role is not None, role or "", ids))
    for conv, rows in by.items():
        rows.sort()
        for part in range(0, len(rows), most):
            tokens, mask = ([named["conversation"]], [0]) if part == 0 else ([], [])
            some = rows[part : part + most]
            for *_, role, ids in some:
                tokens += [named[role if role in ("system", "user", "assistant") else "other"], *ids, named["end"]]
                mask += [0] + [int(role == "assistant")] * (len(ids) + 1)
            out.append((None if isinstance(conv, tuple) else conv, part // most, tokens, mask, len(some), sum(mask)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [4096, 3])
def test_chats_equal_plain_encoding(spark, most):
    control = "say <|user|> and <\\|end|> <|endoftext|> ok"
    talk = [(1, 0, "system", "Be brief."), (1, 1, "user", control), (1, 2, "assistant", "Fine — ünï 日本 " * 50), (2, 0, "user", None), (2, 0, "user", None), (2, 1, "assistant", ""), (3, None, None, "x"), (None, 1, "tool", "y"), (None, 0, "assistant", "z"), (4, 7, "assistant", "word " * 60_000)]
    talk += [(5, k % 4, "assistant" if k % 2 else "user", f"turn {k % 5}") for k in range(11)] + [(None, 0, "assistant", "z")]
    old = chat.TURNS
    try:
        chat.TURNS = most
        out = [tuple(x) for x in chat.format_chats(spark, turns(spark, talk)).collect()]
    finally:
        chat.TURNS = old
    assert sorted(out, key=repr) == plain_chats(talk, most)
    assert chat.format_chats(spark, turns(spark, [])).count() == 0


def test_chats_round_trip(spark):
    """The texts come back from the ids alone."""
    texts = ["say <|user|> and <\\|end|> <|endoftext|> ok", "Fine — ünï 日本", "", "\n\t <|assistant|>"]
    (x,) = chat.format_chats(spark, turns(spark, [(1, k, "user", s) for k, s in enumerate(texts)])).collect()
    t, names = chat.tokenizer(chat.TOKENIZER), {v: k for k, v in chat.ids(chat.TOKENIZER).items()}
    got, now = [], []
    for i in x.tokens[1:]:
        if i in names:
            if names[i] == "end":
                got.append(chat.unescape(t.decode(now, skip_special_tokens=False)))
            now = []
        else:
            now.append(i)
    assert got == texts and min(names) == 50257


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<", "|", ">", "\\", "user", "<|user|>", "<\\|end|>", "<\\\\|system|>", " "]), max_size=12).map("".join))
def test_escape_is_undone(s):
    e = chat.escape(s)
    assert chat.unescape(e) == s and not re.search(r"<\|(?:user|end|system|assistant|conversation|other|endoftext)\|>", e)


# 4. PII

@pytest.fixture(scope="module")
def pii_model():
    return pii.Model()


def test_pii_held_out(pii_model):
    made = pii.examples(1500, seed=99)
    x = np.array([pii.features(*e[:4]) for e in made], float)
    p = pii_model.probability(x)
    cut = np.array([pii_model.threshold[pii.KINDS.index(e[3])] for e in made])
    y = np.array([e[4] for e in made], bool)
    said = p >= cut
    assert (said & y).sum() / y.sum() >= 0.9 and (said & y).sum() / said.sum() >= 0.93


def test_pii_spans(pii_model):
    texts = ["mail me at jane.doe7@mail.example.com today", "call +1 (212) 555-0137 now", "card 4111 1111 1111 1111 ok", "version 1.2.3 of 2024-01-05", "nothing here", 'token = "9f86d081884c7d659a2feaa0c55ad0153a3bf4f1"', "host 10.20.30.40 up"]
    got = pii_model.spans(texts)
    assert [[k for _, _, k, _ in s] for s in got] == [["email"], ["phone"], ["card"], [], [], ["secret"], ["ip"]]
    assert pii.replaced(texts[0], got[0]) == "mail me at [EMAIL] today"
    for s in got:
        assert all(a[1] <= b[0] for a, b in zip(s, s[1:]))


def test_pii_long_keys(pii_model):
    """A key of any length is one span, and so redacted whole."""
    r = random.Random(12)
    for n in (40, 128, 129, 300, 2000, 50_000):
        key = "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789") for _ in range(n))
        for text, tail in ((f"token={key}", ""), (f'secret = "{key}=="', "=="), (f"api: {key} and", "")):
            at = text.index(key)
            assert [x[:3] for x in pii_model.spans([text])[0]] == [(at, at + n + len(tail), "secret")], (n, text[:20])
    slug = "/".join(f"lib{k}" for k in range(60))
    assert pii_model.spans([f"see /usr/share/{slug} for more"]) == [[]]


def test_pii_borders_of_keys():
    """Without its upper bound the pattern's span is the same as one that looks around itself, in time that follows the length."""
    pattern = re.compile(r"(?<![\w/+])[A-Za-z0-9_\-/+]{16,}={0,2}(?![\w/+])")
    r = random.Random(13)
    for _ in range(4000):
        text = "".join(r.choice(["a1B2c3D4e5F6g7H8", "a1", "-", "-", "é", "=", "=", "/", "+", " ", "_"]) for _ in range(r.randint(1, 9)))
        assert [c[:2] for c in pii.candidates(text) if c[2] == "secret"] == [m.span() for m in pattern.finditer(text) if re.search(r"\d", m[0])], text
    assert list(pii.candidates("a-" * 200_000 + "aé")) == []


def test_pii_phones_of_several_countries(pii_model):
    shapes = ["0151 12345678", "(030) 12345678", "030/1234567", "030 / 1234567", "+49 30 1234567", "+49 (0)30 1234567", "0049 15112345678", "+33 1 23 45 67 89", "01 23 45 67 89", "06.12.34.56.78", "+34 912 345 678", "912 34 56 78", "+1 (212) 555-0137"]
    for shape in shapes:
        text = f"Bitte tel. {shape} rufen"
        at = text.index(shape)
        assert (at, at + len(shape), "phone") in list(pii.candidates(text)), shape
        assert [x[:3] for x in pii_model.spans([text])[0]] == [(at, at + len(shape), "phone")], shape
    text = "room 12 030/1234567 ok, id 4111 1111 1111 1111 030/1234567"  # beside other numbers
    assert [text[a:b] for a, b, k in pii.candidates(text) if k == "phone"].count("030/1234567") == 2
    for text in ("on 12/05/2024 and 05.12.2024", "pages 100-200 of 2010/2011", "population 3 456 789", "1 2 3 4 5 6 7 8 9 10 11 12"):
        assert pii_model.spans([text]) == [[]], text


def plain_spans(model, text):
    """Candidates, trees and greedy choice, one span at a time."""
    scored = []
    for start, end, kind in pii.candidates(text):
        x, odds = pii.features(text, start, end, kind), model.trees.base
        for feature, cut, value in zip(model.trees.feature, model.trees.cut, model.trees.value):
            node = 0
            for level in range(model.trees.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[feature[at]] > cut[at])
            odds += value[node]
        p = 1 / (1 + np.exp(-(model.a * odds + model.b)))
        if p >= model.threshold[pii.KINDS.index(kind)]:
            scored.append((-round(p, 2), start - end, start, pii.KINDS.index(kind), p, end))
    taken = []
    for _, _, start, kind, p, end in sorted(scored):
        if not any(start < b and a < end for a, b, *_ in taken):
            taken.append((start, end, pii.KINDS[kind], pytest.approx(p, abs=2e-6)))
    return sorted(taken, key=lambda t: t[0])


def test_pii_equals_brute_force(spark, table, pii_model):
    r = random.Random(17)
    made = [e[0] for e in pii.examples(600, seed=44)]
    docs = [(k, " ".join(r.choice(made) for _ in range(r.choice([1, 1, 2, 5, 40])))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "no number"), (103, "call +٤٤ ٢٠٧ ٩٤٦ ٠٠٠٠ now"), (104, "iban de89370400440532013000 please"), (105, "x@y.de " * 3000)]
    out = {x.doc_id: x for x in pii.redact(spark, table(docs)).collect()}
    some = 0
    for k, text in docs:
        want = plain_spans(pii_model, text) if text else []
        assert [(s.start, s.stop, s.kind, s.probability) for s in out[k].spans] == want
        assert out[k].text == (pii.replaced(text, [tuple(s) for s in out[k].spans]) if text else text)
        some += len(want)
    assert some > 200 and [s.kind for s in out[103].spans] == ["phone"] and [s.kind for s in out[104].spans] == ["iban"] and len(out[105].spans) == 3000


def test_pii_defined(spark, table):
    long = "word " * 30_000 + "jane.doe7@mail.example.com"
    out = {x.doc_id: x for x in pii.redact(spark, table([(1, None), (2, ""), (3, long), (4, "é jane.doe7@mail.example.com"), (4, "é jane.doe7@mail.example.com")])).collect()}
    assert out[1].text is None and out[1].spans == [] and out[2].text == "" and out[3].text.endswith("[EMAIL]") and out[4].text == "é [EMAIL]" and out[4].spans[0].start == 2
    assert pii.redact(spark, table([])).count() == 0


# 1. Quality

def test_statistics_of_simple_texts():
    x, n = quality.statistics(pa.array(["Ab cd", None, "", "aa aa aa 12"]))
    assert n.tolist() == [2, 0, 0, 4] and x[0, 1] == pytest.approx(np.sqrt(3 / 104)) and x[3, 2] == pytest.approx(np.sqrt(2.5 / 411))


def test_concentration_finds_the_core():
    """A step gives the estimate of the nearest values, with a part of the last bin; all cores weigh the same."""
    r = np.random.default_rng(3)
    x = r.normal(0, 1, (400, quality.P))
    full = quality._values(x)
    bins = np.floor(quality.OCTAVE * np.log2((x**2).sum(1))).astype(int)
    names = np.unique(bins)
    counts = np.array([(bins == b).sum() for b in names])
    sums = np.array([full[bins == b].sum(0) for b in names])
    mean, precision, det = quality.concentrate(names, counts, sums)
    weight, left = np.zeros(400), quality.CORE * 400
    for b in names:
        weight[bins == b] = min(1, left / (bins == b).sum())
        left = max(0, left - (bins == b).sum())
    assert weight.sum() == pytest.approx(300)
    want = np.cov(x.T, aweights=weight, bias=True) + np.diag(np.square(quality.RIDGE))
    np.testing.assert_allclose(mean, np.average(x, 0, weight))
    np.testing.assert_allclose(np.linalg.inv(precision), want)
    assert det == pytest.approx(np.linalg.slogdet(want)[1])


def test_consistency_factors():
    """Of normal data the core's covariance is too small by what CONSISTENT puts right; likewise REWEIGHTED, CUT and WEIGHT."""
    z = np.random.default_rng(6).normal(0, 1, (400_000, quality.P))
    d = (z**2).sum(1)
    core = z[d <= np.quantile(d, quality.CORE)]
    assert core.var() * quality.CONSISTENT == pytest.approx(1, rel=0.01)
    assert (d > quality.WEIGHT).mean() == pytest.approx(0.025, rel=0.05) and z[d <= quality.WEIGHT].var() * quality.REWEIGHTED == pytest.approx(1, rel=0.01)


def plain_distances(x):
    """Fast minimum covariance determinant in plain numpy, by sorting, from many random starts."""
    rng, core, ridge = np.random.default_rng(0), int(np.ceil(quality.CORE * len(x))), np.diag(np.square(quality.RIDGE))
    far = lambda m, c: np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)
    best = None
    for _ in range(60):
        of = x[rng.choice(len(x), quality.P + 1, replace=False)]
        m, c, last = of.mean(0), np.cov(of.T, bias=True) + ridge, np.inf
        for _ in range(100):
            of = x[np.argsort(far(m, c))[:core]]
            m, c = of.mean(0), np.cov(of.T, bias=True) + ridge
            now = np.linalg.slogdet(c)[1]
            if now > last - 1e-9:
                break
            last = now
        if best is None or now < best[0]:
            best = now, m, c
    of = x[far(best[1], best[2]) <= quality.WEIGHT * quality.CONSISTENT]
    return far(of.mean(0), np.cov(of.T, bias=True) * quality.REWEIGHTED + ridge)


def test_outliers_equal_plain_numpy(spark, table):
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdeilmnorstu") for _ in range(r.randint(1, 9)))
    shout = lambda s: s.upper() if r.random() < 0.5 else re.sub("[aeiou]", "4", s)
    docs = []
    for k in range(900):
        s = " ".join(word() + r.choice(["", "", "", ".", ","]) for _ in range(r.randint(20, 150)))
        docs.append((k, shout(s) if r.random() < 0.15 else s.capitalize(), "en" if k % 3 else "de", "a" if k % 2 else "b"))
    got = {x.doc_id: x for x in quality.outliers(spark, table(docs)).collect()}
    x, _ = quality.statistics(pa.array([d[1] for d in docs]))
    for group in {d[2:] for d in docs}:
        of = [d[0] for d in docs if d[2:] == group]
        want = plain_distances(x[of])
        mine = np.array([got[k].distance for k in of])
        assert np.median(np.abs(mine / want - 1)) < 0.06 and sum((w <= quality.CUT) != got[k].keep for k, w in zip(of, want)) <= 2
        assert 0 < sum(not got[k].keep for k in of) < len(of) / 3


def test_outliers(spark, table):
    r = random.Random(8)
    syllables = "ba ce di fo gu la me ni po ru sa te".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    say = lambda n: ". ".join(" ".join(word() for _ in range(8)).capitalize() for _ in range(n // 8 + 1))
    docs = [(k, say(r.randint(40, 200)), r.choice(["en", "de"]), r.choice(["a", "b"])) for k in range(700)]
    bad = [(1000, "#$%& " * 200, "en", "a"), (1001, "12345 67890 " * 100, "en", "a"), (1002, "BUY NOW " * 120, "de", "b"), (1003, None, "en", "a"), (1004, "", "en", "a"), (1005, "   ", "en", "a")]
    few = [(2000, say(80), "xx", "q"), (2001, say(80), None, None), (2000, say(80), "xx", "q")]
    out = quality.outliers(spark, table(docs + bad + few)).collect()
    kept = [x.doc_id for x in out if x.keep]
    assert len(out) == len(docs + bad + few) and not {x[0] for x in bad} & set(kept)
    assert sum(k < 1000 for k in kept) >= 697 and kept.count(2000) == 2 and 2001 in kept
    assert all(x.distance is None for x in out if x.doc_id in (1003, 1004, 1005)) and quality.outliers(spark, table([])).count() == 0


# 3. Language ID

def test_gradients():
    rng = np.random.default_rng(4)
    p = language_id.init(3, 4, rng)
    x, y = rng.integers(0, 256, (7, 5)), rng.integers(0, 3, 5)
    _, grad = language_id.loss_and_gradients(p, x, y)
    for name in p:
        flat = p[name].reshape(-1)
        where = np.argsort(-np.abs(grad[name].reshape(-1)))[:6]
        for i in where:
            old = flat[i]
            flat[i] = old + 1e-5
            up, _ = language_id.loss_and_gradients(p, x, y)
            flat[i] = old - 1e-5
            down, _ = language_id.loss_and_gradients(p, x, y)
            flat[i] = old
            assert grad[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-5, rel=2e-3, abs=1e-7)


def test_prediction_is_the_trained_function():
    """The fast forward pass agrees with the one that is trained, wherever texts are cut."""
    rng = np.random.default_rng(5)
    p = language_id.init(3, language_id.HIDDEN, rng)
    q = {k: v.astype(np.float32) for k, v in p.items()}
    for k in ("E", "U"):
        q[k][..., : 2 * language_id.HIDDEN] *= 0.5
    q["names"] = ["a", "b", "und"]
    data = rng.integers(0, 256, 300).astype(np.uint8)
    off = np.array([0, 0, 100, 300])
    prob, label = language_id.predict(q, data, off)
    assert prob[0].tolist() == [0, 0, 0] and prob[1:].sum(1) == pytest.approx([1, 1], abs=1e-5) and len(label) == 300
    x = data[:100][:, None]
    h = [np.zeros((2, 1, language_id.HIDDEN))]
    both = np.stack([x, x[::-1]], 1)
    sig = lambda v: 1 / (1 + np.exp(-v))
    hid, out = language_id.HIDDEN, []
    for s in range(100):
        a = np.stack([p["E"][d][both[s, d]] for d in (0, 1)])
        g = h[-1] @ p["U"]
        z, r = sig(a[..., :hid] + g[..., :hid]), sig(a[..., hid : 2 * hid] + g[..., hid : 2 * hid])
        c = np.tanh(a[..., 2 * hid :] + r * g[..., 2 * hid :])
        h.append(c + z * (h[-1] - c))
        out.append(h[-1])
    top = np.stack(out)
    logit = np.concatenate([top[:, 0], top[::-1, 1]], -1) @ p["W"] + p["b"]
    soft = np.exp(logit - logit.max(-1, keepdims=True))
    soft /= soft.sum(-1, keepdims=True)
    np.testing.assert_allclose(prob[1], soft[:, 0].mean(0), atol=1e-4)
    assert (label[:100] == soft[:, 0].argmax(-1)).mean() > 0.97


def test_many_languages():
    """More labels than a batch has stretches, and than a byte has values."""
    r = random.Random(15)
    some = [(f"l{k:03d}", "".join(r.choice("abcdefghijk") for _ in range(60)).encode()) for k in range(200) for _ in range(2)]
    q = language_id.train([s for _, s in some], [y for y, _ in some], steps=3)
    assert len(q["names"]) == 201 and np.isfinite(q["W"]).all() and q["W"].shape[1] == 201 and np.abs(q["b"]).min() > 0
    many = {k: v.astype(np.float32) for k, v in language_id.init(300, language_id.HIDDEN, np.random.default_rng(1)).items()} | {"names": [str(k) for k in range(300)]}
    many["b"][299] = 99
    prob, label = language_id.predict(many, np.arange(200, dtype=np.uint8), np.array([0, 200]))
    assert prob.argmax(1).tolist() == [299] and (label == 299).all()


def test_few_texts_many_times(spark, table, monkeypatch):
    """Rows that repeat a few doc_ids or texts train their language, and their number doesn't bound or unbound the sample."""
    monkeypatch.setattr(language_id, "TRAIN_DOCS", 5)
    monkeypatch.setattr(language_id, "SPARE", 2)
    r = random.Random(18)
    say = lambda parts, n: " ".join(r.choice(parts) + r.choice(parts) for _ in range(n))
    texts = [say("the and ing ion her tha".split(), 40) for _ in range(8)]
    docs = [(k % 8, texts[k % 8], "en") for k in range(4000)] + [(k, say("der und sch ein ich ung".split(), 40), "de") for k in range(100, 300)]
    seen = []
    monkeypatch.setattr(language_id, "train", lambda s, y, f=language_id.train: seen.append(y) or f(s, y))
    assert language_id.accepted(spark, table(docs)).count() >= 4190
    assert {la: seen[0].count(la) for la in ("en", "de")} == {"en": 5 * language_id.TRAIN_PLACES, "de": 5 * language_id.TRAIN_PLACES}


def test_runs_equal_brute_force(spark, table):
    """label() against a plain network, unit by unit, over every stretch."""
    r = random.Random(19)
    say = lambda parts, n: " ".join(r.choice(parts) + r.choice(parts) for _ in range(n))
    en, de = "the and ing ion her tha".split(), "der und sch öin ich ung".split()
    docs = [(k, say(en if k % 2 else de, 30), "en" if k % 2 else "de") for k in range(60)] + [(100, say(en, 40) + say(de, 40) + " 0123 456 " * 20, None), (101, "", None), (102, None, "en"), (103, "é", None)]
    t = table(docs)
    q = language_id.model(spark, t)
    sig, hid = lambda v: np.tanh(v) / 2 + 0.5, language_id.HIDDEN

    def states(data, d):
        h, out = np.zeros(hid), []
        for c in data:
            a, g = q["E"][d][c].astype(float), h @ q["U"][d].astype(float)
            z, u = sig(a[:hid] + g[:hid]), sig(a[hid : 2 * hid] + g[hid : 2 * hid])
            h = z * h + (1 - z) * np.tanh(a[2 * hid :] + u * g[2 * hid :])
            out.append(h)
        return np.array(out)

    for x in language_id.label(spark, t).where("doc_id >= 90 OR doc_id < 6").collect():
        data = (dict((d[0], d[1]) for d in docs)[x.doc_id] or "").encode()
        logit = [np.zeros((0, len(q["names"])))]
        for lo in range(0, len(data), language_id.STRETCH):
            part = data[lo : lo + language_id.STRETCH]
            logit.append(np.concatenate([states(part, 0), states(part[::-1], 1)[::-1]], 1) @ q["W"] + q["b"])
        logit = np.concatenate(logit)
        if not len(data):
            assert (x.lang, x.probability, x.keep, x.positions, x.runs) == (None, None, False, [], [])
            continue
        soft = np.exp(logit - logit.max(1, keepdims=True))
        mean = (soft / soft.sum(1, keepdims=True)).mean(0)
        names = [q["names"][k] for k in logit.argmax(1)]
        cut = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
        want = [(names[a], a, b) for a, b in zip(cut, cut[1:])]
        assert x.lang == q["names"][mean.argmax()] and x.probability == pytest.approx(mean.max(), abs=1e-4)
        assert x.keep == (x.lang != "und" and mean.max() >= language_id.MIN_PROBABILITY)
        assert [tuple(y) for y in x.runs] == want and {y.label: y.n for y in x.positions} == {k: names.count(k) for k in set(names)}


def test_language_of_short_texts(spark, table):
    r = random.Random(16)
    say = lambda parts, n: " ".join(r.choice(parts) + r.choice(parts) for _ in range(n))
    long, short = "the and ing ion her tha".split(), "qx zq xö vök züq kvö".split()
    docs = [(k, say(long, 40), "en") for k in range(60)] + [(100 + k, say(short, 3), "qq") for k in range(60)]
    got = {x.doc_id: x.lang for x in language_id.label(spark, table(docs)).collect()}
    assert sum(got[k] == la for k, _, la in docs) >= 114


def test_language_held_out(spark, table):
    r = random.Random(9)
    sounds = {"en": "the and ing ion ent her tha", "de": "sch ich ein und ver lich ung", "fr": "que les des oué eau ère ent"}
    say = lambda la, n: " ".join("".join(r.choice(sounds[la].split()) for _ in range(r.randint(1, 3))) for _ in range(n))
    train = [(k, say(la, 60), la) for k, la in enumerate(["en", "de", "fr"] * 40)]
    test = [(1000 + k, say(la, 30), None) for k, la in enumerate(["en", "de", "fr"] * 20)]
    awkward = [(2000, None, "en"), (2001, "", None), (2002, "0123 4567 89 " * 30, None), (2003, say("de", 8000), None), (2003, "x", None)]
    t = table(train + test + awkward)
    out = {}
    for x in language_id.label(spark, t).collect():
        out.setdefault(x.doc_id, x)
        n = sum(p.n for p in x.positions)
        assert n == sum(q.stop - q.start for q in x.runs) and all(a.stop == b.start for a, b in zip(x.runs, x.runs[1:]))
    right = sum(out[1000 + k].lang == la for k, la in enumerate(["en", "de", "fr"] * 20))
    assert right >= 57 and out[2000].lang is None and not out[2000].keep and out[2001].probability is None and out[2002].lang == "und" and not out[2002].keep
    kept = language_id.accepted(spark, t)
    assert kept.columns == t.columns and {x.doc_id for x in kept.collect()} >= {1000 + k for k in range(60)} - {d for d, x in out.items() if not x.keep}
    assert language_id.label(spark, table([])).count() == 0
    assert {x.lang for x in language_id.label(spark, table([(1, "abc", None)])).collect()} == {"und"}


def test_no_column_of_the_input_is_lost(spark, table):
    docs = table([(1, "one two three four five six", "en", "a")])
    for kept in (decontaminate.without_leaks(spark, docs, bench_table(spark, [])), ngram_join.keep_one(spark, docs), mixing.sample(spark, docs, share=1.0)):
        assert kept.columns == docs.columns and kept.where(F.col("h") == "clash").count() == 1

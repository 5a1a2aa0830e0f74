"""N-gram Jaccard join by set-relation skipping.

A document's set holds its word n-grams (its words as one gram, if it has fewer than n).  Two
documents are linked if their sets have a Jaccard index of `least` or more.  near_links()
gives each linked document its class, which is the connected group of links, and the number
of its links; keep_one() leaves one document of each class.  Both are exact: no candidate is
dropped that could be a link, and no list, group or chunk is cut.

1. Copies.  Documents of equal sets are one set, with a count.
2. Sets much like each other.  Sets that share most of their least grams in the parts of the
   hash range meet in a bucket.  A bucket's reference holds the grams that most of REFS of its
   sets have; a set joins the bucket's block if it differs from the reference so little that
   any two sets that do are linked (size > r * difference, r = (1 + least) / (1 - least)).
   Inside a block all answers are known; no pair is looked at.
3. Index lists.  A set's grams lie on a ring, by hash; its keys are its grams, each with the
   next one on the ring.  Two sets of o common grams have 3 o - (sizes) common keys at least:
   of the grams of both, only those before a gram of one alone aren't followed alike.  So a
   link shares keys wherever least > 1/2, while texts that have single grams in common by
   chance share next to none; below that the grams are the keys.  Keys are ordered by frequency
   class, then hash.  A set is listed under its first keys, as many as the threshold needs for
   any link to share one, in PASSES parts of the keys, so the disk holds one part's shuffle.
   A list holds a block once, with the range of its sets' sizes, is sorted by them, and is read
   in blocks of entries; those whose sizes rule the overlap out are skipped whole.  The lists
   that two entries share are counted: what the counted keys and the unlisted rest can't bring
   to the threshold is no candidate.
4. Answers from the reference.  Candidates meet in the group of the least candidate of one of
   them, where references are compared exactly.  The answers of a block's sets follow: with D
   between two references and d from a set to its own, two sets differ by D - d - d' at least
   and D + d + d' at most.  Sets are taken in rings of like d; two rings are linked whole, or
   not at all, or, if the bounds don't tell, their sets are compared, set by set.

A list of more than LIST entries, a group of more than CHUNK references and a pair of rings
of more than CHUNK sets are cut into pairs of chunks, so no task holds more than two.

Defined cases: a null text or one without words has no set, and no links; rows of null doc_id
are left out of links; rows that repeat a doc_id and its text are one document, and different
texts of a doc_id are documents of their own; a very long text is one set like any other; an
empty table gives no rows.  Other columns of the input are neither read nor returned by
near_links(), and kept by keep_one().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spillway.llm.hot import bits, lookup
from spillway.llm.store import Store, partitions
from spillway.llm.tokens import Words, mix, rolling, signed, slices

N, LEAST = 3, 0.6
BUCKETS, REFS, RINGS = 6, 15, 4
#: Keys whose order follows their frequency, at most; those of equal class follow their hash.  Results don't depend on it.
HEAVY, SEEN, COUNTED = 1 << 17, 3, 1 << 20
BLOCK, CHUNK, LIST = 512, 2048, 4096
#: Parts of the keys that are listed one after the other.  Results don't depend on it.
PASSES = 3
_PARTS = (np.arange(2 * BUCKETS).astype(np.float64) * (2.0**64 / (2 * BUCKETS))).astype(np.uint64)

LINKS_SQL = f"""
WITH RECURSIVE u AS (SELECT ROW_NUMBER() OVER (ORDER BY doc_id, text) AS u, doc_id, regexp_extract_all(text, '[^ \\t\\n\\r\\f]+') AS w
  FROM (SELECT DISTINCT doc_id, text FROM {{docs}} WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
g AS (SELECT u, unnest(list_distinct(CASE WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i : i + {N - 1}], ' ')) END)) AS gram FROM u WHERE len(w) > 0),
n AS (SELECT u, COUNT(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.u AS a, b.u AS b, COUNT(*) AS o FROM g a JOIN g b USING (gram) WHERE a.u != b.u GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.u = a JOIN n y ON y.u = b WHERE CAST(o AS DOUBLE) / (x.n + y.n - o) >= {LEAST}),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS u, MIN(doc_id) AS c FROM r JOIN u ON u.u = r.b GROUP BY 1)
SELECT doc_id, LEAST(doc_id, c) AS class_id, (SELECT COUNT(*) FROM e WHERE e.a = u.u) AS links FROM u JOIN c USING (u)
"""


def sets(words: Words, n: int) -> list[np.ndarray]:
    """Sorted distinct gram hashes of each document."""
    h, at = words.windows(n), words.at
    out = []
    for i in range(len(at) - 1):
        lo, hi = at[i], at[i + 1]
        if hi - lo >= n:
            out.append(np.unique(h[lo : hi - n + 1]))
        else:
            out.append(rolling(words.hash[lo:hi], int(hi - lo)) if hi > lo else np.zeros(0, np.uint64))
    return out


def identity(x: np.ndarray) -> tuple[int, int]:
    return int(x.sum().view(np.int64)), int(mix(x).sum().view(np.int64))


def buckets(x: np.ndarray) -> np.ndarray:
    """Keys that sets much like x are likely to share: each of two grams, the first of two parts of the hash range."""
    v = x[np.searchsorted(x, _PARTS) % len(x)]
    return signed(mix(mix(v[::2]) + v[1::2] + np.arange(BUCKETS, dtype=np.uint64)))


def _ratio(least: float) -> float:
    return (1 + least) / (1 - least)


def bounds(least: float) -> tuple[bool, float, float]:
    """Whether keys are of two grams, the least share of a set's keys that a link of it has in common with it, and that of the sizes of both."""
    one, both = 2 * least - 1, 3 * least / (1 + least) - 1
    return (True, one, both) if one > 0.05 else (False, least, least / (1 + least))


def keys(x: np.ndarray, least: float) -> np.ndarray:
    """The keys of a sorted set, sorted: each gram with the one that follows it, the last with the first."""
    return np.sort(mix(x ^ mix(np.roll(x, -1)))) if bounds(least)[0] else x


def _batch(kinds: dict[str, pa.DataType], cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values())], list(kinds))


_SCAN = "doc_id long, h long, size int, id1 long, id2 long, " + ", ".join(f"b{k} long" for k in range(BUCKETS)) + ", gram long, seen int"


def _scan(n: int, least: float):
    """A row for each text that has a set, and rows of keys that are seen often in a part of the texts."""
    names = [c.split()[0] for c in _SCAN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        many = 0

        def often() -> pa.RecordBatch:
            gram, seen = np.unique(np.concatenate(held), return_counts=True)
            gram, seen = gram[seen >= SEEN], seen[seen >= SEEN]
            none = [pa.nulls(len(gram), pa.int64()), pa.nulls(len(gram), pa.int64()), pa.nulls(len(gram), pa.int32())] + [pa.nulls(len(gram), pa.int64())] * (2 + BUCKETS)
            return pa.RecordBatch.from_arrays([*none, pa.array(signed(gram)), pa.array(seen.astype(np.int32))], names)

        for batch in batches:
            for part in slices(batch):
                some = [(i, x) for i, x in enumerate(sets(Words(part.column(1)), n)) if len(x)]
                if not some:
                    continue
                at = pa.array([i for i, _ in some])
                ids = np.array([identity(x) for _, x in some])
                into = np.array([buckets(x) for _, x in some])
                size = pa.array([len(x) for _, x in some], pa.int32())
                last = [pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(2).take(at), size, *(pa.array(c.copy()) for c in ids.T), *(pa.array(c.copy()) for c in into.T), *last], names)
                held += [keys(x, least) for _, x in some]
                many += sum(len(x) for _, x in some)
                if many > COUNTED:
                    yield often()
                    held, many = [], 0
        if held:
            yield often()

    return run


def _heavy(scan: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most HEAVY of the most frequent keys, sorted, and their frequency classes."""
    level = F.floor(F.log2("n")).cast("int")
    counts = scan.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("seen").alias("n")).withColumn("level", level)
    at = {r.level: r["count"] for r in counts.groupBy("level").count().collect()}
    least, room = 64, HEAVY
    for k in sorted(at, reverse=True):
        room -= at[k]
        if room < 0:
            break
        least = k
    rows = counts.where(F.col("level") >= least).select("gram", "level").toPandas()
    gram, level = rows["gram"].to_numpy(np.int64).view(np.uint64), rows["level"].to_numpy(np.int64)
    order = np.argsort(gram)
    return gram[order], level[order]


def prefix(x: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first grams of x in the order of (frequency class, hash), so many that any link of it shares one."""
    gram, level = heavy
    if len(gram):
        at = np.minimum(np.searchsorted(gram, x), len(gram) - 1)
        x = x[np.argsort(np.where(gram[at] == x, level[at], 0), kind="stable")]
    return x[: len(x) - int(np.ceil(least * len(x) - 1e-9)) + 1]


def listed(x: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The keys that a set is listed under."""
    return prefix(keys(x, least), heavy, bounds(least)[1])


def _post(n: int, least: float, heavy, turn: int, turns: int):
    """gram, lead, size for each key that a text's set is listed under, of one of `turns` parts of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                some = [(i, x) for i, x in enumerate(sets(Words(part.column(1)), n)) if len(x)]
                if not some:
                    continue
                first = [k[k % np.uint64(turns) == turn] for k in (listed(x, heavy.value, least) for _, x in some)]
                long = np.array([len(x) for x in first])
                lead = part.column(0).take(pa.array(np.repeat([i for i, _ in some], long)))
                size = np.repeat([len(x) for _, x in some], long).astype(np.int32)
                gram = signed(np.concatenate(first))
                for lo in range(0, len(gram), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(gram[lo : lo + 100_000]), lead.slice(lo, 100_000), pa.array(size[lo : lo + 100_000])], ["gram", "lead", "size"])

    return run


def _consensus(n: int):
    """Grams that more than half of the sets of a lead have, of rows (lead, text) sorted by lead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out():
            gram, count = np.unique(np.concatenate(held), return_counts=True)
            gram = gram[2 * count > len(held)]
            return _batch({"lead": pa.int64(), "grams": pa.binary()}, ([now], [gram.tobytes()]))

        for batch in batches:
            for part in slices(batch):
                for lead, x in zip(part.column(0).to_pylist(), sets(Words(part.column(1)), n)):
                    if lead != now:
                        if held:
                            yield out()
                        now, held = lead, []
                    held.append(x)
        if held:
            yield out()

    return run


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(y):
        return 0
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _compare(n: int, least: float):
    """k, lead, d of the sets that belong to the block of their lead's reference."""
    ratio = _ratio(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ref = None, np.zeros(0, np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                leads, grams = part.column(1).to_pylist(), part.column(3)
                for i, (k, x) in enumerate(zip(part.column(0).to_pylist(), sets(Words(part.column(2)), n))):
                    if leads[i] != now:
                        now, ref = leads[i], np.frombuffer(grams[i].as_buffer(), np.uint64)
                    d = len(x) + len(ref) - 2 * common(x, ref)
                    if len(x) - ratio * d > 1e-6:
                        out.append((k, now, d))
                if out:
                    yield _batch({"k": pa.int64(), "lead": pa.int64(), "d": pa.int32()}, zip(*out))

    return run


_CANDIDATE = "a long, b long, shared int, amin int, amax int, bmin int, bmax int"


def _lists(least: float, share: float | None = None):
    """Pairs of leads that share grams in the lists of a partition, sorted by gram, and how many; rows of two chunks of a list pair across them.

    share: the least share of both sizes that a link has in common; by default, that of its grams.
    """
    half = least / (1 + least) if share is None else share

    def pairs(x, y, low, high, first, last):
        """Which entries x and y may hold a link."""
        need = half * (low[x] + low[y]) - 1e-6
        return (
            (high[x] >= least * low[y] - 1e-6) & (high[y] >= least * low[x] - 1e-6)
            & (np.minimum(last[x], last[y]) + np.minimum(high[x] - first[x], high[y] - first[y]) >= need)
        )

    def lists(gram, lead, low, high, first, last, own):
        new = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        many = np.diff(np.r_[new, len(gram)])
        for m in np.unique(many[many > 1]):
            at = new[many == m]
            if m <= 64:  # all lists of this length at once
                i, j = np.triu_indices(m, 1)
                each = max(1, 100_000 // len(i))
                for lo in range(0, len(at), each):
                    base = at[lo : lo + each]
                    x, y = (base[:, None] + i).ravel(), (base[:, None] + j).ravel()
                    chunked = own[base] != own[base + m - 1]
                    ok = pairs(x, y, low, high, first, last) & ~(np.repeat(chunked, len(i)) & (own[x] == own[y]))
                    yield x[ok], y[ok]
                continue
            for start in at:
                one = np.arange(start, start + m)
                sides = [one[own[one] == c] for c in np.unique(own[one])]
                sides = [s[np.lexsort((first[s], low[s]))] for s in sides]
                blocks = [[s[k : k + BLOCK] for k in range(0, len(s), BLOCK)] for s in sides]
                for p, P in enumerate(blocks[0]):
                    for q, Q in enumerate(blocks[-1]):
                        if len(sides) == 1 and q < p:
                            continue
                        if high[P].max() < least * low[Q].min() - 1e-6 or high[Q].max() < least * low[P].min() - 1e-6:
                            continue
                        if min(last[P].max(), last[Q].max()) + min((high - first)[P].max(), (high - first)[Q].max()) < half * (low[P].min() + low[Q].min()) - 1e-6:
                            continue
                        ok = pairs(P[:, None], Q, low, high, first, last)
                        i, j = np.nonzero(np.triu(ok, 1) if len(sides) == 1 and p == q else ok)
                        yield P[i], Q[j]

    def out(cols):
        held, many = [], 0
        _, lead, low, high, *_ = cols

        def flush():
            x, y = (np.concatenate(c) for c in zip(*held))
            swap = lead[x] > lead[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            ok = lead[x] != lead[y]
            x, y = x[ok], y[ok]
            order = np.lexsort((lead[y], lead[x]))
            x, y = x[order], y[order]
            if not len(x):
                return
            new = np.flatnonzero(np.r_[True, (lead[x][1:] != lead[x][:-1]) | (lead[y][1:] != lead[y][:-1])])
            cols = [lead[x[new]], lead[y[new]], np.diff(np.r_[new, len(x)]), np.minimum.reduceat(low[x], new), np.maximum.reduceat(high[x], new), np.minimum.reduceat(low[y], new), np.maximum.reduceat(high[y], new)]
            for lo in range(0, len(new), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 100_000].astype(np.int64 if k < 2 else np.int32)) for k, c in enumerate(cols)], [c.split()[0] for c in _CANDIDATE.split(", ")])

        for x, y in lists(*cols):
            held.append((x, y))
            many += len(x)
            if many > 500_000:
                yield from flush()
                held, many = [], 0
        if held:
            yield from flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows, held = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append([np.asarray(c).astype(np.int64) for c in batch.columns])
            rows += batch.num_rows
            if rows < 100_000:
                continue
            cols = [np.concatenate(c) for c in zip(*kept)]
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            if cut:
                yield from out([c[:cut] for c in cols])
            kept, rows = [[c[cut:] for c in cols]], len(cols[0]) - cut
        if kept:
            yield from out([np.concatenate(c) for c in zip(*kept)])

    return run


def overlaps(group: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, each set given by its difference from one leader."""
    m = len(group)
    size = np.array([len(x) for x in group])
    if m == 2:
        o = len(np.intersect1d(*group, assume_unique=True))
        return np.array([[size[0], o], [o, size[1]]])
    names, code, count = np.unique(np.concatenate(group), return_inverse=True, return_counts=True)
    at = np.r_[0, np.cumsum(size)]
    like = np.add.reduceat(count[code], at[:-1]) / size
    leader = np.zeros(len(names), bool)
    lead = int(np.argmax(like))
    leader[code[at[lead] : at[lead + 1]]] = True
    row = np.repeat(np.arange(m), size)
    has = leader[code]
    # Grams of the leader that a set lacks are those that it doesn't have: out = L - a.
    lacks = np.bincount(row, ~has, m), leader.sum() - np.bincount(row, has, m)
    total = leader.sum() - lacks[1][:, None] - lacks[1]
    cols = np.flatnonzero(leader & (count < m))  # lacked by some
    place = np.full(len(names), -1)
    for lo in range(0, len(cols), 4096):
        part = cols[lo : lo + 4096]
        place[part] = np.arange(len(part))
        x = np.ones((m, len(part)), np.float32)
        ok = place[code] >= 0
        x[row[ok], place[code[ok]]] = 0
        total = total + np.rint(x @ x.T).astype(np.int64)
        place[part] = -1
    cols = np.flatnonzero(~leader & (count > 1))  # added by more than one
    for lo in range(0, len(cols), 4096):
        part = cols[lo : lo + 4096]
        place[part] = np.arange(len(part))
        x = np.zeros((m, len(part)), np.float32)
        ok = place[code] >= 0
        x[row[ok], place[code[ok]]] = 1
        total = total + np.rint(x @ x.T).astype(np.int64)
        place[part] = -1
    return total


_FOUND = "kind int, a long, ra int, b long, rb int, n long"
LINKS, EDGE, OPEN = 0, 1, 2


def _found(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(rows), 100_000):
        yield _batch({"kind": pa.int32(), "a": pa.int64(), "ra": pa.int32(), "b": pa.int64(), "rb": pa.int32(), "n": pa.int64()}, zip(*rows[lo : lo + 100_000]))


def _roots(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least node of each of m nodes' components."""
    root = np.arange(m)
    while True:
        was = root.copy()
        np.minimum.at(root, j, was[i])
        np.minimum.at(root, i, was[j])
        root = root[root]
        if (root == was).all():
            return root


def _answers(n: int, least: float):
    """What follows from exact overlaps of references, in groups sorted by (g, i, j).

    LINKS: n links of each set of ring ra of a.  EDGE: some sets of a and b are linked.
    OPEN: sets of ring ra of a and of ring rb of b must be compared.
    """
    ratio = _ratio(least)

    def answers(key, held) -> list[tuple]:
        best: dict[int, tuple] = {}
        for v, *rest in held:
            best.setdefault(v, rest)
        leads = sorted(best)
        m = len(leads)
        if m < 2:
            return []
        home, chunk, rings, group = zip(*(best[v] for v in leads))
        chunk, size = np.array(chunk), np.array([len(x) for x in group])
        overlap = overlaps(group)
        ok = np.triu(np.broadcast_to(np.array(home, bool), (m, m)), 1)
        if key[1] != key[2]:
            ok &= chunk[:, None] != chunk
        block = np.array([v < 0 for v in leads])
        alone = ok & ~(block[:, None] | block)
        linked = alone & (overlap / np.maximum(1, size[:, None] + size - overlap) >= least)
        docs = np.array([0 if b else r[0]["docs"] for b, r in zip(block, rings)], np.int64)
        links = linked @ docs + linked.T @ docs
        out = [(LINKS, leads[k], 0, None, None, int(links[k])) for k in np.flatnonzero(links)]
        # A block's sets: key = size - ratio * d bounds a link from below, size + ratio * d from above.
        for i, j in zip(*np.nonzero(ok & ~alone)):
            apart = ratio * float(size[i] + size[j] - 2 * overlap[i, j])
            for x in rings[i]:
                for y in rings[j]:
                    if x["low"] + y["low"] - apart > 1e-6:
                        linked[i, j] = True
                        out.append((LINKS, leads[i], x["ring"], None, None, y["docs"]))
                        out.append((LINKS, leads[j], y["ring"], None, None, x["docs"]))
                    elif x["high"] + y["high"] - apart > -1e-6:
                        out.append((OPEN, leads[i], x["ring"], leads[j], y["ring"], None))
        root = _roots(m, *np.nonzero(linked))
        out += [(EDGE, leads[root[k]], None, leads[k], None, None) for k in np.flatnonzero(root != np.arange(m))]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for batch in batches:
            for part in slices(batch):
                g, i, j, v, home, chunk, rings = (part.column(k).to_pylist() for k in range(7))
                grams = part.column(8)
                for r, x in enumerate(sets(Words(part.column(7)), n)):
                    if (key := (g[r], i[r], j[r])) != now:
                        if held:
                            out += answers(now, held)
                        now, held = key, []
                        if len(out) > 50_000:
                            yield from _found(out)
                            out = []
                    held.append((v[r], home[r], chunk[r], rings[r], x if v[r] >= 0 else np.frombuffer(grams[r].as_buffer(), np.uint64)))
        if held:
            out += answers(now, held)
        if out:
            yield from _found(out)

    return run


def _one_by_one(n: int, least: float):
    """LINKS of single sets (as a, by k) and EDGEs, of sets sorted by (a, ra, b, rb, i, j)."""

    def answers(key, held) -> list[tuple]:
        sides: tuple[dict, dict] = ({}, {})
        for second, k, docs, x in held:
            sides[second].setdefault(k, (docs, x))
        if not sides[0] or not sides[1]:
            return []
        ks = [list(s) for s in sides]
        docs = [np.array([s[k][0] for k in s], np.int64) for s in sides]
        group = [s[k][1] for s in sides for k in s]
        m, size = len(ks[0]), np.array([len(x) for x in group])
        overlap = overlaps(group)[:m, m:]
        linked = overlap / (size[:m, None] + size[m:] - overlap) >= least
        out = [(LINKS, k, None, None, None, int(x)) for k, x in zip(ks[0], linked @ docs[1]) if x]
        out += [(LINKS, k, None, None, None, int(x)) for k, x in zip(ks[1], linked.T @ docs[0]) if x]
        return out + ([(EDGE, key[0], None, key[2], None, None)] if linked.any() else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for batch in batches:
            for part in slices(batch):
                keys = list(zip(*(part.column(k).to_pylist() for k in range(6))))
                second, k, docs = (part.column(c).to_pylist() for c in (6, 7, 8))
                for r, x in enumerate(sets(Words(part.column(9)), n)):
                    if keys[r] != now:
                        if held:
                            out += answers(now, held)
                        now, held = keys[r], []
                        if len(out) > 50_000:
                            yield from _found(out)
                            out = []
                    held.append((second[r], k[r], docs[r], x))
        if held:
            out += answers(now, held)
        if out:
            yield from _found(out)

    return run


def _blocks(store: Store, classes: DataFrame) -> DataFrame:
    """k, lead, ref: the bucket of sets that set k is compared in, named by a set of it, and whether it is one of those that make its reference."""
    keys = classes.select("k", F.explode(F.array(*(f"b{r}" for r in range(BUCKETS)))).alias("bucket"))
    several = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    best = store.table(keys.join(several, "bucket").groupBy("k").agg(F.max(F.struct("many", "bucket")).alias("best")), "best")
    # Sets of one origin may have different buckets as their largest: a bucket goes with the largest that any of its sets is in.
    to = keys.join(best, "k").groupBy("bucket").agg(F.max("best").alias("to"))
    of = best.join(to, F.col("best.bucket") == to["bucket"]).select("k", F.col("to.bucket").alias("bucket"))
    lead = of.groupBy("bucket").agg(F.min("k").alias("lead"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    of = store.table(of.join(lead, "bucket").select("k", "lead"), "assigned")
    rank = F.row_number().over(Window.partitionBy("lead").orderBy(F.xxhash64("k"), "k"))
    refs = of.withColumn("rank", rank).where(F.col("rank") <= REFS).select("k", F.lit(True).alias("ref"))
    return of.join(refs, "k", "left").select("k", "lead", F.coalesce("ref", F.lit(False)).alias("ref"))


def _among(spark: SparkSession, ids: DataFrame, of: Column) -> Column:
    """Whether a column may be one of ids (k), by a table of bits; all that are do pass.  So few texts are moved that aren't asked for."""
    shared = spark.sparkContext.broadcast(bits(ids, "k"))

    @F.arrow_udf("boolean")
    def found(at: pa.Array) -> pa.Array:
        return pa.array(lookup(shared.value, np.asarray(at)))

    return found(of)


def _candidates(spark: SparkSession, store: Store, indexed: DataFrame, heavy, n: int, least: float) -> DataFrame:
    """Pairs of leads that may hold a link, of the texts (lead, text) of sets; those of a block have one lead."""
    _, one, share = bounds(least)
    order = Window.partitionBy("gram")
    both = lambda a, b: F.shiftleft(F.col(a).cast("long"), 32).bitwiseOR(F.col(b).cast("long")).alias("sizes")
    # Most keys are of one set; their rows end here, and the others, a few, are moved again.
    parts = []
    for turn in range(PASSES):
        posts, block = (indexed.where(which).mapInArrow(_post(n, least, heavy, turn, PASSES), "gram long, lead long, size int") for which in ("lead >= 0", "lead < 0"))
        block = block.groupBy("gram", "lead").agg(F.min("size").alias("low"), F.max("size").alias("high"))
        posts = posts.select("gram", "lead", both("size", "size")).unionByName(block.select("gram", "lead", both("low", "high")))
        parts.append(store.table(posts.withColumn("many", F.count(F.lit(1)).over(order)).where("many > 1"), f"lists-{turn}"))
        store.release()
    lists = reduce(DataFrame.unionByName, parts)
    low, high = F.shiftrightunsigned("sizes", 32).cast("int"), F.col("sizes").bitwiseAND(0xFFFFFFFF).cast("int")
    # Places among a set's keys rule out next to nothing, and aren't kept: any may be the first or the last.
    cols = ["gram", "lead", low.alias("low"), high.alias("high"), F.lit(0).alias("first"), high.alias("last")]
    short = lists.where(F.col("many") <= LIST).select(*cols, F.lit(0).alias("own")).repartition("gram").sortWithinPartitions("gram").mapInArrow(_lists(least, share), _CANDIDATE)
    # Chunks of a long list are ranges of size.  Only chunks whose sizes can meet are paired, each pair a list of its own.
    long = lists.where(F.col("many") > LIST).select(*cols).withColumn("own", F.floor((F.row_number().over(order.orderBy("low", "lead")) - 1) / LIST).cast("int"))
    ranges = long.groupBy("gram", "own").agg(F.min("low").alias("least"), F.max("high").alias("most"))
    a, b = (ranges.select("gram", F.col("own").alias(c), F.col("least").alias(f"{c}0"), F.col("most").alias(f"{c}1")) for c in "ij")
    meet = a.join(b, "gram").where(f"i <= j AND i1 >= {least} * j0 - 1e-6 AND j1 >= {least} * i0 - 1e-6")
    meet = meet.select("gram", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("own"))
    key = F.xxhash64("gram", "i", "j")
    long = long.join(meet, ["gram", "own"]).select(key.alias("gram"), "lead", "low", "high", "first", "last", "own")
    # Few bytes and much work: their partitions are given, lest they be put together by size.
    long = long.repartition(partitions(spark), "gram").sortWithinPartitions("gram", "own").mapInArrow(_lists(least, share), _CANDIDATE)
    found = short.unionByName(long).groupBy("a", "b").agg(F.sum("shared").alias("shared"), *(F.min(c).alias(c) for c in ("amin", "bmin")), *(F.max(c).alias(c) for c in ("amax", "bmax")))
    rest = F.ceil(F.lit(one) * F.greatest("amax", "bmax") - 1e-9) - 1
    return found.where(F.col("shared") + rest >= share * (F.col("amin") + F.col("bmin")) - 1e-6).select("a", "b")


def _links(spark: SparkSession, docs: DataFrame, n: int, least: float) -> tuple[DataFrame, DataFrame, DataFrame, Store]:
    """members (doc_id, h, id1, id2, size), sets (k, id1, id2, size, doc, docs, lead, ring, own: links), edges between leads (u, v; v < u), and the store they are in."""
    store = Store(spark)
    rows = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    scan = store.table(rows.mapInArrow(_scan(n, least), _SCAN), "scan")
    heavy = spark.sparkContext.broadcast(_heavy(scan))
    values = ["size", "id1", "id2", *(f"b{r}" for r in range(BUCKETS))]
    members = store.table(scan.where("doc_id IS NOT NULL").groupBy("doc_id", "h").agg(*(F.first(c).alias(c) for c in values)), "members")
    store.drop("scan")
    classes = members.groupBy("id1", "id2", "size").agg(F.min(F.struct("doc_id", "h")).alias("doc"), F.count(F.lit(1)).alias("docs"), *(F.first(c).alias(c) for c in values[3:]))
    classes = store.table(classes.withColumn("k", F.monotonically_increasing_id()), "classes")
    assigned = _blocks(store, classes)
    named = classes.select("k", "doc.doc_id", "doc.h")

    def fetched(sets: DataFrame, few: bool = True) -> DataFrame:
        """A text of each of the sets (k, doc_id, h and more); few of all texts are moved if few are asked for."""
        some = rows.where(_among(spark, sets.select(F.xxhash64("doc_id", "h").alias("k")), F.xxhash64("doc_id", "h"))) if few else rows
        return some.groupBy("doc_id", "h").agg(F.first("text").alias("text")).join(sets.hint("merge"), ["doc_id", "h"]).drop("doc_id", "h")

    named = store.table(named.join(assigned, "k", "left"), "named")
    in_bucket = store.table(fetched(named.where("lead IS NOT NULL")), "texts")
    store.drop("best", "assigned")
    refs = in_bucket.where("ref").select("lead", "text").repartition("lead").sortWithinPartitions("lead").mapInArrow(_consensus(n), "lead long, grams binary")
    refs = store.table(refs, "refs")
    near = in_bucket.hint("merge").join(refs, "lead").select("k", "lead", "text", "grams").mapInArrow(_compare(n, least), "k long, lead long, d int")
    # A block's lead is below zero; a set outside blocks leads itself.
    near = store.table(near.select("k", (-1 - F.col("lead")).alias("lead"), "d"), "near")
    r = _ratio(least)
    ring = F.floor(F.col("d") * F.lit(RINGS * r) / F.col("size")).cast("int")
    sets_ = classes.select("k", "id1", "id2", "size", F.col("doc.doc_id").alias("doc"), "docs").join(near, "k", "left")
    sets_ = sets_.select("k", "id1", "id2", "size", "doc", "docs", F.coalesce("lead", "k").alias("lead"), F.coalesce("d", F.lit(0)).alias("d"))
    sets_ = store.table(sets_.withColumn("ring", ring), "sets")
    low, high = F.min(F.col("size") - r * F.col("d")), F.max(F.col("size") + r * F.col("d"))
    rings = sets_.groupBy("lead", "ring").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("sets"), low.alias("low"), high.alias("high"))
    rings = store.table(rings, "rings")

    alone = fetched(named.where("lead IS NULL").select("k", "doc_id", "h"), few=False).select(F.col("k").alias("lead"), "text")
    other = in_bucket.select("k", "text").join(near.select("k", F.col("lead").alias("block")), "k", "left").select(F.coalesce("block", "k").alias("lead"), "text")
    indexed = store.table(alone.unionByName(other), "indexed")
    store.release()
    pairs = store.table(_candidates(spark, store, indexed, heavy, n, least), "pairs")
    store.drop("indexed", *(f"lists-{turn}" for turn in range(PASSES)))
    store.release()

    lead = pairs.groupBy("b").agg(F.min("a").alias("g"))
    meet = pairs.join(lead, "b").select("g", F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(0).alias("home")), F.struct(F.col("b").alias("v"), F.lit(1).alias("home")))).alias("m"))
    meet = meet.groupBy("g", "m.v").agg(F.max("m.home").alias("home"))
    parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("g")) / CHUNK).cast("int")
    meet = meet.withColumn("parts", parts).withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    meet = store.table(meet.select("g", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "v", "home", "chunk"), "meet")
    store.drop("pairs")
    shape = meet.select("v").distinct().join(rings, F.col("v") == rings["lead"]).groupBy("v").agg(F.collect_list(F.struct("ring", "docs", "low", "high")).alias("rings"))
    asked = store.table(meet.select(F.col("v").alias("k")).distinct().join(named.select("k", "doc_id", "h"), "k"), "asked")
    what = fetched(asked).select(F.col("k").alias("v"), "text", F.lit(None).cast("binary").alias("grams")).unionByName(refs.select((-1 - F.col("lead")).alias("v"), F.lit(None).cast("string").alias("text"), "grams"))
    meet = meet.join(shape, "v").join(what, "v").select("g", "i", "j", "v", "home", "chunk", "rings", "text", "grams")
    found = meet.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(_answers(n, least), _FOUND)
    found = store.table(found, "found")
    store.drop("meet")

    open_ = found.where(F.col("kind") == OPEN).select("a", "ra", "b", "rb")
    many = lambda c: rings.select(F.col("lead").alias(c), F.col("ring").alias(f"r{c}"), F.ceil(F.col("sets") / CHUNK).cast("int").alias(f"p{c}"))
    open_ = store.table(open_.join(many("a"), ["a", "ra"]).join(many("b"), ["b", "rb"]), "open")
    sides = []
    for c, own, other in (("a", "i", "j"), ("b", "j", "i")):
        side = open_.join(sets_.select("k", "docs", F.col("lead").alias(c), F.col("ring").alias(f"r{c}")), [c, f"r{c}"])
        side = side.withColumn(own, F.pmod(F.xxhash64("k"), F.col(f"p{c}")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("pb" if c == "a" else "pa") - 1)))
        sides.append(side.select("a", "ra", "b", "rb", "i", "j", F.lit(int(c == "b")).alias("second"), "k", "docs"))
    each = store.table(sides[0].unionByName(sides[1]), "each")
    asked = store.table(each.select("k").distinct().join(named.select("k", "doc_id", "h"), "k"), "asked-again")
    each = each.join(fetched(asked), "k").select("a", "ra", "b", "rb", "i", "j", "second", "k", "docs", "text")
    key = ["a", "ra", "b", "rb", "i", "j"]
    single = each.repartition(*key).sortWithinPartitions(*key).mapInArrow(_one_by_one(n, least), _FOUND)
    single = store.table(single, "single")

    of_ring = found.where(F.col("kind") == LINKS).groupBy(F.col("a").alias("lead"), F.col("ra").alias("ring")).agg(F.sum("n").alias("ring_links"))
    of_set = single.where(F.col("kind") == LINKS).groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("set_links"))
    inside = rings.groupBy("lead").agg(F.sum("docs").alias("inside"))
    own = F.col("inside") - 1 + F.coalesce("ring_links", F.lit(0)) + F.coalesce("set_links", F.lit(0))
    sets_ = sets_.join(inside, "lead").join(of_ring, ["lead", "ring"], "left").join(of_set, "k", "left").select("k", "id1", "id2", "size", "doc", "lead", own.alias("links"))
    edges = found.unionByName(single).where(F.col("kind") == EDGE).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    store.drop("classes", "near", "refs", "texts", "open", "each", "named", "asked", "asked-again")
    store.release()
    return members, sets_, edges, store


def near_links(spark: SparkSession, docs: DataFrame, n: int = N, least: float = LEAST) -> DataFrame:
    """doc_id, class_id, links for each document that has a link; a class is a connected group, its id its least doc_id."""
    return _classes(*_links(spark, docs, n, least)).select("doc_id", "class_id", "links")


def _classes(members: DataFrame, sets_: DataFrame, edges: DataFrame, store: Store) -> DataFrame:
    """doc_id, h, class_id, links of each document that has a link, and whether it is the first of its class."""
    comp = _components(store, edges)
    named = sets_.where("links > 0").join(comp.select(F.col("u").alias("lead"), "root"), "lead", "left").withColumn("root", F.coalesce("root", "lead"))
    # (doc_id, h) of a class's first document: the least over its sets' first ones, not over all its documents at once.
    of = members.join(named.select("id1", "id2", "size", "root", "links"), ["id1", "id2", "size"])
    first = of.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("head"))
    return of.join(first, "root").select("doc_id", "h", F.col("head.doc_id").alias("class_id"), "links", (F.struct("doc_id", "h") == F.col("head")).alias("first"))


def keep_one(spark: SparkSession, docs: DataFrame, n: int = N, least: float = LEAST) -> DataFrame:
    """docs without all but one document, of the least doc_id, of each class, and without repeated rows of a document; rows of null doc_id stay."""
    members, sets_, edges, store = _links(spark, docs, n, least)
    gone = store.table(_classes(members, sets_, edges, store).where("NOT first").select("doc_id", F.col("h").alias("hash")), "gone")
    # Ordered by every column that has an order, so the row that stays doesn't depend on the run; a text moves once.
    order = [F.col("row")[c] for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    again = F.row_number().over(Window.partitionBy("doc_id", "hash").orderBy(*order))
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("hash"), F.struct("*").alias("row"))
    kept = rows.withColumn("again", again).where("again = 1").join(gone, ["doc_id", "hash"], "left_anti")
    return kept.select("row.*").unionByName(docs.where("doc_id IS NULL"))


def _components(store: Store, edges: DataFrame) -> DataFrame:
    """Least node of the component of each node u, by alternating large and small stars; edges go from u to a smaller v."""
    edges, name = store.table(edges, "star-0"), "star-0"
    for turn in range(1, 60):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = store.table(small.select("e.*").where("u != v").distinct(), f"star-{turn}")
        changed = after.join(edges, ["u", "v"], "left_anti").limit(1).count() + edges.join(after, ["u", "v"], "left_anti").limit(1).count()
        store.drop(name)
        edges, name = after, f"star-{turn}"
        if not changed:
            return edges.select("u", F.col("v").alias("root"))
    raise RuntimeError("the components of the links didn't come to rest")

"""Suffix-array dedup, with suffix arrays by linear grouping.

suffix_array() sorts suffixes in two phases.  Grouping: suffixes start in groups by first
symbol; groups are processed in descending order, and each hands its context to the suffixes
that precede it.  A suffix's previous-smaller pointer names the last suffix before it that is
in a lower group; suffixes pointed to by more members of the group move behind those pointed
to by fewer.  At the end a group holds the suffixes of one longest Lyndon prefix, and groups
are in the order of these.  Ordering: the array is filled from its front; each suffix that is
placed emits, along previous-smaller pointers, those whose Lyndon prefix ends where it starts,
to the next free place of their groups.  No symbol is renamed and nothing is called again.

repeats() finds the runs of LENGTH words that occur at two places, in two steps of the corpus:

1. Routing.  Each run of LENGTH words has a least hash among its windows of GRAM words.
   Consecutive runs of equal least hash are one piece.  Equal runs have equal hashes, so all
   places of a run lie in pieces of one hash; pieces whose hash occurs once hold no repeat
   and are dropped.
2. Sorting.  Equal pieces of a hash are counted once.  The suffix array of the different
   pieces, joined by separators, brings equal runs side by side, and neighbours are compared
   word by word.

Pieces are counted by hash with partial sums before anything else is shuffled.  A hash of more
than GROUP pieces would be too much for one task's suffix array: its pieces are cut into their
runs, which are counted and ordered by hash of the run in parts (hot.py).  All places of a run
have one hash, so both ways give every repeat.

Defined cases: as in substring_dedup, whose rows these are: null texts and texts of fewer
than LENGTH words have no repeats; rows of null doc_id are left out; rows that repeat a
doc_id repeat each other; overlapping places count; a very long text is read whole; an empty
table gives no rows.  Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spillway.llm.hot import bits, lookup, places
from spillway.llm.store import Store
from spillway.llm.substring_dedup import LENGTH, SQL, _runs, spans
from spillway.llm.tokens import Words, signed, slices

__all__ = ["LENGTH", "SQL", "repeats", "suffix_array"]

GRAM, GROUP = 20, 20_000
_BLANK = bytes.maketrans(b"\t\n\r\f", b"    ")


def suffix_array(s: list[int] | np.ndarray) -> list[int]:
    """Starts of the suffixes of s in ascending order, a suffix before those that it begins."""
    n = len(s)
    if n < 2:
        return list(range(n))
    low = int(min(s))
    count = [0] * (int(max(s)) - low + 2)  # counting sort by first symbol: symbols are names in a dense range
    for c in s:
        count[c - low + 1] += 1
    for c in range(1, len(count)):
        count[c] += count[c - 1]
    first = count[:]  # by symbol, the first place of its group
    sa = [0] * n
    place = [0] * n  # where a suffix stands in sa
    group = [0] * n  # first place of its group
    size = [0] * n  # by first place
    for i, c in enumerate(s):
        c -= low
        p = count[c]
        count[c] = p + 1
        sa[p] = i
        place[i] = p
        group[i] = first[c]
        size[first[c]] += 1
    prev = [-1] * n
    end = n
    while end:
        start = group[sa[end - 1]]
        if end - start == 1:
            i = sa[start]
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                g = group[j]
                m = size[g]
                if m > 1:  # to the end of its group, as the next group
                    last = g + m - 1
                    p = place[j]
                    if p != last:
                        other = sa[last]
                        sa[p] = other
                        place[other] = p
                        sa[last] = j
                        place[j] = last
                    size[g] = m - 1
                    group[j] = last
                    size[last] = 1
        else:
            members = sa[start:end]
            for i in members:  # to the last suffix before it that is in this group or a lower one
                j = i - 1
                while j >= 0 and group[j] > start:
                    j = prev[j]
                prev[i] = j
            votes: dict[int, int] = {}
            for i in members:  # then out of this group, each pointer of a chain once
                chain = []
                j = i
                while j >= 0 and group[j] == start:
                    chain.append(j)
                    j = prev[j]
                for k in chain:
                    prev[k] = j
                if j >= 0:
                    votes[j] = votes.get(j, 0) + 1
            most = max(votes.values(), default=0)
            levels: list[list[int]] = [[] for _ in range(most + 1)]  # their sum is the group's size at most
            for j, v in votes.items():
                levels[v].append(j)
            for v in range(most, 0, -1):
                moved: dict[int, int] = {}
                for j in levels[v]:  # to the ends of their groups
                    g = group[j]
                    k = moved.get(g, 0)
                    last = g + size[g] - 1 - k
                    p = place[j]
                    if p != last:
                        other = sa[last]
                        sa[p] = other
                        place[other] = p
                        sa[last] = j
                        place[j] = last
                    moved[g] = k + 1
                for g, k in moved.items():
                    left = size[g] - k
                    if left:
                        size[g] = left
                        size[g + left] = k
                        for p in range(g + left, g + left + k):
                            group[sa[p]] = g + left
        end = start
    # The next smaller suffix of i: n, or the first after i whose chain of pointers skips i.
    after = [n] * n
    for i in range(n - 1, 0, -1):
        j = i - 1
        stop = prev[i]
        while j != stop:
            if after[j] == n and j >= 0:
                after[j] = i
            j = prev[j]
    out = [0] * n
    free = list(range(n))  # next free place of the group that starts here
    done = 0
    s_at = n  # the empty suffix comes before all
    while True:
        j = s_at - 1
        while j >= 0 and after[j] == s_at:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            j = prev[j]
        if done == n:
            return out
        s_at = out[done]
        done += 1


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least of the `width` values from each place on."""
    n, have = len(h) - width + 1, 1
    if n <= 0:
        return h[:0]
    while have * 2 <= width:
        h = np.minimum(h[: len(h) - have], h[have:])
        have *= 2
    return np.minimum(h[:n], h[width - have : width - have + n])


def _pieces(length: int, gram: int, seen=None):
    """h of each piece; with `seen`, the pieces whose h may be among the seen, or that may repeat themselves."""
    width = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column(1))
                if len(words.hash) < length:
                    continue
                doc = words.doc()
                place = np.arange(len(doc)) - words.at[doc]
                h = words.windows(gram)
                low = sliding_min(h, width)
                start = np.flatnonzero(place + length <= words.counts()[doc])
                if not len(start):
                    continue
                low = low[start]
                short = h.astype(np.uint32)
                again = np.zeros(len(h) + 1, np.int64)  # whether a window of words comes again nearby
                for k in range(1, width):
                    again[1 : len(h) - k + 1] |= short[:-k] == short[k:]
                again = np.cumsum(again)
                new = np.flatnonzero(np.r_[True, (np.diff(start) > 1) | (low[1:] != low[:-1])])
                runs = np.diff(np.r_[new, len(start)])
                first = start[new]
                multi = (runs > width) | (again[np.minimum(first + runs, len(h))] > again[first])
                h = signed(low[new])
                if seen is None:
                    yield pa.RecordBatch.from_arrays([pa.array(h)], ["h"])
                    continue
                keep = lookup(seen.value, h) | multi
                h, first, runs, multi = h[keep], first[keep], runs[keep], multi[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), part.column(0).take(pa.array(doc[first])), pa.array(place[first].astype(np.int32)), pa.array(runs.astype(np.int32)), pa.array(multi)],
                    ["h", "doc_id", "place", "runs", "multi"],
                )

    return run


def _cut(length: int, hot: bool):
    """The words of each piece of each document, one space apart; of hot pieces, each run's hash."""

    def pieces(part, words) -> Iterator[pa.RecordBatch]:
        data = words.data.tobytes().translate(_BLANK)
        rows = []
        for r, (doc, found) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())):
            for x in found:
                a, b = words.at[r] + x["place"], words.at[r] + x["place"] + x["runs"] + length - 2
                if not x["hot"] and b < words.at[r + 1]:  # rows may share a doc_id
                    rows.append((x["h"], doc, x["place"], x["runs"], x["multi"], b" ".join(filter(None, data[words.start[a] : words.end[b]].split(b" ")))))
        for lo in range(0, len(rows), 5000):
            cols = list(zip(*rows[lo : lo + 5000]))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["h", "doc_id", "place", "runs", "multi", "piece"])

    def runs(part, words) -> Iterator[pa.RecordBatch]:
        h = signed(words.windows(length))
        for r, (doc, found) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())):
            # Pieces of a text don't share a run; a repeated doc_id's may, and its rows have the same.
            at = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.arange(x["place"], x["place"] + x["runs"]) for x in found if x["hot"])]))
            at = at[at + length <= words.at[r + 1] - words.at[r]]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(h[words.at[r] + at]), pa.array(np.full(len(at), doc)), pa.array(at.astype(np.int32))], ["h", "doc_id", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield from (runs if hot else pieces)(part, Words(part.column(1)))

    return run


def group_runs(places: dict[bytes, list[tuple[int, int]]], runs: dict[bytes, int], multi: bool, length: int) -> Iterator[tuple[int, bool, int, int]]:
    """(doc_id, later, first start, last start) of the repeated runs among the pieces of one hash."""
    if len(places) == 1 and not multi:
        (piece, at), = places.items()
        if len(at) > 1:
            first = at.index(min(at))
            for k, (doc, place) in enumerate(at):
                yield doc, k != first, place, place + runs[piece] - 1
        return
    pieces = list(places)
    m = len(pieces)
    ids: dict[bytes, int] = {}
    s: list[int] = []
    begin = []
    for k, piece in enumerate(pieces):
        begin.append(len(s))
        s += [ids.setdefault(w, m + len(ids)) for w in piece.split(b" ")]
        s.append(k)
    n_runs = np.array([runs[x] for x in pieces])
    many = np.array([len(places[x]) for x in pieces])
    least = [min(places[x]) for x in pieces]
    doc0, place0 = np.array([x[0] for x in least]), np.array([x[1] for x in least])
    owner = np.repeat(np.arange(m), np.diff(np.r_[begin, len(s)]))
    offset = np.arange(len(s)) - np.array(begin)[owner]
    sa = np.array(suffix_array(s))
    sa = sa[offset[sa] < n_runs[owner[sa]]]
    text = np.array(s + [-1] * length)
    span = np.arange(length)
    fresh = np.ones(len(sa), bool)
    for lo in range(1, len(sa), 50_000):
        part = sa[lo - 1 : lo + 50_000]
        x = text[part[:, None] + span]
        fresh[lo : lo + len(part) - 1] = (x[1:] != x[:-1]).any(1)
    kind = np.cumsum(fresh) - 1
    total = np.bincount(kind, many[owner[sa]])
    order = np.lexsort((place0[owner[sa]] + offset[sa], doc0[owner[sa]], kind))
    first = np.zeros(len(sa), bool)
    first[order[np.r_[True, np.diff(kind[order]) > 0]]] = True
    state = np.zeros(len(s), np.int8)  # 1: first place of a repeated run; 2: a later one
    state[sa] = np.where(total[kind] > 1, np.where(first, 1, 2), 0)
    for k, piece in enumerate(pieces):
        x = state[begin[k] : begin[k] + n_runs[k]]
        cut = np.flatnonzero(np.diff(x)) + 1
        skipped = False
        for doc, place in places[piece]:
            if (doc, place) == least[k] and not skipped:
                skipped = True
                for lo, hi in zip(np.r_[0, cut].tolist(), np.r_[cut, len(x)].tolist()):
                    if x[lo]:
                        yield doc, bool(x[lo] == 2), place + lo, place + hi - 1
            else:
                yield doc, True, place, place + int(n_runs[k]) - 1


def _sort(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, places, runs, multi = None, {}, {}, False

        def flush():
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.bool_(), pa.int32(), pa.int32()))], ["doc_id", "later", "lo", "hi"])

        for batch in batches:
            for h, doc, place, n, more, piece in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if h != now:
                    if now is not None:
                        out.extend(group_runs(places, runs, multi, length))
                        if len(out) > 20_000:
                            yield flush()
                    now, places, runs, multi = h, {}, {}, False
                places.setdefault(piece, []).append((doc, place))
                runs[piece] = n
                multi |= more
        if now is not None:
            out.extend(group_runs(places, runs, multi, length))
        if out:
            yield flush()

    return run


def repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, later, start_word, end_word (past the last) of all repeated spans."""
    store = Store(spark)
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    counts = texts.mapInArrow(_pieces(length, gram), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = store.table(counts, "counts")
    seen = spark.sparkContext.broadcast(bits(counts, "h"))
    pieces = texts.mapInArrow(_pieces(length, gram, seen), "h long, doc_id long, place int, runs int, multi boolean")
    pieces = pieces.join(counts, "h", "left").where("n IS NOT NULL OR multi").select("h", "doc_id", "place", "runs", "multi", F.coalesce(F.col("n") > GROUP, F.lit(False)).alias("hot"))
    pieces = store.table(pieces, "pieces")
    with_pieces = lambda rows: texts.join(rows.groupBy("doc_id").agg(F.collect_set(F.struct("h", "place", "runs", "multi", "hot")).alias("pieces")), "doc_id").select("doc_id", "text", "pieces")
    cut = with_pieces(pieces.where("NOT hot")).mapInArrow(_cut(length, False), "h long, doc_id long, place int, runs int, multi boolean, piece binary")
    found = cut.repartition("h").sortWithinPartitions("h").mapInArrow(_sort(length), "doc_id long, later boolean, lo int, hi int")
    if pieces.where("hot").limit(1).count():
        runs = with_pieces(pieces.where("hot")).mapInArrow(_cut(length, True), "h long, doc_id long, place int").withColumn("hot", F.lit(True))
        runs = places(store, runs).repartition("doc_id").sortWithinPartitions("doc_id", "later", "place").mapInArrow(_runs, "doc_id long, later boolean, lo int, hi int")
        found = found.unionByName(runs)
    found = store.table(found, "found")
    store.drop("counts", "pieces")
    return spans(found, length)

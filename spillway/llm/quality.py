"""Quality rules: robust multivariate outliers by minimum covariance determinant.

A text's statistic vector holds five transformed shares, smoothed so that a short text lies
near the middle: roots of the shares of signs, capitals and digits, the log of the mean word
length, and how far its different words fall behind its words.  For each language and source
the subset of CORE of the texts whose covariance has the least determinant is sought:

1. Starts.  Of each group, SAMPLE texts of least hash give DRAWS elemental subsets; after two
   concentration steps on the sample, the best go on to rest there, and the BEST of them start
   on the whole group, beside medians with quartiles, and mean with covariance.
2. Concentration steps over the whole group: a step takes the CORE of least Mahalanobis
   distance under the current estimate and estimates again, until no start of the group gets a
   smaller determinant.
3. The estimate of least determinant, made consistent for normal data, is reweighted by the
   usual 97.5 % rule, with that rule's own consistency factor.

RIDGE, a regular target as in regularised estimates, is added to the variances throughout, so
that a statistic that hardly varies in clean texts doesn't reject a telephone number.  A text
is rejected if its squared distance is over CUT, the 1 - 1e-6 quantile of chi square with five
degrees of freedom.

A group of fewer than MIN_GROUP texts has too few for its own covariance: it uses its
language's estimate, and a language of fewer the estimate of all texts.  In a step distances
are counted in bins a sixteenth of an octave wide, and the last bin counts in part, so every
core weighs CORE of its group exactly; a step is one aggregation, whose size depends on the
groups alone.

Defined cases: a null or empty text, or one without words, has a null distance and is
rejected; null languages and sources are values of their own; repeated rows count as rows;
texts of equal distance are in a core in equal part; a very long text is one vector like any
other; an empty table gives no rows.  Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spillway.llm.store import Store
from spillway.llm.tokens import Words, slices

CORE, STEPS, MIN_GROUP = 0.75, 60, 60
SAMPLE, DRAWS, BEST, REST = 300, 60, 3, 1e-6
CUT, WEIGHT = 37.5, 12.8325  # of chi square with five degrees of freedom
#: What a core's covariance is multiplied by to estimate that of normal data: of CORE, and of the 97.5 % that are reweighted.
CONSISTENT, REWEIGHTED, OCTAVE = 1.41207, 1.05553, 16
RIDGE = (0.02, 0.03, 0.06, 0.05, 0.003)
P = len(RIDGE)
STATS = ("signs", "capitals", "digits", "length", "sameness")
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_CLASS = np.zeros((4, 256), np.int64)
for _c in range(256):
    _CLASS[0, _c] = 33 <= _c < 127 and not chr(_c).isalnum()
    _CLASS[1, _c] = 65 <= _c <= 90
    _CLASS[2, _c] = 48 <= _c <= 57
    _CLASS[3, _c] = 65 <= _c <= 90 or 97 <= _c <= 122 or _c >= 192


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Statistic vectors of texts, and their numbers of words."""
    w = Words(texts)
    off = w.off
    sign, capital, digit, letter = (np.diff(np.r_[0, np.cumsum(c[w.data])][off]) for c in _CLASS)
    size, n = np.diff(off), w.counts()
    doc = w.doc()
    order = np.lexsort((w.hash, doc))
    d, h = doc[order], w.hash[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])] if len(d) else np.zeros(0, bool)
    different = np.bincount(d[new], minlength=len(n))
    behind = np.log((n + 8.0) / (different + 8.0))
    return np.stack([
        np.sqrt((sign + 2) / (size + 100)), np.sqrt((capital + 2) / (letter + 100)), np.sqrt((digit + 0.5) / (size + 400)),
        np.log((letter + 40) / (n + 8)), behind / (4 + np.log(n + 1.0) ** 2),
    ], 1), n


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            x, n = statistics(part.column(3))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n > 0), *map(pa.array, x.T.copy())], ["doc_id", "lang", "source", "words", *STATS])


def _estimate(sums: np.ndarray, count: float, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, precision and log determinant from summed values and products."""
    mean = sums[:P] / count
    cov = np.zeros((P, P))
    for k, (i, j) in enumerate(_PAIRS):
        cov[i, j] = cov[j, i] = factor * (sums[P + k] / count - mean[i] * mean[j])
    cov += np.diag(np.square(RIDGE))
    return mean, np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


def concentrate(bins: np.ndarray, counts: np.ndarray, sums: np.ndarray, reweight: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """The next estimate from the bins of distance of one group; the last bin of the core counts in part."""
    order = np.argsort(bins)
    bins, counts, sums = bins[order], counts[order], sums[order]
    before = np.cumsum(counts) - counts
    if reweight:
        # Distances are those of a covariance that isn't made consistent yet.
        last = OCTAVE * np.log2(WEIGHT * CONSISTENT)
        share = np.clip(last - bins, 0, 1)
        if not share.any():
            share = (before < CORE * counts.sum()).astype(float)
    else:
        share = np.clip((CORE * counts.sum() - before) / counts, 0, 1)
    return _estimate(share @ sums, share @ counts, REWEIGHTED if reweight else 1.0)


def _values(x: np.ndarray) -> np.ndarray:
    """Vectors with the products that covariances are made of."""
    return np.concatenate([x, np.stack([x[:, i] * x[:, j] for i, j in _PAIRS], 1)], 1)


def starts(x: np.ndarray, seed: int = 3) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """The BEST estimates of a sample, from random subsets of P + 1 vectors."""
    rng, full = np.random.default_rng(seed), _values(x)
    core = max(P + 1, int(np.ceil(CORE * len(x))))

    def step(mean, precision):
        z = x - mean
        return _estimate(full[np.argsort(np.einsum("ni,ij,nj->n", z, precision, z), kind="stable")[:core]].sum(0), core)

    found = []
    for _ in range(DRAWS if len(x) > P else 0):
        of = rng.choice(len(x), P + 1, replace=False)
        now = _estimate(full[of].sum(0), P + 1)
        for _ in range(2):
            now = step(*now[:2])
        found.append(now)
    out: list[tuple] = []
    for now in sorted(found, key=lambda e: e[2])[: 3 * BEST]:
        for _ in range(STEPS):
            after = step(*now[:2])
            rests, now = after[2] > now[2] - REST, after
            if rests:
                break
        out.append(now)
    kept: list[tuple] = []
    for e in sorted(out, key=lambda e: e[2]):
        if len(kept) < BEST and (not kept or e[2] > kept[-1][2] + REST):
            kept.append(e)
    return kept


_SUMS = [f"s{k}" for k in range(P + len(_PAIRS))]
_MEAN = [f"m{i}" for i in range(P)]
_PREC = [f"p{k}" for k in range(len(_PAIRS))]
_ESTIMATE = "g string, start int, det double, best double, " + ", ".join(f"{c} double" for c in _MEAN + _PREC)


_NAMES = ["g", "start", "det", "best", *_MEAN, *_PREC]


def _row(g, start, mean, precision, det, best=np.inf) -> list:
    return [g, start, det, best, *mean, *(precision[i, j] for i, j in _PAIRS)]


def _distance() -> Column:
    z = [F.col(STATS[i]) - F.col(f"m{i}") for i in range(P)]
    terms = [(1 if i == j else 2) * F.col(f"p{k}") * z[i] * z[j] for k, (i, j) in enumerate(_PAIRS)]
    return sum(terms[1:], terms[0])


def _sums() -> list[Column]:
    values = [F.col(c) for c in STATS] + [F.col(STATS[i]) * F.col(STATS[j]) for i, j in _PAIRS]
    return [F.sum(v).alias(s) for v, s in zip(values, _SUMS)]


def outliers(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, distance (squared) and keep for every row of docs."""
    store = Store(spark)
    stats = docs.select("doc_id", "lang", "source", "text").mapInArrow(_measure, "doc_id long, lang string, source string, words boolean, " + ", ".join(f"{c} double" for c in STATS))
    lang, source = F.coalesce("lang", F.lit("\x01")), F.coalesce("source", F.lit("\x01"))
    stats = store.table(stats.withColumn("g2", F.concat(F.lit("2"), lang, F.lit("\x02"), source)).withColumn("g1", F.concat(F.lit("1"), lang)), "stats")
    full = stats.where("words")
    sizes = full.groupBy("g2", "g1").agg(F.count(F.lit(1)).alias("n"))
    langs = sizes.groupBy("g1").agg(F.sum("n").alias("n1"))
    used = F.when(F.col("n") >= MIN_GROUP, F.col("g2")).when(F.col("n1") >= MIN_GROUP, F.col("g1")).otherwise(F.lit("0"))
    chosen = store.table(sizes.join(langs, "g1").select("g2", used.alias("g")), "chosen")
    # A language's own estimate needs all its texts, those of large sources too.
    every = full.select(F.explode(F.array(F.col("g2"), F.col("g1"), F.lit("0"))).alias("g"), *STATS)
    rows = store.table(every.join(chosen.select("g").distinct(), "g"), "rows")

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            spread = np.array([(getattr(r, c)[2] - getattr(r, c)[0]) / 1.349 for c in STATS])
            out.append(_row(r.g, 0, [getattr(r, c)[1] for c in STATS], np.diag(1 / (spread**2 + np.square(RIDGE))), np.inf))
            out.append(_row(r.g, 1, *_estimate(np.array([getattr(r, s) for s in _SUMS]), r.n)[:2], np.inf))
        return pd.DataFrame(out, columns=_NAMES)

    def drawn(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(["__rank"])[list(STATS)].to_numpy()
        return pd.DataFrame([_row(pdf["g"].iloc[0], 2 + k, *e[:2], np.inf) for k, e in enumerate(starts(x))], columns=_NAMES)

    def step(reweight: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            found = concentrate(pdf["bin"].to_numpy(), pdf["n"].to_numpy(), pdf[_SUMS].to_numpy(), reweight)
            return pd.DataFrame([_row(pdf["g"].iloc[0], int(pdf["start"].iloc[0]), *found, pdf["before"].iloc[0])], columns=_NAMES)

        return run

    def stepped(rows: DataFrame, now: DataFrame, reweight: bool = False) -> DataFrame:
        at = F.floor(OCTAVE * F.log2(F.greatest(_distance(), F.lit(1e-9)))).cast("long")
        binned = rows.join(now.withColumn("before", F.least("det", "best")), "g").withColumn("bin", at).groupBy("g", "start", "bin").agg(F.count(F.lit(1)).alias("n"), F.first("before").alias("before"), *_sums())
        return binned.groupBy("g", "start").applyInPandas(step(reweight), _ESTIMATE)

    quartiles = [F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(c) for c in STATS]
    begun = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *_sums(), *quartiles).mapInPandas(lambda it: map(first, it), _ESTIMATE)
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64(*STATS), *STATS))
    sampled = rows.withColumn("__rank", rank).where(F.col("__rank") <= SAMPLE).groupBy("g").applyInPandas(drawn, _ESTIMATE)
    now = store.table(begun.unionByName(sampled), "estimate-0")
    done = []
    for turn in range(1, STEPS + 1):
        after = store.table(stepped(rows, now), f"estimate-{turn}")
        done.append(after)
        # Starts that gave a smaller determinant than ever before go on, and only their groups' rows are read again.
        now = after.where(F.col("det") < F.col("best") - REST)
        if not now.limit(1).count():
            break
    for k in range(len(done)):
        every = done[k] if not k else every.unionByName(done[k])
    least = every.groupBy("g").agg(F.min_by(F.struct(*every.columns), F.struct("det", "start")).alias("e")).select("e.*")
    final = store.table(stepped(rows, store.table(least, "least"), True), "final")
    store.drop("rows", *(f"estimate-{k}" for k in range(len(done) + 1)))
    final = chosen.join(final, "g").drop("g", "start", "det", "best")
    d = F.when(F.col("words"), _distance())
    return stats.join(final, "g2", "left").select("doc_id", "lang", "source", F.round(d, 6).alias("distance"), F.coalesce(d <= CUT, F.lit(False)).alias("keep"))

"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic.  The cells' token weights are raked
to three sets of marginals in turn, a fixed number of sweeps.  A cell's factor is its raked
weight over its tokens; each of its documents is then sampled with probability
min(1, c * factor), where c is solved so that the expected tokens are `share` of all tokens.
The draw of a document depends on its doc_id alone.

Targets: a marginal's target is its share of tokens to the power `alpha`, normalised, unless
`targets` names weights for it, as in {"lang": {"en": 2, "de": 1}}; values it doesn't name
get weight 0 there.  The cell table has a row for each combination that occurs, whatever the
number of documents, and is raked in one task.

The topic of a document is what `topics`, a Column over its row, says.  Without one it is a
coarse one from the text's form: markup, legal notes, contacts, numbers or prose.

Defined cases: a null source, language or topic is a value of its own; a null or empty text has no
tokens and, if its whole cell has none, probability `share`; repeated rows are drawn alike,
different rows of a doc_id each by its own cell; a null doc_id draws as the text "null"; a very
long text counts whole; an empty table gives no rows.  Other columns are
neither read nor returned by mix(); sample() keeps them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spillway.llm.store import Store

SHARE, ALPHA, SWEEPS, SEED = 0.6, 0.5, 40, "mix-1"
AXES = ("source", "lang", "topic")
NULL = "(null)"

SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, COALESCE(source, '{NULL}') AS source, COALESCE(lang, '{NULL}') AS lang,
    CASE WHEN contains(t, '|') OR contains(t, '{{{{') OR contains(t, '<') THEN 'markup' WHEN contains(t, 'icense') OR contains(t, 'opyright') THEN 'legal'
      WHEN contains(t, '@') THEN 'contact' WHEN regexp_matches(t, '[0-9]{{{{4}}}}') THEN 'numeric' ELSE 'prose' END AS topic,
    CAST(len(regexp_extract_all(t, '[^ \\t\\n\\r\\f]+')) AS BIGINT) AS tokens
  FROM (SELECT *, COALESCE(text, '') AS t FROM {{docs}})),
c AS (SELECT source, lang, topic, CAST(SUM(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL),
m AS (SELECT *, pow(SUM(tokens) OVER (PARTITION BY source), {ALPHA}) AS ts, pow(SUM(tokens) OVER (PARTITION BY lang), {ALPHA}) AS tl, pow(SUM(tokens) OVER (PARTITION BY topic), {ALPHA}) AS tt, SUM(tokens) OVER () AS total FROM c),
g AS (SELECT source, lang, topic, tokens, total,
  total * ts / (SELECT SUM(x) FROM (SELECT DISTINCT source, ts AS x FROM m)) AS ts,
  total * tl / (SELECT SUM(x) FROM (SELECT DISTINCT lang, tl AS x FROM m)) AS tl,
  total * tt / (SELECT SUM(x) FROM (SELECT DISTINCT topic, tt AS x FROM m)) AS tt FROM m),
rake AS (
  SELECT 0 AS n, source, lang, topic, tokens, total, ts, tl, tt, tokens AS w FROM g
  UNION ALL
  SELECT n + 1, source, lang, topic, tokens, total, ts, tl, tt, COALESCE(w * tt / NULLIF(SUM(w) OVER (PARTITION BY topic), 0), 0) FROM (
    SELECT n, source, lang, topic, tokens, total, ts, tl, tt, COALESCE(w * tl / NULLIF(SUM(w) OVER (PARTITION BY lang), 0), 0) AS w FROM (
      SELECT n, source, lang, topic, tokens, total, ts, tl, tt, COALESCE(w * ts / NULLIF(SUM(w) OVER (PARTITION BY source), 0), 0) AS w FROM rake WHERE n < {SWEEPS}))),
f AS (SELECT source, lang, topic, tokens, total, w, CASE WHEN tokens > 0 THEN w / tokens END AS factor FROM rake WHERE n = {SWEEPS}),
o AS (SELECT *, COALESCE(SUM(tokens) OVER (ORDER BY factor DESC NULLS LAST, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_tokens,
  SUM(w) OVER (ORDER BY factor DESC NULLS LAST, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM f),
k AS (SELECT *, ({SHARE} * total - full_tokens) / NULLIF(rest, 0) AS c FROM o WHERE factor > 0),
best AS (SELECT MAX_BY(c, factor) AS c FROM k WHERE c * factor <= 1),
p AS (SELECT source, lang, topic, COALESCE(factor, 0) AS weight, CASE WHEN tokens = 0 THEN {SHARE} ELSE LEAST(1, COALESCE((SELECT c FROM best) * factor, 1)) END AS p FROM f)
SELECT doc_id, d.source, d.lang, d.topic, d.tokens, ROUND(weight, 6) AS weight, ROUND(p, 6) AS probability,
  CAST('0x' || substr(md5('{SEED}:' || COALESCE(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 < p AS sampled
FROM d JOIN p USING (source, lang, topic)
"""


def topic(text: Column) -> Column:
    """A coarse topic from what the text holds, in SQL's own functions."""
    t = F.coalesce(text, F.lit(""))
    has = lambda s: F.contains(t, F.lit(s))
    return (
        F.when(has("|") | has("{") | has("<"), "markup").when(has("icense") | has("opyright"), "legal")
        .when(has("@"), "contact").when(t.rlike("[0-9]{4}"), "numeric").otherwise("prose")
    )


def rake(cells: pd.DataFrame, targets: dict[str, dict[str, float]], alpha: float = ALPHA, sweeps: int = SWEEPS) -> np.ndarray:
    """Weights of the cells after so many sweeps over source, language and topic."""
    tokens = cells["tokens"].to_numpy(float)
    w, total = tokens.copy(), tokens.sum()
    goals = []
    for axis in AXES:
        code, names = pd.factorize(cells[axis])
        if axis in targets:
            goal = np.array([float(targets[axis].get(x, 0)) for x in names])
        else:
            goal = np.bincount(code, tokens, len(names)) ** alpha
        goals.append((code, goal * (total / goal.sum() if goal.sum() else 0)))
    for _ in range(sweeps):
        for code, goal in goals:
            now = np.bincount(code, w, len(goal))
            w = w * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[code]
    return w


def probabilities(tokens: np.ndarray, w: np.ndarray, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Factor and sampling probability of each cell; the expected tokens are share of all, as far as cells of factor 0 allow."""
    factor = np.divide(w, tokens, out=np.zeros_like(w), where=tokens > 0)
    order = np.argsort(-factor, kind="stable")
    order = order[factor[order] > 0]
    full = np.concatenate([[0.0], np.cumsum(tokens[order])[:-1]]) if len(order) else np.zeros(0)
    rest = np.cumsum(w[order][::-1])[::-1]
    c = np.divide(share * tokens.sum() - full, rest, out=np.zeros_like(rest), where=rest > 0)
    right = np.flatnonzero(c * factor[order] <= 1)
    scale = c[right[0]] if len(right) else np.inf
    p = np.where(factor > 0, np.minimum(1, np.where(factor > 0, scale, 0) * factor), 0.0)
    return factor, np.where(tokens > 0, p, share)


def mix(spark: SparkSession, docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = SHARE, alpha: float = ALPHA, seed: str = SEED, topics: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability, sampled for every row of docs."""
    cell, narrow, solved = _solved(spark, docs, targets, share, alpha, topics)
    return narrow.join(solved, list(AXES)).select(
        "doc_id", *AXES, "tokens", F.round("weight", 6).alias("weight"), F.round("p", 6).alias("probability"), (_draw(seed) < F.col("p")).alias("sampled")
    )


def sample(spark: SparkSession, docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = SHARE, alpha: float = ALPHA, seed: str = SEED, topics: Column | None = None) -> DataFrame:
    """The sampled rows of docs, with all their columns; each row is drawn by the cell it lies in, where it is."""
    cell, _, solved = _solved(spark, docs, targets, share, alpha, topics)
    solved = solved.select(F.struct(*AXES).alias("of"), "p")  # few rows, sent to the texts while the written table is small
    rows = docs.select("doc_id", F.struct(*cell).alias("cell"), F.struct("*").alias("row"))
    return rows.join(solved, F.col("cell") == F.col("of")).where(_draw(seed) < F.col("p")).select("row.*")


def _draw(seed: str) -> Column:
    """A number from 0 to 1 that depends on doc_id alone."""
    name = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return F.conv(F.substring(name, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def _solved(spark, docs, targets, share, alpha, topics):
    """Columns that name a row's cell, the rows without their texts, and the cells with weight and probability."""
    store = Store(spark)
    cell = [F.coalesce("source", F.lit(NULL)).alias("source"), F.coalesce("lang", F.lit(NULL)).alias("lang"), F.coalesce(topic(F.col("text")) if topics is None else topics, F.lit(NULL)).alias("topic")]
    tokens = F.coalesce(F.regexp_count("text", F.lit("[^ \\t\\n\\r\\f]+")), F.lit(0)).cast("long").alias("tokens")
    narrow = store.table(docs.select("doc_id", *cell, tokens), "narrow")

    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(list(AXES), ignore_index=True)
        w = rake(cells, targets or {}, alpha)
        factor, p = probabilities(cells["tokens"].to_numpy(float), w, share)
        return cells[list(AXES)].assign(weight=factor, p=p)

    cells = narrow.groupBy(*AXES).agg(F.sum("tokens").alias("tokens"))
    return cell, narrow, store.table(cells.groupBy().applyInPandas(solve, "source string, lang string, topic string, weight double, p double"), "cells")

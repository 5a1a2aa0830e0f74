"""Language ID by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into stretches of STRETCH bytes.  In each, one recurrent layer
of HIDDEN units reads forwards and one backwards; their states at a position give that
position's probabilities of the languages and of `und`, which is no language.  All positions
of all texts are labelled, and a document's probabilities are the means over its positions.

The network is trained here, in numpy, by backpropagation through time, on stretches at
hashed places of at most TRAIN_DOCS different labelled rows a language (those of least hash of
doc_id and text; a row that is repeated counts once) and on made strings of digits, signs and
hex for `und`.  A shorter text is repeated to the length of a stretch.  Training takes the same time whatever the corpus's size; from 49
labels on it grows with their number, as a step has LEAST_EACH stretches of each at least.

A document is kept if its most probable label is a language of probability MIN_PROBABILITY.  Defined cases: a null or empty
text has no positions, so null language and probability, and isn't kept; documents of null
language don't train; without any labelled document nothing is known, and all texts are
`und`; repeated rows are labelled alike, and a corpus of few texts, each many times, trains on
all of them; a very long text is read whole, stretch by stretch; labels of equal probability
go to the first by name, `und` last; an empty table gives no rows.  Other columns are
neither read nor returned by label(); accepted() keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spillway.llm.store import Store
from spillway.llm.tokens import raw, slices

HIDDEN, STRETCH = 8, 128
TRAIN_DOCS, TRAIN_PLACES, TRAIN_STRETCH, STEPS, BATCH = 600, 4, 48, 220, 192
LEAST_EACH = 4  # stretches of each label in a step, however many labels there are
SPARE = 8
UND, MIN_PROBABILITY = "und", 0.4
SCHEMA = "doc_id long, lang string, probability double, keep boolean, positions array<struct<label:string,n:long>>, runs array<struct<label:string,start:long,stop:long>>"


def init(k: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    r = lambda *s: rng.normal(0, 1, s)
    return {"E": r(2, 256, 3 * hidden) * 0.3, "U": r(2, hidden, 3 * hidden) / np.sqrt(hidden), "W": r(2 * hidden, k) / np.sqrt(hidden), "b": np.zeros(k)}


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def loss_and_gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over all positions of x (time, stretch) for a label y of each stretch, and its gradients."""
    t, n = x.shape
    hid = p["U"].shape[1]
    both = np.stack([x, x[::-1]], 1)  # (time, direction, stretch)
    h = np.zeros((2, n, hid))
    keep, states = [], np.zeros((t, 2, n, hid))
    for s in range(t):
        a = np.stack([p["E"][d][both[s, d]] for d in (0, 1)])
        g = h @ p["U"]
        zr = _sigmoid(a[..., : 2 * hid] + g[..., : 2 * hid])
        z, r = zr[..., :hid], zr[..., hid:]
        c = np.tanh(a[..., 2 * hid :] + r * g[..., 2 * hid :])
        keep.append((h, z, r, c, g[..., 2 * hid :]))
        h = c + z * (h - c)
        states[s] = h
    top = np.concatenate([states[:, 0], states[::-1, 1]], -1)  # (time, stretch, 2 hidden)
    logit = top @ p["W"] + p["b"]
    logit -= logit.max(-1, keepdims=True)
    prob = np.exp(logit)
    prob /= prob.sum(-1, keepdims=True)
    loss = -np.log(prob[:, np.arange(n), y] + 1e-12).mean()
    d = prob.copy()
    d[:, np.arange(n), y] -= 1
    d /= t * n
    out = {"W": top.reshape(-1, 2 * hid).T @ d.reshape(-1, d.shape[-1]), "b": d.sum((0, 1)), "U": np.zeros_like(p["U"]), "E": np.zeros_like(p["E"])}
    dtop = d @ p["W"].T
    dstate = np.stack([dtop[..., :hid], dtop[::-1, :, hid:]], 1)
    da_all = np.zeros((t, 2, n, 3 * hid))
    dh = np.zeros((2, n, hid))
    for s in range(t - 1, -1, -1):
        before, z, r, c, gc = keep[s]
        dh = dh + dstate[s]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (before - c) * z * (1 - z)
        dr = dc * gc * r * (1 - r)
        dg = np.concatenate([dz, dr, dc * r], -1)
        da_all[s] = np.concatenate([dz, dr, dc], -1)
        out["U"] += before.transpose(0, 2, 1) @ dg
        dh = dh * z + dg @ p["U"].transpose(0, 2, 1)
    for k in (0, 1):
        hot = np.zeros((t * n, 256), np.float32)
        hot[np.arange(t * n), both[:, k].ravel()] = 1
        out["E"][k] = hot.T @ da_all[:, k].reshape(t * n, -1).astype(np.float32)
    return loss, out


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients over all stretches, BATCH at a time, so memory doesn't grow with their number."""
    total: dict[str, np.ndarray] = {}
    for lo in range(0, len(y), BATCH):
        _, grad = loss_and_gradients(p, x[:, lo : lo + BATCH], y[lo : lo + BATCH])
        share = len(y[lo : lo + BATCH]) / len(y)
        total = {k: g * share + total.get(k, 0) for k, g in grad.items()}
    return total


def _filled(s: bytes) -> np.ndarray:
    """The first TRAIN_STRETCH bytes of s; a shorter s is repeated, with spaces between."""
    return np.resize(np.frombuffer(s if len(s) >= TRAIN_STRETCH else s + b" ", np.uint8), TRAIN_STRETCH)


def train(stretches: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 7) -> dict:
    """The network, as float32 arrays and the names of its labels."""
    rng = np.random.default_rng(seed)
    names = [*sorted(set(labels) - {UND}), UND]
    p = init(len(names), HIDDEN, rng)
    by = {name: np.array([_filled(s) for s, y in zip(stretches, labels) if y == name], np.uint8).reshape(-1, TRAIN_STRETCH) for name in names}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    names_in = [n for n in names if n == UND or len(by[n])]
    each = max(LEAST_EACH, BATCH // len(names_in))
    for step in range(1, steps + 1):
        x, y = [], []
        for name in names_in:
            x.append(_noise(rng, each) if name == UND else by[name][rng.integers(0, len(by[name]), each)])
            y += [names.index(name)] * each
        grad = _gradients(p, np.concatenate(x).T, np.array(y))
        size = np.sqrt(sum((g * g).sum() for g in grad.values()))
        rate = 0.03 * min(1, step / 20) * (1 - step / (steps + 1)) ** 0.5
        for k, g in grad.items():
            g = g * min(1, 1 / (size + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    hid = HIDDEN
    q = {k: v.astype(np.float32) for k, v in p.items()}
    for k in ("E", "U"):  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
        q[k][..., : 2 * hid] *= 0.5
    return q | {"names": names}


def _noise(rng: np.random.Generator, n: int) -> np.ndarray:
    """Stretches of digits, signs, hex or control bytes."""
    sets = [b"0123456789", b"0123456789 .,-:/", b"!#$%&*+-/<=>?@[]^_{|}~ ", b"0123456789abcdef", bytes(range(1, 32)), b"-=_*# \n", bytes(range(128, 256))]
    out = np.zeros((n, TRAIN_STRETCH), np.uint8)
    for i in range(n):
        s = np.frombuffer(sets[rng.integers(len(sets))], np.uint8)
        out[i] = s[rng.integers(0, len(s), TRAIN_STRETCH)]
    return out


def states(q: dict, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits (label, time, stretch) of stretches of data, and which positions are in them."""
    t, n, hid = int(size.max()), len(start), q["U"].shape[1]
    step = np.arange(t)[:, None]
    inside = step < size
    x = np.zeros((t, 2, n), np.uint8)
    x[:, 0] = data[np.minimum(start + step, len(data) - 1)]
    x[:, 1] = data[np.maximum(start + size - 1 - step, start)]
    h = np.zeros((2, n, hid), np.float32)
    top = np.empty((t, 2, n, hid), np.float32)
    a = np.empty((2, n, 3 * hid), np.float32)
    for s in range(t):
        np.take(q["E"][0], x[s, 0], 0, out=a[0])
        np.take(q["E"][1], x[s, 1], 0, out=a[1])
        g = h @ q["U"]
        zr = np.tanh(a[..., : 2 * hid] + g[..., : 2 * hid])
        zr *= 0.5
        zr += 0.5
        c = zr[..., hid:] * g[..., 2 * hid :]
        c += a[..., 2 * hid :]
        np.tanh(c, out=c)
        h = h - c
        h *= zr[..., :hid]
        h += c
        top[s] = h
    at = np.maximum(size - 1 - step, 0)  # backwards, position p was read at time size - 1 - p
    logit = q["W"][:hid].T @ top[:, 0].reshape(-1, hid).T
    back = (q["W"][hid:].T @ top[:, 1].reshape(-1, hid).T).reshape(-1, t, n)
    logit = logit.reshape(-1, t, n) + back[:, at, np.arange(n)] + q["b"][:, None, None]
    return logit, inside


def predict(q: dict, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled probabilities (document, label) and the label of every byte; a text without bytes has zeros."""
    k, size = len(q["names"]), np.diff(off)
    many = -(-size // STRETCH)
    doc = np.repeat(np.arange(len(size)), many)
    start = off[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * STRETCH
    length = np.minimum(STRETCH, off[1:][doc] - start)
    kind = np.uint8 if k <= 256 else np.int32
    total, label = np.zeros((len(size), k)), np.zeros(len(data), kind)
    order = np.argsort(-length, kind="stable")  # stretches of like length together
    for lo in range(0, len(order), 2048):
        of = order[lo : lo + 2048]
        logit, inside = states(q, data, start[of], length[of])
        best = logit[0].copy()
        which = np.zeros(best.shape, kind)
        for j in range(1, k):
            more = logit[j] > best
            which[more] = j
            np.maximum(best, logit[j], out=best)
        logit -= best
        np.exp(logit, out=logit)
        logit *= inside / logit.sum(0)
        pooled = logit.sum(1, dtype=np.float64)
        for j in range(k):
            total[:, j] += np.bincount(doc[of], pooled[j], len(size))
        place = (start[of] + np.arange(len(which))[:, None])[inside]
        label[place] = which[inside]
    return total / np.maximum(size, 1)[:, None], label


def model(spark: SparkSession, docs: DataFrame) -> dict:
    """Trained on the labelled rows of least hash, at most TRAIN_DOCS different ones for each language."""
    labelled = docs.where("lang IS NOT NULL AND text != ''").select("lang", "text", F.xxhash64("doc_id", "text", F.lit(11)).alias("hash"))
    # The least hashes of a language are sought below a bound that SPARE times as many different rows should pass, so no task sorts a language.
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n"))
    counts = Store(spark).table(counts, "languages")  # a written table: small ones are sent to the texts, which stay where they are
    bound = F.lit(-(2.0**63)) + F.least(F.lit(1.0), F.lit(float(SPARE * TRAIN_DOCS)) / F.col("n")) * F.lit(2.0**64)
    near = labelled.join(counts, "lang").where(F.col("hash") <= bound)
    places = F.expr(f"transform(sequence(0, {TRAIN_PLACES - 1}), i -> substring(text, 1 + cast(pmod(xxhash64(hash, i), greatest(1, length(text) - {TRAIN_STRETCH})) as int), {TRAIN_STRETCH}))")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    picks = near.groupBy("lang", "hash").agg(F.min(places).alias("places")).withColumn("k", rank).where(F.col("k") <= TRAIN_DOCS)
    rows = sorted(tuple(r) for r in picks.select("hash", "lang", F.explode("places").alias("s")).where("s != ''").collect())
    return train([s.encode() for _, _, s in rows], [y for _, y, _ in rows])


def _label(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        names = pa.array(q["names"])
        for batch in batches:
            for part in slices(batch, most=1 << 19):
                data, off = raw(part.column(1))
                prob, label = predict(q, data, off)
                has = np.diff(off) > 0
                top = prob.argmax(1)
                lang = names.take(pa.array(top, mask=~has))
                new = np.zeros(len(data) + 1, bool)
                if len(data):
                    new[1:-1] = label[1:] != label[:-1]
                new[off] = True
                start = np.flatnonzero(new[: len(data)])
                stop = np.r_[start[1:], len(data)][: len(start)]
                base = off[np.searchsorted(off, start, "right") - 1]
                runs = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(start, off).astype(np.int32)),
                    pa.StructArray.from_arrays([names.take(pa.array(label[start])), pa.array(start - base), pa.array(stop - base)], ["label", "start", "stop"]),
                )
                doc = np.repeat(np.arange(part.num_rows), np.diff(off))
                k = len(names)
                n = np.bincount(doc * k + label, minlength=part.num_rows * k)
                some = np.flatnonzero(n)
                positions = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(some, np.arange(part.num_rows + 1) * k).astype(np.int32)),
                    pa.StructArray.from_arrays([names.take(pa.array(some % k)), pa.array(n[some])], ["label", "n"]),
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lang, pa.array(np.where(has, prob.max(1), np.nan), from_pandas=True), pa.array(has & (top != k - 1) & (prob.max(1) >= MIN_PROBABILITY)), positions, runs],
                    ["doc_id", "lang", "probability", "keep", "positions", "runs"],
                )

    return run


def label(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Language, pooled probability, whether it is kept, positions of each label and runs of them, for every row of docs."""
    docs = docs.select("doc_id", "text", "lang")
    shared = spark.sparkContext.broadcast(model(spark, docs))
    return docs.select("doc_id", "text").mapInArrow(_label(shared), SCHEMA)


def accepted(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that label() keeps, with all their columns."""
    shared = spark.sparkContext.broadcast(model(spark, docs.select("doc_id", "text", "lang")))

    @F.arrow_udf("boolean")
    def keep(text: pa.Array) -> pa.Array:
        out = []
        for part in slices(pa.RecordBatch.from_arrays([text], ["text"]), most=1 << 19):
            data, off = raw(part.column(0))
            prob, _ = predict(shared.value, data, off)
            out.append((np.diff(off) > 0) & (prob.argmax(1) != prob.shape[1] - 1) & (prob.max(1) >= MIN_PROBABILITY))
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.where(keep(F.col("text")))

"""PII by candidate gradient boosting.

Generators of high recall propose spans, which may overlap: addresses, digit runs of many
shapes (for telephones all whole groups that have 7 to 15 digits together), and keys of any
length.  Boosted trees give each span a probability, from its format (checksum, octets,
group sizes, neighbours) and from the words around it.  Each kind's threshold is the least
at which held-out spans reach the wanted precision, after Platt calibration.  Spans over
their thresholds are taken in order of probability (in hundredths), then length, place and
kind; a span that overlaps a taken one is dropped.  Taken spans are replaced by their kind, as in [CARD].

The trees are trained here on EXAMPLES made spans and on parts of their numbers, seeded, no
text of the corpus among them: valid and invalid cards, telephones of several countries,
addresses, and the numbers that look like them (orders, dates, versions, prices, lists,
hashes in prose).

Defined cases: a null text stays null, without spans; an empty text stays empty; repeated
rows are redacted alike; a very long text is read whole; an empty table gives no rows.  Other
columns are neither read nor returned.  Offsets count characters of the original text.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXAMPLES, TREES, DEPTH, BINS, RATE = 6000, 60, 3, 24, 0.3
PRECISION = 0.97
PHONE = (7, 15)  # digits of a telephone number, with its country's
KINDS = ("email", "phone", "card", "ip", "ssn", "iban", "secret")
GENERATORS = {
    "email": re.compile(r"[^\W_][\w.%+\-]{0,63}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,6}|(?<!\w)[\w.%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,6}"),
    "phone": re.compile(r"(?<![\w.])(?:\+?(?:\d{1,4}[ .\-/]?)?\(\+?\d{1,5}\)[ .\-/]?|\+)?\d{1,15}(?:(?: ?[\-/] ?|[ .])\d{1,15})*(?!\w|\.\d)"),  # a run of groups; numbers() gives the parts of it
    "card": re.compile(r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)"),
    "ip": re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"),
    "ssn": re.compile(r"(?<![\w\-])\d{3}[\- ]\d{2}[\- ]\d{4}(?![\w\-])"),
    "iban": re.compile(r"(?<!\w)[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?(?!\w)"),
    "secret": re.compile(r"[A-Za-z0-9_\-/+]{16,}={0,2}"),  # of any length; borders() sees to what is around
}
_CUES = {
    "email": "mail contact write reply address correo",
    "phone": "phone tel call mobile fax cell whatsapp telefon",
    "card": "card visa credit payment debit mastercard karte carte tarjeta",
    "ip": "ip host server addr client login from",
    "ssn": "ssn social security",
    "iban": "iban bank account konto transfer",
    "secret": "token key secret password passwd pwd api auth bearer credential session",
    "not": "version order invoice isbn release build date price total room commit sha checksum id nr",
}
_CUE = {k: re.compile(r"(?<![^\W_])(?:" + "|".join(v.split()) + r")", re.I) for k, v in _CUES.items()}
_TLD = frozenset("com org net edu gov io co de fr es uk us info biz eu me app dev ai ch at it nl ru cn jp br".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)  # of any script
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def borders(text: str, start: int, end: int) -> tuple[int, int]:
    """A run of a key's characters without what is joined to other letters at either end; of no length if nothing stays."""
    if start and (text[start - 1].isalnum() or text[start - 1] in "_/+"):
        start = text.find("-", start, end) + 1 or end
    if re.match(r"[\w/+]", text[end : end + 1]):
        end = end - 1 if text[end - 1] == "=" else text.rfind("-", start, end)
    return start, max(start, end)


def numbers(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """All spans of whole groups of a run with as many digits as a telephone number has."""
    groups = [(m.start(), m.end()) for m in re.finditer(r"\d+", text[start:end])]
    for i, (a, _) in enumerate(groups):
        lead = len(re.search(r"(?:\(?\+)?\(?$", text[start : start + a])[0])
        total = 0
        for k in range(i, len(groups)):
            total += groups[k][1] - groups[k][0]
            if total > PHONE[1]:
                break
            if total >= PHONE[0]:
                yield start + a - lead, start + groups[k][1]


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    for kind, pattern in GENERATORS.items():
        for m in pattern.finditer(text):
            if kind == "phone":
                yield from ((a, b, kind) for a, b in numbers(text, *m.span()))
                continue
            start, end = borders(text, *m.span()) if kind == "secret" else m.span()
            if kind != "secret" or len(text[start:end].rstrip("=")) >= 16 and re.search(r"\d", text[start:end]):
                yield start, end, kind


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    s = text[start:end]
    digits = re.sub(r"\D", "", s)
    groups = [len(x) for x in re.findall(r"\d+", s)]
    before, after = text[max(0, start - 32) : start], text[end : end + 24]
    around = before + " " + after
    n = len(s)
    low, up = sum(c.islower() for c in s), sum(c.isupper() for c in s)
    seen = len(set(s))
    host = s.rpartition("@")[2].lower() if "@" in s else ""
    return [
        *(float(kind == k) for k in KINDS),
        n, len(digits), len(groups), groups[0] if groups else 0, groups[-1] if groups else 0, max(groups, default=0),
        float(len(digits) > 11 and luhn(digits)),
        float(digits[:1] in ("3", "4", "5", "6")),
        float(kind == "ip" and all(int(x) < 256 for x in s.split("."))),
        float(kind == "iban" and iban_ok(s)),
        float(s.startswith("+")), float("(" in s), s.count("-"), s.count(" "), s.count("."),
        low / n, up / n, seen / n, float(low > 0 and up > 0), float(bool(re.fullmatch(r"[0-9a-f]+", s))),
        float(host.rpartition(".")[2] in _TLD), len(host),
        float(before[-1:].isalnum()), float(before[-1:] in ("=", ":", '"', "'")), float(before[-2:] in ("= ", ": ", "=\"", ":\"", "='")), float(before.endswith(('= "', "= '", ': "'))),
        float(re.search(r"\d\)?(?: ?[\-/] ?|[ .])?\(?$", before) is not None), float(re.match(r"(?! \d{1,3}(?:\.\d{1,3}){3}(?![\d.]))(?: ?[\-/] ?|[ .])\d", after) is not None), groups[1] if len(groups) > 1 else 0, min(groups, default=0), s.count("/"), float(s[:1] == "0"),
        float(after[:1].isalnum()), float(bool(re.match(r"[.,]?\d", after))),
        *(float(bool(p.search(before))) for p in _CUE.values()),
        float(bool(_CUE["not"].search(around))),
        float(re.match(r"(?:19|20)\d\d[-. /]\d\d?[-. /]\d\d?", s) is not None or re.match(r"\d\d?[-. /]\d\d?[-. /](?:19|20)\d\d", s) is not None),
    ]


def _card(r: random.Random) -> str:
    head = r.choice(["4", "4", "51", "55", "34", "37", "6011", "65"])
    size = 15 if head[0] == "3" else 16
    body = head + "".join(r.choice("0123456789") for _ in range(size - 1 - len(head)))
    return next(body + d for d in "0123456789" if luhn(body + d))


def _iban(r: random.Random) -> str:
    land, body = r.choice(["DE", "FR", "ES", "GB"]), "".join(r.choice("0123456789") for _ in range(18))
    rest = int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
    return f"{land}{98 - rest:02d}{body}"


def examples(n: int = EXAMPLES, seed: int = 5) -> list[tuple[str, int, int, str, int]]:
    """(text, start, end, kind, whether it is private) of the candidates in made sentences; n of them, and those that are no telephone numbers beside."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 9)))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789") for _ in range(k))
    cue = lambda kind, p=0.35: r.choice(_CUES[kind].split()) + r.choice([" ", ": ", " is ", " no. "]) if r.random() < p else ""
    split4 = lambda s: r.choice([s, s, s, " ".join(s[i : i + 4] for i in range(0, len(s), 4)), "-".join(s[i : i + 4] for i in range(0, len(s), 4))])
    octets = lambda most: ".".join(str(r.randint(1, most)) for _ in range(4))
    area = lambda: r.choice("123456789") + num(r.randint(1, 3))
    pairs = lambda k: " ".join(num(2) for _ in range(k))
    land = lambda: r.choice(["+49", "+43", "+41", "+33", "+34", f"+{r.randint(2, 99)}", f"+{r.randint(200, 999)}", "0049", "0033", "0034"])
    abroad = [
        lambda: f"0{area()}{r.choice([' ', '/', '-', ' / ', ' - '])}{num(r.randint(5, 8))}", lambda: f"(0{area()}){r.choice([' ', '', '/', '-'])}{num(r.randint(5, 8))}", lambda: f"0{area()}{r.choice([' ', '/'])}{num(r.randint(2, 4))} {pairs(2)}",
        lambda: f"{land()} {r.choice(['', '(0)', '(0) '])}{area()}{r.choice([' ', '/', '-'])}{num(r.randint(5, 8))}", lambda: f"{land()} {area()} {num(3)} {num(r.randint(2, 5))}", lambda: f"{land()} {r.randint(1, 9)} {pairs(4)}", lambda: f"{land()} {num(r.randint(9, 11))}",
        lambda: f"0{r.randint(1, 9)}{r.choice([' ', '.', '-'])}{pairs(4).replace(' ', r.choice([' ', '.', '-']))}", lambda: f"0{num(r.randint(9, 11))}", lambda: f"{land()} {num(3)} {pairs(3)}", lambda: f"({land()}) {area()} {num(r.randint(5, 8))}", lambda: f"1-{num(3)}-{num(3)}-{num(4)}", lambda: f"{r.choice('6789')}{num(2)} {r.choice([f'{num(3)} {num(3)}', pairs(3)])}",
    ]
    phone = lambda: r.choice([f"+1 ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{r.randint(2, 99)} {num(3)} {num(3)} {num(4)}", f"+{r.randint(2, 99)}{num(10)}", f"{num(3)}.{num(3)}.{num(4)}", *(f() for f in abroad)])
    invalid = lambda: next(s for s in iter(lambda: num(r.choice([13, 14, 15, 16, 16, 16, 18])), None) if not luhn(s))
    good = {
        "email": lambda: cue("email") + r.choice(["", ".", word() + ".", word()]) + r.choice([num(2), word(), word() + num(2)]) + "@" + word() + r.choice(["", num(1)]) + r.choice(["", "." + word(), ".example"]) + "." + r.choice(sorted(_TLD)),
        "phone": lambda: cue("phone") + phone() if r.random() < 0.93 else cue("phone", 1) + f"{num(3)}-{num(4)}",
        "card": lambda: cue("card") + split4(_card(r)),
        "ip": lambda: cue("ip") + octets(255),
        "ssn": lambda: cue("ssn", 0.6) + f"{num(3)}-{num(2)}-{num(4)}",
        "iban": lambda: cue("iban") + r.choice([lambda s: s, lambda s: " ".join(s[i : i + 4] for i in range(0, len(s), 4))])(_iban(r)),
        "secret": lambda: r.choice(_CUES["secret"].split()) + r.choice(["=", " = ", ": ", ":", ' = "', '="']) + r.choice([hexa(r.choice([16, 32, 40, 64])), mixed(r.randint(20, 44)), r.choice([hexa(r.choice([128, 256, 512])), mixed(r.randint(45, 1200)) + r.choice(["", "=", "=="])])]),
    }
    bad = [
        lambda: cue("not", 0.5) + split4(invalid()),
        lambda: cue("not", 0.5) + num(r.randint(5, 12)),
        lambda: r.choice(["version ", "release ", "build ", "v "]) + r.choice([f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"{num(1)}.{num(1)}"]),
        lambda: ".".join(str(r.choice([r.randint(256, 999), r.randint(1, 999)])) for _ in range(3)) + f".{r.randint(256, 999)}",
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
        lambda: f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1900, 2030)}",
        lambda: f"{r.randint(1, 99)} {num(3)} {num(3)}",
        lambda: r.choice([" ", " ", "-", "/", "."]).join(str(r.randint(0, r.choice([9, 30, 99]))) for _ in range(r.randint(4, 14))),
        lambda: f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/{r.randint(1900, 2030)}" + r.choice(["", " ", " - "]) + r.choice(["", f"{num(2)}:{num(2)}"]),
        lambda: f"{num(4)}{r.choice(['-', '/', ' - '])}{num(4)}",
        lambda: f"{r.randint(1, 400)} {r.randint(10, 99)}-{r.randint(10, 99)}",
        lambda: r.choice(["commit ", "sha ", "checksum ", "build "]) + hexa(r.choice([32, 40, 64])),
        lambda: "-".join(word() for _ in range(4)) + num(1),
        lambda: word() + word() + word() + num(2),
        lambda: word() + "@" + word() + "." + r.choice(["x", "local1", num(2)]),
        lambda: f"{num(3)} {num(2)} {num(4)}",
        lambda: f"{r.choice(['AB', 'XK', 'ZZ'])}{num(2)} {num(4)} {num(4)} {num(4)}",
        lambda: "/" + word() + "/" + word() + "/" + word() + num(2) + "/" + word(),
        lambda: r.choice("-/_").join(word() + r.choice(["", "", num(1)]) for _ in range(r.randint(16, 120))) + num(1),
    ]
    out, count = [], 0
    while count < n:
        kind = r.choice(KINDS) if r.random() < 0.5 else None
        core = good[kind]() if kind else r.choice(bad)()
        left, right = " ".join(word() for _ in range(5)), " ".join(word() for _ in range(4))
        if kind and r.random() < 0.2:  # another number beside it
            beside = r.choice([num(r.randint(1, 9)), octets(255)])
            left, right = (f"{left} {beside}", right) if r.random() < 0.5 else (left, f"{beside} {right}")
        text = left + r.choice([" ", " ", ". ", "\n"]) + core + r.choice([" ", ". ", ", ", '" ', ".\n"]) + right
        lo = len(left)
        for a, b, k in candidates(text):
            if b > lo and a < lo + len(core) + 2:
                # the whole private string; other kinds' candidates over it are negatives
                want = {"email": "@" in text[a:b], "secret": b - a >= 16}.get(kind, True)
                full = re.sub(r"\D", "", text[a:b]) == re.sub(r"\D", "", core) if kind in ("phone", "card", "ip", "ssn", "iban") else True
                out.append((text, a, b, k, int(k == kind and want and full)))
                count += k != "phone" or out[-1][4]  # the many parts of a number don't stand in for other kinds
    return out


class Trees:
    """Gradient boosting of logistic loss over binned features, in numpy."""

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
        self.depth = depth
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)))[:-1] for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        f = np.full(len(y), self.base)
        inner = 2**depth - 1
        self.feature = np.zeros((trees, inner), np.int64)
        self.cut = np.full((trees, inner), np.inf)
        self.value = np.zeros((trees, 2**depth))
        wide = BINS + 1
        flat = binned + np.arange(x.shape[1]) * wide
        for t in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                for k in range(2**level):
                    of = np.flatnonzero(node == k)
                    at = 2**level - 1 + k
                    if len(of) < 10:
                        continue
                    G, H = (np.bincount(flat[of].ravel(), np.repeat(v[of], x.shape[1]), x.shape[1] * wide).reshape(-1, wide).cumsum(1) for v in (g, h))
                    G1, H1 = G[0, -1], H[0, -1]
                    gain = (G**2 / (H + 1) + (G1 - G) ** 2 / (H1 - H + 1) - G1**2 / (H1 + 1))[:, :-1]
                    j, b = np.unravel_index(np.argmax(gain), gain.shape)
                    if gain[j, b] > 1e-6 and b < len(edges[j]):
                        self.feature[t, at], self.cut[t, at] = j, edges[j][b]
                node = 2 * node + (x[np.arange(len(y)), self.feature[t, 2**level - 1 + node]] > self.cut[t, 2**level - 1 + node])
            top, low = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
            self.value[t] = rate * top / (low + 1)
            f = f + self.value[t, node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f, row = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[row, feature[at]] > cut[at])
            f = f + value[node]
        return f


def platt(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the calibrated log odds, by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-(a * f + b)))
        w = p * (1 - p) + 1e-9
        g = np.array([((y - p) * f).sum() - 1e-2 * (a - 1), (y - p).sum() - 1e-2 * b])
        H = np.array([[(w * f * f).sum() + 1e-2, (w * f).sum()], [(w * f).sum(), w.sum() + 1e-2]])
        a, b = np.array([a, b]) + np.linalg.solve(H, g)
    return a, b


class Model:
    def __init__(self, made: list[tuple] | None = None):
        made = made or examples()
        x = np.array([features(*e[:4]) for e in made], float)
        y = np.array([e[4] for e in made], float)
        kind = np.array([KINDS.index(e[3]) for e in made])
        hold = np.arange(len(y)) % 3 == 2
        self.trees = Trees().fit(x[~hold], y[~hold])
        f = self.trees.score(x[hold])
        self.a, self.b = platt(f, y[hold])
        p = 1 / (1 + np.exp(-(self.a * f + self.b)))
        self.threshold = np.full(len(KINDS), 0.5)
        for k in range(len(KINDS)):
            of = kind[hold] == k
            order = np.argsort(-p[of])
            right = np.cumsum(y[hold][of][order]) / np.arange(1, of.sum() + 1)
            ok = np.flatnonzero(right >= PRECISION)
            if len(ok):
                self.threshold[k] = min(max(p[of][order][ok[-1]], 0.05), 0.95)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a * self.trees.score(x) + self.b)))

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        """The spans of each text that are to be redacted, in order."""
        out: list[list] = [[] for _ in texts]
        found = [(k, *c) for k, t in enumerate(texts) for c in candidates(t)]
        if not found:
            return out
        x = np.array([features(texts[k], a, b, kind) for k, a, b, kind in found], float)
        p = self.probability(x)
        order = sorted((i for i in range(len(found)) if p[i] >= self.threshold[KINDS.index(found[i][3])]), key=lambda i: (-round(p[i], 2), found[i][1] - found[i][2], found[i][1], KINDS.index(found[i][3])))
        for i in order:
            k, a, b, kind = found[i]
            at = bisect_left(out[k], (a,))  # taken spans are kept in order, and don't overlap
            if (at == 0 or out[k][at - 1][1] <= a) and (at == len(out[k]) or out[k][at][0] >= b):
                out[k].insert(at, (a, b, kind, float(round(p[i], 6))))
        return out


def replaced(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    out, at = [], 0
    for a, b, kind, _ in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


_RESULT = "struct<text:string,spans:array<struct<start:int,stop:int,kind:string,probability:double>>>"


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, the redacted text, and the spans that were redacted, for every row of docs."""
    shared = spark.sparkContext.broadcast(Model())

    @F.arrow_udf(_RESULT)
    def run(text: pa.Array) -> pa.Array:
        texts = text.to_pylist()
        rows = [None] * len(texts)
        some = [i for i, t in enumerate(texts) if t is not None]
        for lo in range(0, len(some), 500):
            part = some[lo : lo + 500]
            for i, spans in zip(part, shared.value.spans([texts[i] for i in part])):
                if spans:
                    rows[i] = {"text": replaced(texts[i], spans), "spans": [{"start": a, "stop": b, "kind": k, "probability": p} for a, b, k, p in spans]}
        kind = pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("probability", pa.float64())])))])
        return pa.array(rows, kind)

    # Every generator needs a digit, of any script, or an @: texts without either stay in the JVM.
    may = F.when(F.col("text").rlike(r"[\p{Nd}@]"), F.col("text"))
    empty = F.expr("cast(array() as array<struct<start:int,stop:int,kind:string,probability:double>>)")
    return docs.select("doc_id", "text").withColumn("r", run(may)).select("doc_id", F.coalesce("r.text", "text").alias("text"), F.coalesce("r.spans", empty).alias("spans"))

"""The pipeline, stage by stage, on a small corpus with every awkward row, against brute force on texts."""

import random
import re

import pytest
from test_small import brute_links

import corpus_pipeline
from spillway.llm import language_id, mixing

SOUNDS = {"en": "the and ing ion ent her tha".split(), "de": "sch ich ein und ver lich ung".split()}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, tokens string, __p string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    say = lambda la, n: " ".join("".join(r.choice(SOUNDS[la]) for _ in range(r.randint(1, 4))) for _ in range(n))
    bench = [(k, say("en", 30)) for k in range(5)] + [(5, "the"), (6, None)]
    docs = [(k, say(la, 50 + k % 60), la, f"s{k % 3}") for k, la in enumerate(["en", "de"] * 60)]
    docs += [(500, docs[0][1], "en", "s0"), (501, docs[1][1] + " extra", "de", "s1"), (502, docs[0][1], "en", "s0"), (503, "", "en", "s0"), (504, None, "en", "s1"), (505, "0123 4567 " * 40, None, "s2")]
    docs += [(600 + k, say("en", 20) + " " + b[1], "en", "s0") for k, b in enumerate(bench[:5])]
    docs += [(700, say("en", 70_000), "en", None), (None, say("de", 60), "de", "s1"), (None, docs[0][1], "en", "s0"), (701, say("en", 40), None, "s2"), (3, say("de", 45), "de", "s9"), (4, docs[4][1], "en", "s1"), (600, say("en", 64), "en", "s2")]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*x, len(x[1] or ""), "clash", "clash", "clash") for x in docs], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, bench


def pairs(rows):
    return sorted((str(a), str(b)) for a, b in rows)


def test_stages(spark, folder, tmp_path, duck):
    d, _, bench = folder
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    now, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = now.columns
    kept.append([(x.doc_id, x.text, x.lang, x.source) for x in now.collect()])
    labels = {(x.doc_id, x.n): x.keep for x in language_id.label(spark, now).selectExpr("doc_id", "aggregate(positions, 0L, (a, p) -> a + p.n) AS n", "keep").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, d).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert now.columns == columns, name
            assert all(x.h == x.tokens == x["__p"] == "clash" for x in now.collect())
            kept.append([(x.doc_id, x.text, x.lang, x.source) for x in now.collect()])
    # 1. Language: what label() keeps, junk and empty texts gone.
    size = lambda t: len((t or "").encode())
    assert pairs(x[:2] for x in kept[1]) == pairs(x[:2] for x in kept[0] if labels[x[0], size(x[1])])
    assert {x[0] for x in kept[0]} - {x[0] for x in kept[1]} == {503, 504, 505}
    # 2. One document of each class of links; rows of null doc_id stay, repeated rows don't.
    _, stay = brute_links(kept[1])
    assert pairs(x[:2] for x in kept[2]) == pairs(stay + [x[:2] for x in kept[1] if x[0] is None])
    assert len(kept[1]) - len(kept[2]) == 4
    # 3. Texts without a test string of an item of five words or more.
    plain = lambda s: " " + " ".join(re.findall(r"[^\W_]+", (s or "").lower())) + " "
    words = [w for w in (plain(b[1]).split() for b in bench) if len(w) >= 5]
    strings = {f" {' '.join(w[i : i + 13])} " for w in words for i in range(max(1, len(w) - 12))}
    assert pairs(x[:2] for x in kept[3]) == pairs(x[:2] for x in kept[2] if not any(s in plain(x[1]) for s in strings))
    assert len(kept[2]) - len(kept[3]) == 5
    # 4. The rows that the SQL samples.
    rows = [dict(x) for x in duck(mixing.SQL.format(docs="documents"), documents=kept[3])]
    want = sorted((str(x["doc_id"]), x["source"], x["lang"], x["tokens"]) for x in rows if x["sampled"])
    name = lambda s: mixing.NULL if s is None else s
    assert sorted((str(a), name(s), name(la), len(t.split())) for a, t, la, s in kept[4]) == want and 0 < len(kept[4]) < len(kept[3])
    # 5. First bytes and shards.
    total = sum(size(x[1]) for x in kept[4])
    step, at = -(-total // 64), 0
    out = sorted(now.collect(), key=lambda x: (x.doc_id is not None, x.doc_id or 0, x.n_bytes))
    assert sorted((str(x.doc_id), x.n_bytes) for x in out) == sorted((str(x[0]), size(x[1])) for x in kept[4])
    for x in out:
        assert (x.start_byte, x.shard) == (at, at // step)
        at += x.n_bytes
    assert sorted(map(str, corpus_pipeline.run(spark, d).collect())) == sorted(map(str, now.collect()))


def test_an_empty_corpus(spark, folder, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{folder[0]}/benchmark.parquet").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0

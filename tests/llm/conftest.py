import duckdb
import pandas as pd
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    def make(rows, extra=True):
        """Documents of (doc_id, text[, lang, source]); with extra columns whose names clash with those inside the operators."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        if extra:
            for name in ("h", "place", "rep", "part", "n", "g", "later", "size", "tokens", "p", "topic", "step", "keep", "distance", "words"):
                df = df.selectExpr("*", f"'clash' AS {name}")
        return df

    return make


@pytest.fixture(scope="session")
def duck():
    def run(sql, **tables):
        c = duckdb.connect()
        for name, rows in tables.items():
            if name == "documents":
                df = pd.DataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s") for r in rows], columns=["doc_id", "text", "lang", "source"])
                df["doc_id"] = df["doc_id"].astype("Int64")
            else:
                df = pd.DataFrame(rows, columns=["item_id", "text"])
            c.register("x_" + name, df)
            kinds = "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR" if name == "documents" else "item_id BIGINT, text VARCHAR"
            c.execute(f"CREATE TABLE {name} ({kinds})")
            c.execute(f"INSERT INTO {name} SELECT * FROM x_{name}")
        r = c.execute(sql)
        names = [x[0] for x in r.description]
        return sorted((tuple(sorted(zip(names, row))) for row in r.fetchall()), key=repr)

    return run


@pytest.fixture(scope="session")
def rows():
    return lambda df: sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=repr)

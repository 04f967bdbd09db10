import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from oracle_check import rows_of

DOCS = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
        "size bigint, stratum string, root bigint, tkey string, score double, node string, id bigint")


def prose(rng: random.Random, n: int) -> str:
    stems = ["an", "er", "ti", "on", "re", "st", "ou", "he", "é", "日本"]
    words = ["".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return "".join(w + rng.choice([" "] * 9 + ["\n"]) for w in words)


@pytest.fixture(scope="session")
def doc_rows():
    """Edge cases: NULLs, empty and blank texts, copies, near copies, a long text, a
    passage in many documents, repeated rows, equal ids, symbols, special tokens."""
    rng = random.Random(11)
    base = [prose(rng, n) for n in (40, 90, 300, 12, 60, 25)]
    passage = prose(rng, 70)
    texts = [None, "", " \n\t", "one", "four words are here", "a b c d e", "x" * 400, "ab " * 60, "a\u0085b c\x1cd e f g h i j k",
             "<|endoftext|> end <|endoftext|>", *base, *base[:3]]
    for b in base[:3]:
        w = b.split(" ")
        for k in (3, len(w) // 2):
            texts.append(" ".join(w[:k] + ["edit"] + w[k + 1:]))
    texts += [prose(rng, 20) + passage + prose(rng, 15) for _ in range(4)]
    texts += [prose(rng, 40000)]
    texts += [" ".join(w + "###" for w in base[1].split()), "| cell " * 30 + base[4], (base[4] + "\n") * 3]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i * 3 % 41, t, [None, "en", "fr"][i % 3], [None, "b", "a", "ä"][i % 4], 1, 7, "s", 3, "k", 0.5, "n", 1))
    rows.append(rows[12])                     # a repeated row
    rows.append((5, base[2], "en", "b", None, None, None, None, None, None, None, None))   # an id that exists
    rows.append((None, base[1], "en", "b", None, None, None, None, None, None, None, None))
    rows.append((None, "null id " * 20, None, None, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter(F.lit(False))


@pytest.fixture
def same_as_sql(tmp_path):
    """Compare a DataFrame with a DuckDB statement over the given tables."""

    def check(df, sql, **tables):
        con = duckdb.connect()
        for name, t in tables.items():
            t.coalesce(1).write.parquet(str(tmp_path / name))
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path / name}/*.parquet')")
        rel = con.sql(sql)
        want = rows_of(rel.columns, rel.fetchall())
        got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        assert got[0] == want[0]
        assert json.dumps(got[1], default=str) == json.dumps(want[1], default=str)
        return got[1]

    return check

"""Small fixtures and brute-force helpers for the tests of the text operators."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs(spark, texts, ids=None, lang=None, parts=3):
    rows = [(ids[i] if ids else i, t, lang[i] if lang else "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def odd_docs(spark, texts, ids=None):
    """The same with extra columns whose names clash with those the operators use."""
    df = docs(spark, texts, ids)
    for name in ("fp", "row", "digest", "component_id", "Text", "n", "keep_id", "key", "words"):
        df = df.selectExpr("*", f"doc_id AS `{name}`")
    return df


def words(rng: random.Random, n: int, vocabulary: int = 5000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def classes(n, links):
    parent = list(range(n))
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [find(parent, i) for i in range(n)]

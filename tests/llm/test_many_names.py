"""Surrogates of more names than the lists have."""

import re

from pyspark.sql import functions as F

from linework.llm import common, pii


def test_tens_of_thousands_of_names(spark):
    letters = "абвгдежзиклмнопр"
    cyrillic = lambda i: "".join(letters[i >> s & 15] for s in (12, 8, 4, 0))
    names = [f"name{i}" for i in range(20_000)] + [f"a name{i}" for i in range(20_000)] + [cyrillic(i) for i in range(20_000)] + [f"{cyrillic(i)} {cyrillic(i)}" for i in range(10_000)]
    ents = spark.createDataFrame([("name", n, i % 2 == 0) for i, n in enumerate(names)], "kind string, canon string, female boolean")
    got = pii.surrogates(common.cut(ents)).withColumn("norm", pii.canonical(F.col("new"), F.col("kind"))).toPandas()
    assert len(got) == len(names) and not got.norm.duplicated().any() and not set(got.norm) & set(names)
    for r in got.itertuples():
        word = "[А-Я][а-я]+" if re.search("[а-я]", r.canon) else "[A-Z][a-z]+"
        assert re.fullmatch(rf"{word} {word}" if " " in r.canon else word, r.new)

"""Small tables with what operators must stand: nulls, empty and long texts, ties, repeated rows, extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta Epsilon zeta ETA theta iota kappa naïve straße 漢字 x1 token=abcdef12 a;b".split()


def documents() -> list[tuple]:
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    shared, long_text = prose(60), prose(6000)
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "two words", "three little words", "a b   c\x85d", shared, f"{prose(9)} {shared} {prose(5)}", f"{shared}\n{prose(30)}", shared, shared, long_text, f"{long_text} {shared}", "la " * 400, "line one here\nline one here\n\nother\nline one here", prose(80).upper(), "퟿ end \U0001f600 \x00 nul", "▁ under\n\n▁▁ line  two   spaces", "x" * 3000, "x#y$ & <tag> | *", "AKIA" + "Q7" * 9, "AKIASHORT", "api_key='abcDEF123456' Secret: zzzzzzz password=12345", "ab" * 12 + " " + "0123456789abcdef" * 3, f"token={'a1' * 14}"]
    rows = [(i * 3 % 101, t, ("en", "de", None)[i % 3], ("hot", "b", None, "c")[min(i % 7, 3)], len(t or "")) for i, t in enumerate(texts)]
    rows += [(200 + i, prose(rng.randrange(5, 120)), "en", "hot", 1) for i in range(60)]
    rows += [(300 + i, shared if i % 2 else f"{shared} tail{i}", "de", "b", 1) for i in range(20)]
    return rows


def extra(docs):
    """The same table with further columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    names = ("key", "batch", "part", "body", "fp", "component", "size", "row", "hash", "owner", "_key", "_k", "_text_key", "shard", "kept", "n", "perplexity", "repeats", "_repeats", "_live", "component_id")
    return docs.select("*", *[F.lit(f"{n}!").alias(n) for n in names])


def table(spark, rows: list[tuple], folder, schema: str = SCHEMA, name: str = "documents", parts: int = 3) -> str:
    """rows as a Parquet table in folder."""
    spark.createDataFrame(rows, schema).repartition(parts).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)

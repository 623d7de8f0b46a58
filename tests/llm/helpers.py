"""Documents with the cases that every operator must bear."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
CLASHING = ["row_", "size", "rank", "base", "spans", "share", "bucket", "text_", "sub", "n", "u", "v", "node", "score", "hash"]


def edge_rows() -> list[tuple]:
    long_text = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
    lines = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 5
    texts = [None, "", "   \t\n", "one", "one two three four", lines, lines, lines + "tail", long_text, "Ünï cödé   w x \x1c y", "x" * 70_000, 'password = "hunter2hunter2"', "<|endoftext|> a"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, "no id here at all", None, None, None), (None, None, None, None, None)]


def edge_docs(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    return docs.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

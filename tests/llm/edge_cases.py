"""Documents that every operator must take: nulls, empty and very long texts, ties, repeats, clashing extra columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, blob string, rank int, score double, piece int, component_id long"


def documents(spark):
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again today"), (2, None), (3, ""), (4, "   \n\t "), (5, long), (6, long), (7, "The quick brown fox jumps over the lazy dog again and again today"),
        (7, "The quick brown fox jumps over the lazy dog again and again today"), (None, "orphan text without an id"), (8, "x"), (9, "é\U0001F600 ünï 世界 " * 30), (10, "a" * 5000),
    ]
    full = [(i, t, None if i == 3 else "en", None, None, "s", "b", 1, 0.5, 2, 3) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def nothing(spark):
    return documents(spark).limit(0)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, None), (8, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


def words(seed, n):
    import random

    g = random.Random(seed)
    return [g.choice("abcdefghij") + g.choice("klmnop") * g.randint(1, 3) + str(g.randint(0, 40)) for _ in range(n)]


__all__ = ["F", "documents", "labels", "nothing", "words"]

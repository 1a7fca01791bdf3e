import hashlib
import math
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import edge_cases  # noqa: E402

from placeloom.llm import importance  # noqa: E402


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features_of(text):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plainly(docs, target, percent=5, least=20):
    """Rows by the definition: (doc_id, n_features, weight, score, rank)."""
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            np.add.at(counts, features_of(x), 1)
    all_s, all_t = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((int(b) + 1) * (all_s + 10000) / ((int(a) + 1) * (all_t + 10000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, x in docs:
        f = features_of(x)
        weight, score = sum(gain[b] for b in f), None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, None, len(words_of(x))])
    entrants = sorted((r for r in rows if r[3] is not None and r[5] >= least), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(entrants[: percent * len(entrants) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(frame):
    return sorted(map(tuple, frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("size", [0, 1, 5, 255, 256, 300, 70_000])
def test_shifted_sums(size):
    a, b = b"some words", bytes(i % 251 for i in range(size))
    shifted = importance.Shift()(np.array([zlib.crc32(a)], dtype=np.uint32), np.array([size]))
    assert int(shifted[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_buckets_equal_the_definition():
    texts = ["Ab cD é9 世界 x-y", None, "", "one", "A" * 700 + " b " + "c" * 66_000 + " d", "@[`{ZzAa0/9:"]
    buckets, owner, many = importance.feature_buckets(texts)
    assert many.tolist() == [len(words_of(t)) for t in texts]
    for i, t in enumerate(texts):
        assert sorted(buckets[owner == i].tolist()) == sorted(features_of(t))


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_draw_equals_the_definition(spark, percent):
    g = random.Random(percent)
    common = "the same words stand in all of these texts again and again so that their weights are equal in every one of them"
    docs = [(i, " ".join(edge_cases.words(i, g.randint(1, 60)))) for i in range(300)] + [(i, common) for i in range(300, 700)]
    target = [" ".join(edge_cases.words(i, 30)) for i in range(40)]
    frame = importance.importance_resample(spark, table(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"), percent)
    assert got(frame) == plainly(docs, target, percent)


def test_scores_far_apart(spark):
    """Histogram cells wider than one score."""
    docs = [(i, " ".join(edge_cases.words(i % 7, 30 + 150 * (i % 50)))) for i in range(150)]
    target = [" ".join(edge_cases.words(1, 4000))]
    scored = plainly(docs, target, 50)
    assert max(r[3] for r in scored) - min(r[3] for r in scored) > importance.CELLS
    frame = importance.importance_resample(spark, table(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"), 50)
    assert got(frame) == scored


def test_ties_and_repeats(spark):
    """Repeated rows have consecutive ranks; the cutoff may fall between them."""
    text = " ".join(edge_cases.words(3, 25))
    docs = [(1, text)] * 30 + [(2, text)] * 3 + [(3, text + " more")] * 7
    frame = importance.importance_resample(spark, table(spark, docs), spark.createDataFrame([(text,)], "text string"), 50)
    rows = frame.collect()
    assert len(rows) == 40 and sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 21))
    best = max(rows, key=lambda r: (r["score"], -r["doc_id"]))["doc_id"]
    assert all(r["doc_id"] == best for r in rows if r["rank"] == 1)
    for a, b in zip(*[iter(sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"]))] * 2, strict=False):
        assert (-a["score"], a["doc_id"]) <= (-b["score"], b["doc_id"])


def test_edges(spark):
    docs, none = edge_cases.documents(spark), edge_cases.nothing(spark)
    target = spark.createDataFrame([("the quick brown fox",), (None,), ("",)], "text string")
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(importance.importance_resample(spark, docs, target, 60)) == plainly(plain, ["the quick brown fox", None, ""], 60)
    assert got(importance.importance_resample(spark, docs, target.limit(0), 60)) == plainly(plain, [], 60)
    assert importance.importance_resample(spark, none, target).columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert importance.importance_resample(spark, none, target).count() == 0
    kept = importance.importance_resample(spark, docs, target, 60, carry=["text", "rank", "score"]).where("rank = 1").first()
    assert kept["document"]["text"] and kept["document"]["rank"] == 1 and kept["document"]["score"] == 0.5

import numpy as np
import pytest

from placeloom.llm import neighbours, queries

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, part int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, 9, 3) for i, v in rows], SCHEMA)


def plainly(rows, every=20, k=20):
    """(query_id, rank, vec_id, score) by comparing all with all."""
    rows = list({(i, tuple(v)) for i, v in rows})
    out = set()
    for q, v in rows:
        if q % every == 0:
            near = sorted((-float(np.cumsum(np.float64(np.float32(v)) * np.float64(np.float32(w)))[-1]), i) for i, w in rows if i != q)[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(near, 1)}
    return out


def got(frame):
    return {tuple(r) for r in frame.collect()}


def test_few_vectors_are_all_compared(spark):
    g = np.random.default_rng(1)
    rows = [(i, g.standard_normal(5).astype(np.float32).tolist()) for i in range(60)]
    assert got(neighbours.nearest_neighbours(spark, table(spark, rows))) == plainly(rows)
    assert got(neighbours.nearest_neighbours(spark, table(spark, rows[:7]))) == plainly(rows[:7])


def test_ties_go_to_the_smaller_id(spark):
    """Unit vectors and their sums: many different vectors share a product; copies share one as well."""
    rows = [(i, [float((i >> b) & 1) or -1.0 for b in range(6)]) for i in range(64)] + [(100 + i, [1.0] * 6) for i in range(80)]
    assert got(neighbours.nearest_neighbours(spark, table(spark, rows))) == plainly(rows)


@pytest.mark.parametrize("block", [50, 16384])
def test_partitions_reach_the_recall(spark, block):
    """Clusters, one large group of copies and lone vectors, of different lengths; small blocks split parts and queries over tasks."""
    g = np.random.default_rng(2)
    centres = g.standard_normal((40, 16)) * g.uniform(0.5, 2, (40, 1))
    v = np.vstack([centres[g.integers(0, 40, 1500)] + 0.2 * g.standard_normal((1500, 16)), np.tile(centres[:1], (700, 1)), g.standard_normal((300, 16))]).astype(np.float32)
    rows = list(enumerate(v.tolist()))
    frame = neighbours.nearest_neighbours(spark, table(spark, rows), params=neighbours.Params(per_part=32, block=block))
    assert len(frame.router.b2) > 8 and frame.router.probes < len(frame.router.b2)
    want, have = plainly(rows), got(frame)
    assert len(have) == len(want) == len({(q, r) for q, r, _, _ in have})
    pair = {(q, i): s for q, _, i, s in have}
    assert len({(q, i) for q, _, i, _ in want} & set(pair)) >= 0.9 * len(want)
    x = v.astype(np.float64)
    assert all(s == float(np.cumsum(x[q] * x[i])[-1]) for (q, i), s in pair.items())


def test_recall_on_the_table(spark):
    folder = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    x, ids = np.array(e["embedding"].tolist(), dtype=np.float64), e["vec_id"].to_numpy()
    found = queries.queries()["op12_neighbours"](spark, folder).toPandas().groupby("query_id")["vec_id"].apply(set)
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        near = set(ids[np.lexsort((ids, -s))[:20]])
        hit, total = hit + len(near & found[ids[q]]), total + 20
    assert hit >= 0.93 * total


def test_parts_are_balanced_and_follow_the_graph():
    g = np.random.default_rng(3)
    x = np.repeat(g.standard_normal((8, 12)) * 3, 64, axis=0) + 0.1 * g.standard_normal((512, 12))
    ends = neighbours.nearest_in(x, x, 10, np.arange(512))
    part = neighbours.balanced_parts(ends, 8, 1)
    assert np.bincount(part).tolist() == [64] * 8
    assert (part[ends] == part[:, None]).mean() > 0.6  # 0.125 by chance
    uneven = np.bincount(neighbours.balanced_parts(ends, 6, 1), minlength=6)
    assert uneven.min() >= 84 and uneven.max() <= 86


def test_edges(spark):
    bad = [(0, None), (20, []), (40, [0.0, 0.0]), (60, [None, 1.0]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (None, [1.0, 1.0]), (120, [1.0, 2.0, 3.0])]
    good = [(140, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0]), (140, [1.0, 0.0]), (160, [2.0, 0.0])]
    assert got(neighbours.nearest_neighbours(spark, table(spark, bad + good))) == plainly(good)
    assert neighbours.nearest_neighbours(spark, table(spark, bad[:6])).count() == 0
    empty = neighbours.nearest_neighbours(spark, table(spark, [(0, [1.0])]).limit(0))
    assert empty.columns == ["query_id", "rank", "vec_id", "score"] and empty.count() == 0
    assert neighbours.nearest_neighbours(spark, table(spark, [(20, [1.0, 1.0])])).count() == 0
    assert neighbours.nearest_neighbours(spark, table(spark, [(1, [1.0, 1.0]), (2, [1.0, 1.0])])).count() == 0

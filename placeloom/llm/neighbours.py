"""Approximate nearest neighbours by learned partitions.

A bounded sample gives an exact neighbour graph, which is cut into equal parts with few cut edges. A small classifier learns which
parts a vector's neighbours lie in. It places every vector in its most probable part, and routes each query to its
most probable parts, whose vectors are compared exactly. How many parts are needed is measured on held-out sample vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeloom.llm.common import Scratch
from placeloom.llm.whitening import finite, matrix


@dataclass
class Params:
    """``sample`` bounds the vectors that the fit sees (about so many different ones, chosen by hash); one part for every ``per_part`` of
    them, ``parts`` at most. ``recall`` is what the probed parts must hold of the true neighbours of held-out sample
    vectors. ``block`` bounds the candidates, and the queries, that meet in one task at a time."""

    sample: int = 8192
    parts: int = 128
    per_part: int = 64
    graph: int = 20
    hidden: int = 64
    epochs: int = 30
    recall: float = 0.97
    block: int = 16384
    seed: int = 3


def nearest_in(queries: np.ndarray, points: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Rows of the k points of largest inner product with each query, without its own."""
    out = np.empty((len(queries), k), dtype=np.int64)
    for a in range(0, len(queries), 512):
        s = queries[a : a + 512] @ points.T
        if own is not None:
            s[np.arange(len(s)), own[a : a + 512]] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _links(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both directions of every neighbour relation."""
    n, k = ends.shape
    a, b = np.repeat(np.arange(n), k), ends.ravel()
    return np.concatenate([a, b]), np.concatenate([b, a])


def balanced_parts(ends: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """Part of each node of the graph of neighbour lists: sets are halved again and again, each time along the slowest mode of a random
    walk inside the set, then improved by exchanging nodes in pairs. Part sizes differ by one for a power of two, else in proportion."""
    n = len(ends)
    a, b = _links(ends)
    rng = np.random.default_rng(seed)
    part = np.zeros(n, dtype=np.int64)
    pending = [(np.arange(n), parts, 0)]
    while pending:
        nodes, want, first = pending.pop()
        if want < 2 or len(nodes) < 2:
            part[nodes] = first
            continue
        at = np.full(n, -1)
        at[nodes] = np.arange(len(nodes))
        inside = (at[a] >= 0) & (at[b] >= 0)
        u, v, size = at[a[inside]], at[b[inside]], len(nodes)
        degree = np.maximum(np.bincount(u, minlength=size), 1)
        x = rng.standard_normal(size)
        for _ in range(40):
            x = x - (x * degree).sum() / degree.sum()
            x = 0.5 * x + 0.5 * np.bincount(u, weights=x[v], minlength=size) / degree
            x /= np.abs(x).max() or 1.0
        cut = size * (want // 2) // want
        low = np.zeros(size, dtype=bool)
        low[np.argsort(x, kind="stable")[:cut]] = True
        for _ in range(12):
            same = low[u] == low[v]
            gain = np.bincount(u, weights=np.where(same, -1.0, 1.0), minlength=size)
            i, j = np.flatnonzero(low), np.flatnonzero(~low)
            i, j = i[np.argsort(-gain[i], kind="stable")], j[np.argsort(-gain[j], kind="stable")]
            m = min(len(i), len(j))
            good = int((gain[i[:m]] + gain[j[:m]] > 2).sum())
            swap = rng.random(good) < 0.5  # neighbours that all change sides at once would gain nothing
            if not swap.any():
                break
            low[i[:good][swap]], low[j[:good][swap]] = False, True
        pending += [(nodes[low], want // 2, first), (nodes[~low], want - want // 2, first + want // 2)]
    return part


@dataclass
class Router:
    """One hidden layer; gives the log odds of each part."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1
    measured: float = 1.0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) * self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def part(self, x: np.ndarray) -> np.ndarray:
        return self.logits(x).argmax(axis=1)

    def routes(self, x: np.ndarray, least: int) -> list[np.ndarray]:
        """The most probable parts, ``probes`` of them and more until they hold ``least`` vectors."""
        order = np.argsort(-self.logits(x), axis=1, kind="stable")
        enough = (np.cumsum(self.sizes[order], axis=1) < least).sum(axis=1) + 1
        return [o[: max(self.probes, m)] for o, m in zip(order, enough, strict=True)]


def learn_router(x: np.ndarray, target: np.ndarray, p: Params) -> Router:
    """Cross entropy against the share of each part among a vector's neighbours, by Adam."""
    g = np.random.default_rng(p.seed)
    dim, parts = x.shape[1], target.shape[1]
    mean = x.mean(axis=0)
    scale = 1.0 / max(float((x - mean).std()), 1e-300)
    net = {"w1": g.standard_normal((dim, p.hidden)) / np.sqrt(dim), "b1": np.zeros(p.hidden), "w2": g.standard_normal((p.hidden, parts)) / np.sqrt(p.hidden), "b2": np.zeros(parts)}
    m, v, step = {k: np.zeros_like(w) for k, w in net.items()}, {k: np.zeros_like(w) for k, w in net.items()}, 0
    z = (x - mean) * scale
    for epoch in range(p.epochs):
        order = g.permutation(len(x))
        for at in range(0, len(x), 128):
            rows = order[at : at + 128]
            pre = z[rows] @ net["w1"] + net["b1"]
            h = np.maximum(pre, 0)
            o = h @ net["w2"] + net["b2"]
            o = np.exp(o - o.max(axis=1, keepdims=True))
            d = (o / o.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            back = d @ net["w2"].T * (pre > 0)
            grad = {"w1": z[rows].T @ back, "b1": back.sum(axis=0), "w2": h.T @ d, "b2": d.sum(axis=0)}
            step += 1
            rate = 3e-3 * 0.5 ** (3 * epoch / p.epochs)
            for k in net:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                net[k] -= rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Router(mean, scale, **net)


def fit_router(x: np.ndarray, p: Params, k: int) -> Router:
    """Graph, parts and classifier from seven eighths of the sample; the last eighth, as queries, tells how many parts to probe."""
    g = np.random.default_rng(p.seed)
    g.shuffle(x)
    held = len(x) // 8
    test, train = x[:held], x[held:]
    parts = min(p.parts, len(train) // p.per_part)
    if parts < 2:
        return Router(np.zeros(x.shape[1]), 1.0, np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    ends = nearest_in(train, train, min(p.graph, len(train) - 1), np.arange(len(train)))
    part = balanced_parts(ends, parts, p.seed)
    target = np.zeros((len(train), parts))
    np.add.at(target, (np.repeat(np.arange(len(train)), ends.shape[1] + 1), np.hstack([part[ends], part[:, None]]).ravel()), 1.0 / (ends.shape[1] + 1))
    router = learn_router(train, target, p)
    placed = router.part(train)
    order = np.argsort(-router.logits(test), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    near = nearest_in(test, train, min(k, len(train)))
    needed = np.take_along_axis(rank, placed[near], axis=1)
    held_by = np.cumsum(np.bincount(needed.ravel(), minlength=parts)) / needed.size
    router.probes = int((held_by < p.recall).sum()) + 1
    router.measured = float(held_by[router.probes - 1])
    return router


def in_turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first entry to the last, so that a pair has one score wherever it is computed."""
    return np.cumsum(a * b, axis=1)[:, -1]


def _best(query: np.ndarray, own: int, points: np.ndarray, rough: np.ndarray, members: list[np.ndarray], k: int) -> tuple[list[int], list[float]]:
    m = min(k + 1, len(rough))
    kth = np.partition(rough, len(rough) - m)[len(rough) - m]
    near = np.flatnonzero(rough >= kth - 1e-9 * max(1.0, abs(kth)))  # ties at the end are told apart by exact scores and ids
    exact = in_turn(points[near], query[None, :])
    first = np.fromiter((members[i][0] for i in near), np.int64, len(near))
    order = np.lexsort((first, -exact))
    ids, scores = [], []
    for o in order[: k + 1]:
        mine = members[near[o]]
        ids.append(mine)
        scores.append(np.full(len(mine), exact[o]))
    ids, scores = np.concatenate(ids), np.concatenate(scores)
    keep = ids != own
    ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order].tolist(), scores[order].tolist()


def _search(dim: int, k: int):
    """Candidates of a key come before its queries (side 0, then 1); they are held, the queries stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, points, members = None, [], []
        ready = None
        for batch in batches:
            keys, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids, lists = batch.column(2), batch.column(3)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (sides[1:] != sides[:-1])) + 1), len(keys)]
            out: dict[str, list] = {"qid": [], "ids": [], "scores": []}
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if keys[a] != key:
                    key, points, members, ready = keys[a], [], [], None
                x = matrix(batch.column(4).slice(a, b - a), dim).astype(np.float64)
                if sides[a] == 0:
                    points.append(x)
                    members += [np.asarray(m, dtype=np.int64) for m in lists.slice(a, b - a).to_pylist()]
                    ready = None
                    continue
                if not points:
                    continue
                if ready is None:
                    ready = np.vstack(points)
                    points = [ready]
                own = [m[0] for m in lists.slice(a, b - a).to_pylist()]
                for c in range(0, len(x), 128):
                    rough = x[c : c + 128] @ ready.T
                    for i in range(len(rough)):
                        got, scores = _best(x[c + i], own[c + i], ready, rough[i], members, k)
                        out["qid"].append(ids[a + c + i].as_py())
                        out["ids"].append(got)
                        out["scores"].append(scores)
            if out["qid"]:
                yield pa.RecordBatch.from_arrays([pa.array(out["qid"], pa.int64()), pa.array(out["ids"], pa.list_(pa.int64())), pa.array(out["scores"], pa.list_(pa.float64()))], ["qid", "ids", "scores"])

    return run


def nearest_neighbours(spark: SparkSession, vectors: DataFrame, every: int = 20, k: int = 20, params: Params | None = None) -> DataFrame:
    """``vectors(vec_id, embedding, ...)`` -> ``(query_id, rank, vec_id, score)``: the ``k`` vectors of largest inner product found for each
    row whose vec_id is divisible by ``every``, nearest first, ties to the smaller vec_id.

    All rows are candidates but those under the query's own vec_id; with fewer than ``k`` of them all come back. Vectors that are null, empty,
    zero or hold null or non-finite components take no part, nor do rows with a null id or of another length than the
    most common (at a tie the longer). Rows equal in id and vector count once; different vectors under one id are candidates, and queries, of
    their own. Equal vectors are compared once, under their ``k`` + 1 smallest ids, of which no more can be among the
    nearest. Scores are sums over the original components in doubles, from first to last. Other columns are ignored; an empty table gives no rows.
    """
    p = params or Params()
    scratch = Scratch(spark, "neighbours")
    out = "query_id long, rank int, vec_id long, score double"
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(finite("embedding") & F.expr("vec_id IS NOT NULL AND exists(embedding, c -> c <> 0)"))
    lengths = valid.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).head(1)
    if not lengths:
        return spark.createDataFrame([], out)
    dim = lengths[0]["dim"]
    rows = valid.where(F.size("embedding") == dim).groupBy("vec_id", "embedding").agg(F.lit(1).alias("one")).drop("one")
    least = rows.withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    classes = scratch.write(least.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("members")), "classes")
    n = classes.count()
    share = min(1.0, p.sample / max(n, 1))
    picked = classes.where(F.pmod(F.xxhash64(F.element_at("members", 1), F.lit(p.seed)), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else classes
    sample = np.array([r["embedding"] for r in picked.select("embedding").orderBy(F.element_at("members", 1)).collect()], dtype=np.float64).reshape(-1, dim)
    router = fit_router(sample, p, k)
    parts = len(router.b2)
    element = classes.schema["embedding"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = router.part(matrix(b.column(1), dim).astype(np.float64)).astype(np.int32) if b.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part)], ["members", "embedding", "part"])

    indexed = scratch.write(classes.select("members", "embedding").mapInArrow(place, f"members array<long>, embedding {element}, part int"), "indexed")
    size = dict.fromkeys(range(parts), 0) | {r["part"]: r["count"] for r in indexed.groupBy("part").count().collect()}
    router.sizes = np.array([size[i] for i in range(parts)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = router.routes(matrix(b.column(1), dim).astype(np.float64), k + 1) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.astype(np.int32) for r in to], pa.list_(pa.int32()))], ["vec_id", "embedding", "probes"])

    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(route, f"vec_id long, embedding {element}, probes array<int>")
    asked = scratch.write(asked.withColumn("qid", F.monotonically_increasing_id()), "asked")
    load = dict.fromkeys(range(parts), 0) | {r["part"]: r["count"] for r in asked.select(F.explode("probes").alias("part")).groupBy("part").count().collect()}
    blocks = [max(1, -(-size[i] // p.block)) for i in range(parts)]
    shares = [max(1, -(-load[i] // p.block)) for i in range(parts)]
    n_of = lambda counts: F.element_at(F.array(*[F.lit(c) for c in counts]), F.col("part") + 1)  # noqa: E731  one entry a part
    key = (F.col("part").cast("long") * (1 << 40) + F.col("block").cast("long") * (1 << 20) + F.col("share").cast("long")).alias("key")
    spread = lambda of, many, seed: F.pmod(F.xxhash64(of, F.lit(seed)), many.cast("long"))
    upto = lambda many: F.explode(F.sequence(F.lit(0), many - 1))
    candidates = indexed.withColumn("block", spread(F.element_at("members", 1), n_of(blocks), 1)).withColumn("share", upto(n_of(shares))).select(key, F.lit(0).alias("side"), F.lit(0).cast("long").alias("qid"), "members", "embedding")
    queries = asked.withColumn("part", F.explode("probes")).withColumn("share", spread(F.col("qid"), n_of(shares), 2)).withColumn("block", upto(n_of(blocks))).select(key, F.lit(1).alias("side"), "qid", F.array("vec_id").alias("members"), "embedding")
    tasks = min(sum(b * s for b, s in zip(blocks, shares, strict=True)), 20000)
    dealt = candidates.unionByName(queries).repartition(tasks, "key").sortWithinPartitions("key", "side")
    found = dealt.mapInArrow(_search(dim, k), "qid long, ids array<long>, scores array<double>")
    each = found.select("qid", F.explode(F.arrays_zip("ids", "scores")).alias("one")).select("qid", F.col("one.ids").alias("vec_id"), F.col("one.scores").alias("score"))
    best = each.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    result = scratch.write(best.join(asked.select("qid", F.col("vec_id").alias("query_id")), "qid").select("query_id", "rank", "vec_id", "score"), "found")
    scratch.keep(result)
    result.router = router
    return result

"""SimHash near-duplicates with bit-sliced Hamming comparison.

Fingerprints are 64-bit SimHashes of word shingles. Equal fingerprints collapse to one representative.
Candidates are blocked exactly: the 64 bits are cut into ``radius + 2`` parts, two fingerprints within the
radius agree on at least two parts, so every pair of parts is one blocking key and no link can be lost.
Keys that hold more rows than one tile are split into row blocks and compared block against block.
Inside a tile the fingerprints are stored as vertical bit planes; each query adds the XOR of one plane after
another into carry-save bitwise counters for 64 lanes at a time and is abandoned once all its lanes are over
the radius.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.llm.common import Scratch
from placeloom.llm.components import connected_components

SEED = 42
TILE = 1024
ROW_BYTES = 32_768  # shingle sets above this mean size fill a tile by their bytes


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every word shingle of one whole text, repeats included; fewer words make one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(g, SEED) for g in grams], dtype="<u8")


def majority(h: np.ndarray) -> np.uint64:
    """The 64 bits that are set in over half of the hashes."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits((2 * total > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of one whole text; no words give 0."""
    return int(majority(shingle_hashes(text, shingle)))


def sketch(text: str | None, shingle: int, words: int) -> np.ndarray:
    """SimHash of 64 * words bits over the distinct shingles of a text."""
    return sketch_of(np.unique(shingle_hashes(text, shingle)), words)


def sketch_of(h: np.ndarray, words: int) -> np.ndarray:
    """SimHash of 64 * words bits: word 0 from the shingle hashes, the others from fixed remixes of them."""
    out = np.zeros(words, dtype="<u8")
    for w in range(words):
        out[w] = majority(h)
        h = h ^ (h >> np.uint64(29))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return out


def fingerprint_udf(shingle: int):
    @F.pandas_udf(T.LongType())
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return udf


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Vertical bit planes of (n, words) fingerprints: row b holds bit b of all, 64 lanes to a machine word."""
    n, words = fps.shape
    bits = np.unpackbits(np.ascontiguousarray(fps, dtype="<u8").view(np.uint8), axis=1, bitorder="little")
    lanes = np.zeros((64 * words, -(-n // 64) * 64), dtype=np.uint8)
    lanes[:, :n] = bits.T
    return np.packbits(lanes, axis=1, bitorder="little").view("<u8")


def _add(counters: list[np.ndarray], carry: np.ndarray) -> np.ndarray:
    """Carry-save step: add one bit to every lane's count; returns what overflows."""
    for k in range(len(counters)):
        total = counters[k] ^ carry
        carry = counters[k] & carry
        counters[k] = total
    return carry


def _over(counters: list[np.ndarray], sticky: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is above the radius, by a bitwise comparison from the highest counter plane."""
    above, equal = sticky.copy(), ~sticky
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def lanes_within(differences: np.ndarray, radius: int, step: int = 16) -> np.ndarray:
    """Which of (m, words) XORs have at most ``radius`` bits; machine words whose lanes are all over are abandoned."""
    m = len(differences)
    planes = planes_of(differences)
    alive = np.arange(planes.shape[1])
    counters = [np.zeros(len(alive), dtype=np.uint64) for _ in range(max(1, radius.bit_length()))]
    sticky = np.zeros(len(alive), dtype=np.uint64)
    out = np.zeros(planes.shape[1], dtype=np.uint64)
    for b0 in range(0, len(planes), step):
        for b in range(b0, b0 + step):
            sticky = sticky | _add(counters, planes[b, alive])
        open_words = _over(counters, sticky, radius) != FULL
        if not open_words.all():
            alive, sticky, counters = alive[open_words], sticky[open_words], [c[open_words] for c in counters]
        if not len(alive):
            break
    out[alive] = ~_over(counters, sticky, radius)
    return np.unpackbits(out.view(np.uint8), bitorder="little")[:m].astype(bool)


def pairs_within(fps: np.ndarray, radius: int, step: int = 16, queries: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j), i < j, of one block of (n, words) fingerprints at Hamming distance <= radius: each query against all lanes."""
    n = len(fps)
    planes = planes_of(fps)
    words = planes.shape[1]
    left, right = [], []
    lane = np.arange(words * 64)
    for at in range(0, n, queries):
        alive = np.arange(at, min(n, at + queries))
        # lanes at or before the query never count, nor do padding lanes
        sticky = np.packbits((lane[None, :] <= alive[:, None]) | (lane[None, :] >= n), axis=1, bitorder="little").view("<u8")
        counters = [np.zeros((len(alive), words), dtype=np.uint64) for _ in range(max(1, radius.bit_length()))]
        for b0 in range(0, len(planes), step):
            for b in range(b0, b0 + step):
                mine = (fps[alive, b // 64] >> np.uint64(b % 64)) & np.uint64(1)
                sticky = sticky | _add(counters, planes[b][None, :] ^ (mine * FULL)[:, None])
            open_rows = (_over(counters, sticky, radius) != FULL).any(axis=1)
            if not open_rows.all():
                alive, sticky, counters = alive[open_rows], sticky[open_rows], [c[open_rows] for c in counters]
            if not len(alive):
                break
        if len(alive):
            hit = np.unpackbits((~_over(counters, sticky, radius)).view(np.uint8), axis=1, bitorder="little")
            q, lanes = np.nonzero(hit)
            left.append(alive[q])
            right.append(lanes)
    if not left:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(left), np.concatenate(right)


def links_by_key(key: np.ndarray, fps: np.ndarray, radius: int, small: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows with equal keys; keys are sorted. Large keys go block-wise, small ones as pairs at a distance."""
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(begins, len(key)))
    left, right = [], []
    for b, n in zip(begins[size > small], size[size > small], strict=True):
        i, j = pairs_within(fps[b : b + n], radius)
        left.append(i + b)
        right.append(j + b)
    end = np.repeat(np.where(size > small, 0, begins + size), size)
    for d in range(1, int(size[size <= small].max(initial=1))):
        i = np.flatnonzero(np.arange(len(key)) + d < end)
        if not len(i):
            break
        i = i[lanes_within(fps[i] ^ fps[i + d], radius)]
        left.append(i)
        right.append(i + d)
    if not left:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(left), np.concatenate(right)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n local nodes."""
    low = np.arange(n)
    while len(i):
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def _tiles(frames: Iterator[pd.DataFrame], tile: int) -> Iterator[pd.DataFrame]:
    """Cut key-sorted batches into tiles that never divide a key."""
    held: pd.DataFrame | None = None
    for frame in frames:
        if held is not None and len(held):
            frame = pd.concat([held, frame], ignore_index=True)
        key = frame["tile_key"].to_numpy()
        ends = np.flatnonzero(np.append(key[1:] != key[:-1], False)) + 1  # ends of complete keys
        start = 0
        while len(ends) and ends[-1] - start >= tile:
            cut = int(ends[np.searchsorted(ends, start + tile)])
            yield frame.iloc[start:cut]
            start = cut
        held = frame.iloc[start:]
    if held is not None and len(held):
        yield held


def jaccard_reached(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Is the Jaccard similarity of two sorted sets at least ``similarity``? Empty sets are like empty sets only."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return not len(b)
    if len(a) < similarity * len(b) - 1e-9:
        return False
    both = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def verified(i: np.ndarray, j: np.ndarray, sets: list[np.ndarray], similarity: float, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs whose sets reach the similarity, less pairs that others already connect."""
    low = np.arange(len(sets))
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    while len(i):
        good = np.array([jaccard_reached(sets[a], sets[b], similarity) for a, b in zip(i[:step], j[:step], strict=True)], dtype=bool)
        left.append(i[:step][good])
        right.append(j[:step][good])
        i, j = i[step:], j[step:]
        if good.any():
            low = forest(len(sets), np.concatenate(left), np.concatenate(right))
        apart = low[i] != low[j]
        i, j = i[apart], j[apart]
    return np.concatenate(left), np.concatenate(right)


def _link(radius: int, tile: int, similarity: float | None = None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _tiles(frames, 16 * tile if similarity is None else tile):
            key, rep = part["tile_key"].to_numpy(), part["rep"].to_numpy()
            if part["fp"].dtype == object:
                fps = np.frombuffer(b"".join(part["fp"]), dtype="<u8").reshape(len(rep), -1)
            else:
                fps = part["fp"].to_numpy().view(np.uint64)[:, None]
            i, j = links_by_key(key, fps, radius)
            if similarity is not None:
                i, j = verified(i, j, [np.frombuffer(g, dtype="<u8") for g in part["grams"]], similarity)
            if not len(i):
                continue
            nodes, index = np.unique(np.concatenate([rep[i], rep[j]]), return_inverse=True)
            low = forest(len(nodes), index[: len(i)], index[len(i) :])
            moved = np.flatnonzero(low != np.arange(len(nodes)))
            if len(moved):
                yield pd.DataFrame({"src": nodes[moved], "dst": nodes[low[moved]]})

    return run


def _linked(spark: SparkSession, keyed: DataFrame, scratch: Scratch, radius: int, tile: int, similarity: float | None = None) -> DataFrame:
    """``keyed(key, rep, fp)`` -> ``(node, component)`` over links among rows with equal keys. With a similarity,
    ``keyed`` also has ``grams`` (sorted shingle hashes) and only pairs of that Jaccard similarity link.

    A key above ``tile`` rows is split into row blocks, and block pairs are dealt out as keys of their own."""
    load, payload = F.count("*"), ["fp", "rep"]
    if similarity is not None:
        load = F.greatest(load, F.least(load * tile, F.ceil(F.sum(F.octet_length("grams").cast("long")) / ROW_BYTES)))
        payload.append("grams")
    hot = scratch.write(
        keyed.groupBy("key").agg(load.alias("load")).where(F.col("load") > tile).select("key", F.ceil(F.col("load") / tile).alias("nb")), "hot"
    )
    zero = F.lit(0).cast("long")
    cold = F.col("nb").isNull()
    dealt = (
        keyed.join(hot, "key", "left")
        .withColumn("mine", F.when(cold, zero).otherwise(F.pmod(F.xxhash64("rep", F.lit("block")), F.col("nb"))))
        .withColumn("other", F.explode(F.when(cold, F.array(zero)).otherwise(F.sequence(zero, F.col("nb") - 1))))
        .select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile_key"), *payload)
    )
    tiles = dealt.repartition("tile_key").sortWithinPartitions("tile_key")
    return connected_components(spark, tiles.mapInPandas(_link(radius, tile, similarity), "src long, dst long"), scratch)


def _part_keys(radius: int):
    """One key for each pair of the radius + 2 bit parts."""
    parts = radius + 2
    edges = [round(64 * k / parts) for k in range(parts + 1)]
    masks = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(parts)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [
        F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(masks[a] | masks[b]))))
        for k, (a, b) in enumerate(combinations(range(parts), 2))
    ]


def near_duplicates(
    spark: SparkSession, fps: DataFrame, scratch: Scratch, radius: int = 2, tile: int = TILE
) -> DataFrame:
    """``fps(id long, fp long)`` -> ``(id, fp, component_id)``; links are pairs at <= radius differing bits.

    The fingerprint is what links, and the node of the graph; a component is named by the smallest id of its fingerprints. Every row
    comes back. Rows with a null id link with nothing and have a null component. Repeated rows and equal fingerprints share a
    component. One id with two fingerprints does not join them: its rows have the components of their own fingerprints. An empty table gives
    an empty result.
    """
    fps = scratch.write(fps.select("id", "fp"), "fps")
    reps = scratch.write(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("first_id")), "reps")
    keyed = reps.select("fp", F.col("fp").alias("rep"), F.explode(F.array(*_part_keys(radius))).alias("key"))
    groups = _linked(spark, keyed, scratch, radius, tile)
    placed = scratch.write(reps.join(groups, reps.fp == groups.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component")), "placed")
    first = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_fp = scratch.write(placed.join(first, "component").select("fp", "component_id"), "of_fp")
    scratch.keep(fps, of_fp)
    joined = fps.join(of_fp, "fp", "left")
    return joined.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def simhash_documents(
    spark: SparkSession, docs: DataFrame, shingle: int = 3, radius: int = 2, tile: int = TILE
) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, fingerprint, component_id)``, one row per input row.

    Null and empty texts have fingerprint zero and link like any other; very long texts are read whole. Repeated rows share a component;
    several texts under one doc_id each have that of their own fingerprint. Rows without a doc_id have a fingerprint and no component. Other columns
    are not read, so names cannot clash; an empty table gives no rows.
    """
    scratch = Scratch(spark, "simhash")
    fps = docs.select(F.col("doc_id").cast("long").alias("id"), fingerprint_udf(shingle)("text").alias("fp"))
    out = near_duplicates(spark, fps, scratch, radius, tile)
    return out.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def plan_samples(n: int, similarity: float, recall: float, size: int) -> tuple[int, int, int]:
    """(sampled bits, tables, radius) for sketches of ``size`` bits. Sampled bits grow with log2 n. The distance of a
    pair exactly at the threshold is taken as binomial; radius and tables together make it a candidate with probability
    >= ``recall``. Sets of unequal size have a larger cosine at the same Jaccard similarity, so are closer."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = max(12, math.ceil(math.log2(max(n, 2))) - 2)
    chance = [math.comb(size, d) * share**d * (1 - share) ** (size - d) for d in range(size + 1)]
    radius = next(d for d in range(size + 1) if sum(chance[d + 1 :]) <= (1 - recall) / 50)
    agree = [math.comb(size - d, bits) / math.comb(size, bits) for d in range(radius + 1)]
    tables = 1
    while sum(c * (1 - (1 - q) ** tables) for c, q in zip(chance, agree, strict=False)) < recall:
        tables += 1
    return bits, tables, radius


def _sampled(bits: int, tables: int, words: int, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.random.default_rng(seed)
        places = [g.permutation(64 * words)[:bits] for _ in range(tables)]
        weight = np.int64(1) << np.arange(bits, dtype=np.int64)
        for f in frames:
            for at in range(0, len(f), 2000):
                part = f.iloc[at : at + 2000]
                flags = np.unpackbits(np.frombuffer(b"".join(part["fp"]), dtype=np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
                keys = np.stack([flags[:, p].astype(np.int64) @ weight for p in places], axis=1)
                yield pd.DataFrame({"rep": part["rep"].to_numpy(), "fp": part["fp"].to_numpy(), "keys": list(keys)})

    return run


def similar_texts(
    spark: SparkSession, docs: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = 0.95, words: int = 4, tile: int = TILE, seed: int = 23
) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, text_hash, component)``, one row per input row; texts link when the
    Jaccard similarity of their sets of word shingles reaches ``similarity``.

    SimHash sketches of 64 * words bits over the distinct shingles only propose: candidates share the sampled bits of one
    of several tables, and a pair at the threshold is proposed with probability >= ``recall``, closer pairs more surely
    (sets of four or five shingles less so, as their sketches are coarse). Every link is then verified on the whole sets,
    within the components that the candidates form. Equal sets always link. Null ids link with nothing and have a null
    component. Exact up to 64-bit hash collisions.
    """
    scratch = Scratch(spark, "similar")
    text_hash = F.xxhash64("text").alias("text_hash")

    @F.pandas_udf("node long, fp binary")
    def sketch_udf(texts: pd.Series) -> pd.DataFrame:
        nodes, fps = [], []
        for t in texts:  # one set at a time
            h = np.unique(shingle_hashes(t, shingle))
            nodes.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
            fps.append(sketch_of(h, words).tobytes())
        return pd.DataFrame({"node": np.array(nodes, dtype=np.uint64).view(np.int64), "fp": fps})

    @F.pandas_udf(T.BinaryType())
    def grams_udf(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, shingle)).tobytes() for t in texts])

    made = docs.select(F.col("doc_id").cast("long").alias("id"), text_hash, sketch_udf("text").alias("s"))
    fps = scratch.write(made.select("id", "text_hash", "s.node", "s.fp"), "fps")
    sets = scratch.write(fps.where("id is not null").groupBy("node", "fp").agg(F.min(F.struct("id", "text_hash")).alias("pick")), "sets")
    reps = scratch.write(sets.groupBy("fp").agg(F.min("node").alias("rep"), F.count("*").alias("n")), "reps")
    bits, tables, radius = plan_samples(reps.count(), similarity, recall, 64 * words)
    keyed = reps.mapInPandas(_sampled(bits, tables, words, seed), "rep long, fp binary, keys array<long>")
    keyed = keyed.select("rep", "fp", F.posexplode("keys").alias("t", "k")).select("rep", "fp", F.xxhash64("t", "k").alias("key"))
    proposed = _linked(spark, keyed, scratch, radius, tile)
    of_fp = scratch.write(reps.join(proposed, reps.rep == proposed.node, "left").select("fp", "n", F.coalesce("component", "rep").alias("key")), "of_fp")
    shared = of_fp.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    members = sets.join(of_fp.join(shared, "key", "left_semi"), "fp").select("key", "fp", F.col("node").alias("rep"), "pick.*")
    members = scratch.write(members, "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_hash, "text")
    texts = texts.join(members, ["id", "text_hash"]).dropDuplicates(["id", "text_hash"])
    grams = scratch.write(texts.select("key", "rep", "fp", grams_udf("text").alias("grams")), "grams")
    links = scratch.write(_linked(spark, grams, scratch, radius, tile, similarity), "links")
    scratch.keep(fps, links)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", fps.node)).alias("component")
    return fps.join(links, fps.node == links.node, "left").select(F.col("id").alias("doc_id"), "text_hash", component)


def similar_documents(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, component_id)``: components of ``similar_texts`` under their smallest id."""
    texts = similar_texts(spark, docs, **how)
    first = texts.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return texts.join(first, "component", "left").select("doc_id", "component_id")

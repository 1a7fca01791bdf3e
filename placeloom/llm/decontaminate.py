"""Benchmark decontamination with CGK embeddings.

Items and texts are word sequences. An item of n words leaks into a text if some stretch of the text is within
``floor(max_edit * n)`` word edits of it. Item-sized windows of the text are embedded by the CGK random walk (copy the
current word, then advance or not by a random bit that depends on step and word), which maps edit distance to Hamming
distance; bit-sampling hashes of several walks bring a leaking window and its item together; a bit-parallel exact edit distance confirms
every candidate, so nothing is reported in error.

Recall is planned. Walks of long items and of many edits drift apart, so fixed numbers of picks and samples would lose long items near the edit
limit. For every item length, items with generated edits at the very limit (insertions, deletions, replacements, mixed) are walked, and the
largest number of picks is taken at which the samples of all walks find ``recall`` of the worst kind. Fewer edits are found more surely.

Most windows are not worth embedding: of the d + m rarest words of an item a window within d edits must hold at least m, so only windows with so many
of some item's rarest words are embedded; that condition loses nothing. With ``exact`` every stretch that passes it is verified as well, which finds the
last leaks that hashes miss (an audit; off by default).

Items are taken in blocks of bounded size, one pass over the texts for each block; only one block is ever on the driver
or in a task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.llm.common import Scratch

ITEM_BLOCK, BLOCK_CHARS = 2_000, 4_000_000  # bounds of a block: a task holds its words, votes and tables, some 20 bytes a character
WINDOWS, CELLS = 5_000, 8_000_000  # windows, and words of their embeddings, at a time
BATCH_CHARS = 8_000_000
# words are runs of ASCII letters, digits and underscores and of bytes above ASCII
_TO_SPACE = bytes(b if b >= 128 or chr(b).isalnum() or b == 95 else 32 for b in range(256))
# fixed values: punctuation and spaces above ASCII that also part words
_BEYOND = [c.encode() for c in "\u00a0«»–—‘’“”„…¿¡"]


def words_of(text: str | None) -> list[bytes]:
    data = (text or "").lower().encode("utf-8", "surrogatepass")
    if not data.isascii():
        for c in _BEYOND:
            data = data.replace(c, b" ")
    return data.translate(_TO_SPACE).split()


def edit_within(pattern: list[int], text: list[int], limit: int) -> bool:
    """Is some stretch of text within ``limit`` edits of the whole pattern? Myers' bit vectors, one word of text a step."""
    m = len(pattern)
    if m <= limit:
        return True
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        if score <= limit:
            return True
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
    return False


GRID = [4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024]
WALKS, MOST_SAMPLES = 10, 48


def embed(symbols: Callable[[np.ndarray], np.ndarray], steps: np.ndarray, many: int, length: int) -> np.ndarray:
    """CGK strings (length, walks, many): ``symbols(at)`` gives the word under each walk of each sequence; whether it advances is the top bit of
    the product of word and step."""
    at = np.zeros((len(steps), many), dtype=np.int64)
    copied = np.empty((length, len(steps), many), dtype=np.uint32)
    for j in range(length):
        symbol = symbols(at)
        copied[j] = symbol
        at += ((symbol.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * steps[:, j, None] >> np.uint64(63)).astype(np.int64)
    return copied


def plan_hashes(recall: float = 0.995, max_edit: float = 0.2, walks: int = WALKS, most: int = MOST_SAMPLES, pairs: int = 48, seed: int = 17) -> list[tuple[int, int, int]]:
    """``(length, picks, samples)`` for lengths of ``GRID``: the most picks at which, over generated pairs at the edit limit of the worst kind of
    edit, all walks together collide in one of at most ``most`` samples each with probability ``recall``, and how many that takes. Where even one pick
    falls short, one pick and all samples. A window is also tried at its neighbours' starts, which only helps."""
    g = np.random.default_rng(seed)
    plan = []
    for n in GRID:
        d = math.floor(max_edit * n + 1e-9)
        agree = []
        for kind in ("insert", "delete", "replace", "mixed"):
            left, right = g.integers(1, 1 << 20, (pairs, n)), np.zeros((pairs, n), dtype=np.int64)
            for i in range(pairs):
                w = left[i].tolist()
                for at in sorted(g.choice(n, d, replace=False).tolist(), reverse=True):
                    how = ("insert", "delete", "replace")[int(g.integers(3))] if kind == "mixed" else kind
                    x = int(g.integers(1, 1 << 20))
                    w[at : at + 1] = {"insert": [w[at], x], "delete": [], "replace": [x]}[how]
                right[i] = (w + g.integers(1, 1 << 20, n).tolist())[:n]
            both = np.vstack([left, right])
            steps = g.integers(0, 2**63, (walks, 2 * n), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            rows = np.arange(len(both))[None, :]
            copied = embed(lambda at, both=both, rows=rows, n=n: np.where(at < n, both[rows, np.minimum(at, n - 1)], 0), steps, len(both), 2 * n)
            agree.append((copied[:, :, :pairs] == copied[:, :, pairs:]).mean(axis=0))  # (walks, pairs)
        chosen = (1, most)
        for picks in range(5, 0, -1):
            worst = lambda samples, picks=picks: min(float((1 - np.prod((1 - q**picks) ** samples, axis=0)).mean()) for q in agree)
            enough = next((k for k in range(1, most + 1) if worst(k) >= recall), None)
            if enough:
                chosen = (picks, enough)
                break
        plan.append((n, *chosen))
    return plan


class Index:
    """CGK tables over one block of items: ``walks`` embeddings, each sampled as often and at as many places as the ``plan`` has it for the item's length."""

    def __init__(self, items: list[tuple[int, str]], max_edit: float = 0.2, plan: list[tuple[int, int, int]] | None = None, exact: bool = False, walks: int = WALKS, seed: int = 3):
        self.walks, self.exact = walks, exact
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if ids:
                self.items.append((item, ids))
        self.edits = lambda n: math.floor(max_edit * n + 1e-9)
        sizes = sorted({len(ids) for _, ids in self.items})
        plan = plan or plan_hashes(max_edit=max_edit)
        g = np.random.default_rng(seed)
        # word 0 is all words outside the vocabulary; most walks have left a window of n words after 2 n steps
        self.steps = g.integers(0, 2**63, (walks, 2 * (sizes[-1] if sizes else 0)), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.tables: dict[int, list] = {}
        self.places: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sizes:
            picks, samples = next(((k, m) for size, k, m in plan if size >= n), plan[-1][1:])
            odd = g.integers(0, 2**63, (walks, samples, picks), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            self.places[n] = (np.sort(g.integers(0, 2 * n, (walks, samples, picks)), axis=2), odd)
            mine = [(item, ids) for item, ids in self.items if len(ids) == n]
            flat = np.array([ids for _, ids in mine], dtype=np.int64)
            begins = np.arange(len(mine)) * n
            keys = self.hashes(flat.ravel(), begins, begins + n, n)
            order = np.argsort(keys, axis=1, kind="stable")
            self.tables[n] = [mine, np.take_along_axis(keys, order, 1), order]
        # votes: which items count a word among their d + m rarest
        seen = Counter(w for _, ids in self.items for w in set(ids))
        voters: list[list[int]] = [[] for _ in range(len(self.vocabulary) + 2)]
        self.size = np.array([len(ids) for _, ids in self.items], dtype=np.int64)
        self.limit = np.array([self.edits(n) for n in self.size], dtype=np.int64)
        self.need = np.maximum(1, -(-self.size // 3))
        for k, (_, ids) in enumerate(self.items):
            for w in set(sorted(ids, key=lambda w: (seen[w], w))[: int(self.limit[k] + self.need[k])]):
                voters[w].append(k)
        self.vote_count = np.array([len(v) for v in voters], dtype=np.int64)
        self.vote_begin = np.cumsum(self.vote_count) - self.vote_count
        self.vote_items = np.array([k for v in voters for k in v], dtype=np.int64)

    def hashes(self, tokens: np.ndarray, starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
        """(walks * samples, windows) hashes of the windows of n tokens at starts; past ``stops``, the ends of their texts,
        windows are padded."""
        pad = len(self.vocabulary) + 1
        room = np.minimum(n, stops - starts)
        places, odd = self.places[n]
        copied = embed(lambda at: np.where(at < room, tokens[np.minimum(starts + at, len(tokens) - 1)], pad), self.steps, len(starts), int(places.max()) + 1)
        walk = np.arange(self.walks)[:, None]
        out = np.zeros((*places.shape[:2], len(starts)), dtype=np.uint64)
        for k in range(places.shape[2]):
            out += (copied[places[:, :, k], walk].astype(np.uint64) + np.uint64(0x9E3779B9)) * odd[:, :, k, None]
            out ^= out >> np.uint64(29)
        return out.reshape(-1, len(starts))

    def search(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of the items that leak into each text, ascending."""
        if not self.items:
            return [[] for _ in texts]
        get = self.vocabulary.get
        parts, lengths = [], []
        for text in texts:
            words = words_of(text)
            parts.append(np.fromiter(map(get, words, repeat(0)), dtype=np.int64, count=len(words)))
            lengths.append(len(words))
        hits: list[set[int]] = [set() for _ in texts]
        tokens = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        ends = np.cumsum(lengths)
        runs = self._runs(tokens, ends)
        for n, starts in self._worth(len(tokens), *runs):
            owners = np.searchsorted(ends, starts, side="right")
            step = max(64, min(WINDOWS, CELLS // (2 * n * self.walks)))
            for at in range(0, len(starts), step):
                self._confirm(tokens, starts[at : at + step], n, self.edits(n), owners[at : at + step], ends, hits)
        if self.exact:
            self._verify(tokens, ends, *runs, hits)
        return [sorted(h) for h in hits]

    def _runs(self, tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item, doc, low, high): starts low to high of stretches that hold enough of an item's rarest words. Rows of one
        item are in the order of the text."""
        place = np.flatnonzero(self.vote_count[tokens])
        count = self.vote_count[tokens[place]]
        if not len(place):
            return (np.zeros(0, dtype=np.int64),) * 4
        spread = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item = self.vote_items[np.repeat(self.vote_begin[tokens[place]], count) + spread]
        key = np.sort((item << 40) | np.repeat(place, count))
        item, pos = key >> 40, key & ((1 << 40) - 1)
        last = np.arange(len(key)) + self.need[item] - 1
        inside = last < len(key)
        first, last = np.flatnonzero(inside), last[inside]
        first, last = first[(item[first] == item[last])], last[(item[first] == item[last])]
        close = pos[last] - pos[first] < self.size[item[first]] + self.limit[item[first]]
        first, last = first[close], last[close]
        doc = np.searchsorted(ends, pos[first], side="right")
        own = pos[last] < ends[doc]
        first, last, doc = first[own], last[own], doc[own]
        n, d = self.size[item[first]], self.limit[item[first]]
        begin = np.where(doc > 0, ends[doc - 1], 0)
        low = np.maximum(begin, pos[last] - n - d + 1)
        high = np.minimum(pos[first], np.maximum(begin, ends[doc] - n + d))
        return item[first], doc, low, np.maximum(low, high)

    def _worth(self, length: int, item: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(n, starts) of the windows of n tokens that hold enough of some item's rarest words."""
        n = self.size[item]
        for size in np.unique(n):
            mine = n == size
            # ranges of starts as a running sum of +1 and -1
            edge = np.zeros(length + 2, dtype=np.int64)
            np.add.at(edge, low[mine], 1)
            np.add.at(edge, high[mine] + 1, -1)
            yield int(size), np.flatnonzero(np.cumsum(edge[:length]) > 0)

    def _verify(self, tokens, ends, item, doc, low, high, hits) -> None:
        """Settle every stretch of ``_runs`` whose item is not yet known to leak into its text."""
        if not len(item):
            return
        stop = np.minimum(ends[doc], high + self.size[item] + self.limit[item])
        fresh = np.append(True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (low[1:] > stop[:-1]))
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(item)) - 1
        for k, t, a, b in zip(item[first].tolist(), doc[first].tolist(), low[first].tolist(), stop[last].tolist(), strict=True):
            name, ids = self.items[k]
            d = int(self.limit[k])
            if name not in hits[t] and self._overlap(ids, tokens[a:b]) >= len(ids) - d and edit_within(ids, tokens[a:b].tolist(), d):
                hits[t].add(name)

    @staticmethod
    def _overlap(ids: list[int], window: np.ndarray) -> int:
        """Words of the item that the window holds, an upper bound of what few edits can leave in common."""
        held = set(window.tolist())
        return sum(w in held for w in ids)

    def _confirm(self, tokens, starts, n, d, owners, ends, hits) -> None:
        mine, keys, order = self.tables[n]
        stops = ends[owners]
        found = self.hashes(tokens, starts, stops, n)
        met = []
        for row in range(len(found)):
            lo = np.searchsorted(keys[row], found[row], side="left")
            many = np.searchsorted(keys[row], found[row], side="right") - lo
            w = np.flatnonzero(many)
            spread = np.arange(many[w].sum()) - np.repeat(np.cumsum(many[w]) - many[w], many[w])
            met.append(np.unique(order[row, np.repeat(lo[w], many[w]) + spread] * len(starts) + np.repeat(w, many[w])))
        met = np.unique(np.concatenate(met))
        candidates = [(k, w) for k, w in zip((met // len(starts)).tolist(), (met % len(starts)).tolist(), strict=True) if mine[k][0] not in hits[owners[w]]]
        candidates = [(k, w) for k, w in candidates if self._overlap(mine[k][1], tokens[starts[w] : min(starts[w] + n, stops[w])]) >= n - d]
        for k, w in candidates:
            item, ids = mine[k]
            doc = owners[w]
            if item in hits[doc]:
                continue
            begin = ends[doc - 1] if doc else 0
            a, b = max(begin, starts[w] - d), min(ends[doc], starts[w] + n + d)
            if edit_within(ids, tokens[a:b].tolist(), d):
                hits[doc].add(item)


def _leaks(items: Broadcast, max_edit: float, plan: list[tuple[int, int, int]], exact: bool):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(items.value, max_edit, plan, exact)
        for texts in batches:
            out: list[list[int]] = []
            held: list[str | None] = []
            size = 0
            for text in texts:
                held.append(text)
                size += len(text or "")
                if size >= BATCH_CHARS:
                    out += index.search(held)
                    held, size = [], 0
            if held:
                out += index.search(held)
            yield pd.Series(out)

    return udf


def item_blocks(benchmark: DataFrame, block: int, chars: int) -> list[DataFrame]:
    """Items with an id and a text in blocks of about ``block`` rows and ``chars`` characters, dealt by a hash of the item."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("chars")).first()
    n = max(1, math.ceil(size["n"] / block), math.ceil(size["chars"] / chars))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def with_leaks(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, name: str = "item_ids", max_edit: float = 0.2, block: int = ITEM_BLOCK, chars: int = BLOCK_CHARS,
    recall: float = 0.995, exact: bool = False,
) -> DataFrame:
    """``docs`` with one more column: the sorted ids of the items that leak into ``text``, found with probability ``recall`` at the edit limit.

    Items without an id or a word are ignored, repeated ones count once. One block needs no pass of its own. Of several
    each writes the texts it finds leaks in, by a 64-bit hash of the text, before the next is read; texts are judged by
    content, so repeated rows get the same result.
    """
    blocks, plan = item_blocks(benchmark, block, chars), plan_hashes(recall, max_edit)
    share = lambda rows: spark.sparkContext.broadcast(sorted((r[0], r[1]) for r in rows.collect()))
    if len(blocks) == 1:
        return docs.withColumn(name, _leaks(share(blocks[0]), max_edit, plan, exact)("text"))
    scratch = Scratch(spark, "leaks")
    parts = []
    for rows in blocks:
        items = share(rows)
        found = docs.select(F.xxhash64("text").alias("th"), _leaks(items, max_edit, plan, exact)("text").alias("ids")).where("size(ids) > 0")
        parts.append(scratch.write(found.select("th", F.explode("ids").alias("id")).distinct(), "found"))
        items.destroy()
    found = reduce(DataFrame.unionByName, parts).groupBy("th").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    found = scratch.write(found.select(F.col("th").alias("leak_th"), F.col("ids").alias("leak_ids")), "leaks")
    scratch.keep(found)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("th"))
    ids = F.coalesce("leak_ids", F.array().cast("array<bigint>"))
    joined = rows.join(found, F.col("th") == F.col("leak_th"), "left")
    return joined.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], ids.alias(name))


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, max_edit: float = 0.2, **how) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, contaminated, n_items, item_ids)``, one row per input row.

    Null and empty texts are clean; repeated rows are judged alike; very long texts are searched whole, in windows; other
    columns are ignored; an empty table gives no rows.
    """
    found = with_leaks(spark, docs.select("doc_id", "text"), benchmark, "item_ids", max_edit, **how)
    size = F.size("item_ids")
    return found.select("doc_id", (size > 0).alias("contaminated"), size.cast("long").alias("n_items"), "item_ids")


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, max_edit: float = 0.2) -> DataFrame:
    """The rows of ``docs`` that hold no item, columns as they are."""
    name = "leaked"
    while name in docs.columns:
        name += "_"
    return with_leaks(spark, docs, benchmark, name, max_edit).where(F.size(name) == 0).drop(name)

"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Packing needs only the histogram of piece lengths, which has at most ``capacity`` entries whatever the corpus
size, so the plan is made on the driver from that histogram and is exact for all rows. Pieces above a third of the
capacity go at most two to a sequence: the largest is matched with the largest that still fits beside it. Smaller
pieces, longest first, go where the smallest sufficient gap is left. The plan is a list of runs "pieces of this
length with these ranks go to these sequences at this offset"; ranks within a length come from salted windows. Pieces of
the full capacity, most of a large corpus, have a sequence to themselves and need no rank.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from placeloom.llm.common import Scratch
from placeloom.llm.wordpieces import byte_symbols

SPECIAL = "<|endoftext|>"
PER_SALT, LEAST_SALTS = 1_000_000, 16
FRONT = 20
LETTER, NUMBER, SPACE, OTHER = range(4)


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(len(a), n - len(a)), dtype=a.dtype)])


class PieceTokenizer:
    """Byte-level BPE through ``tokenizers``, each distinct word piece encoded once.

    Texts are cut into word pieces with numpy by the byte-level pattern (contractions; letters, numbers or other
    symbols with one leading space; white space), pieces are told apart by a 64-bit hash, and ids of a text
    are gathered from the encoded distinct pieces. Texts that hold the special token go to the tokenizer whole.
    """

    def __init__(self, spec: str, memo: int = 1_000_000, block: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.block = Tokenizer.from_str(spec), memo, block
        self.model, self.symbols = self.tokenizer.model, byte_symbols()
        every = "".join(map(chr, range(0x110000)))
        self.kind = np.full(0x110000, OTHER, dtype=np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                self.kind[m.start() : m.end()] = kind
        g = np.random.default_rng(5)
        self.code = g.integers(0, 2**64, 0x110000, dtype=np.uint64)
        base = 0x9E3779B97F4A7C15 | 1
        inverse = pow(base, -1, 2**64)
        self._power, self._inverse = self._powers(base, block), self._powers(inverse, block)
        self.base, self.inv = base, inverse
        self.clear()

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        # direct-mapped front of the dictionary: most pieces are found here without sorting
        self.front_hash = np.zeros(1 << FRONT, dtype=np.uint64)
        self.front_slot = np.full(1 << FRONT, -1, dtype=np.int64)
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.at = np.zeros(1 << 12, dtype=np.int64)

    def starts(self, cp: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Flags of code points that begin a word piece; ``first`` flags the beginnings of texts."""
        n = len(cp)
        kind = self.kind[cp]
        space = kind == SPACE
        before = np.empty(n, dtype=np.uint8)
        before[0], before[1:] = OTHER, kind[:-1]
        start = first | (kind != before)
        follows = np.zeros(n, dtype=bool)  # a later code point of the same text that is no white space
        follows[:-1] = ~first[1:] & ~space[1:]
        last = space & follows  # of a run of white space before a word
        start |= last
        joined = np.zeros(n, dtype=bool)
        joined[1:] = (last & (cp == 32))[:-1]
        start &= ~joined
        for i in np.flatnonzero(start & (cp == 39)):  # contractions
            tail = cp[i + 1 : i + 3]
            tail = tail[: np.argmax(first[i + 1 : i + 3])] if first[i + 1 : i + 3].any() else tail
            tail = "".join(map(chr, tail))
            k = 1 if tail[:1] in ("s", "t", "m", "d") and tail else 2 if tail in ("re", "ve", "ll") else 0
            if k:
                start[i + 1] = False
                if i + 1 + k < n and kind[i + 1 + k] == LETTER:
                    start[i + 1 + k] = True
        return start

    def _learn(self, pieces: list[str], hashes: list[int]) -> None:
        symbols, tokenize = self.symbols, self.model.tokenize
        ids: list[int] = []
        ends = []
        for piece in pieces:
            ids += [t.id for t in tokenize("".join([symbols[b] for b in piece.encode("utf-8", "surrogatepass")]))]
            ends.append(len(ids))
        n, k = len(self.slot), len(pieces)
        self.slot.update(zip(hashes, range(n, n + k), strict=True))
        self.flat = _grown(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.at = _grown(self.at, n + k + 1)
        self.at[n + 1 : n + k + 1] = self.used + np.array(ends, dtype=np.int64)
        self.used += len(ids)

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        whole = "".join(texts)
        if not whole:
            return [np.zeros(0, dtype=np.uint32) for _ in texts]
        if len(self.slot) > self.memo:
            self.clear()
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        edges = np.cumsum([0] + [len(t) for t in texts])
        first = np.zeros(len(cp), dtype=bool)
        first[edges[:-1][edges[:-1] < len(cp)]] = True
        s = np.flatnonzero(self.starts(cp, first))
        e = np.append(s[1:], len(cp))
        n = len(cp) + 1
        if n > len(self._power):
            self._power, self._inverse = self._powers(self.base, n), self._powers(self.inv, n)
        total = np.zeros(n, dtype=np.uint64)
        np.cumsum(self.code[cp] * self._power[: len(cp)], out=total[1:])
        h = (total[e] - total[s]) * self._inverse[s] + (e - s).astype(np.uint64)
        cell = (h >> np.uint64(64 - FRONT)).astype(np.int64)
        slots = np.where(self.front_hash[cell] == h, self.front_slot[cell], -1)
        rest = np.flatnonzero(slots < 0)
        if len(rest):
            unique, where, index = np.unique(h[rest], return_index=True, return_inverse=True)
            keys = unique.tolist()
            known = list(map(self.slot.get, keys))
            new = [k for k, slot in enumerate(known) if slot is None]
            at = rest[where]
            if new:
                self._learn([whole[s[at[k]] : e[at[k]]] for k in new], [keys[k] for k in new])
            for k in new:
                known[k] = self.slot[keys[k]]
            found = np.array(known, dtype=np.int64)
            slots[rest] = found[index]
            self.front_hash[cell[at]], self.front_slot[cell[at]] = unique, found
        begin = self.at[slots]
        size = self.at[slots + 1] - begin
        out_end = np.cumsum(size)
        gather = np.arange(out_end[-1]) + np.repeat(begin - (out_end - size), size)
        ids = self.flat[gather]
        count = np.append(0, out_end)[np.searchsorted(s, edges)]
        return [ids[a:b] for a, b in zip(count[:-1], count[1:], strict=True)]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of every whole text, in order."""
        held: list[str] = []
        size = 0
        for text in texts:
            if SPECIAL in text:
                if held:
                    yield from self._block(held)
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
                held, size = [], 0
                continue
            if held and size + len(text) > self.block:
                yield from self._block(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
        if held:
            yield from self._block(held)


_TOKENIZERS: dict[str, PieceTokenizer] = {}


def tokenizer_for(spec: str) -> PieceTokenizer:
    """One tokenizer per Python worker: tasks of a reused worker keep what earlier ones have encoded."""
    if spec not in _TOKENIZERS:
        _TOKENIZERS[spec] = PieceTokenizer(spec)
    return _TOKENIZERS[spec]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; only the first may be shorter than the capacity."""
    head = n if n <= capacity else (n % capacity or capacity)
    return [(0, head)] + [(at, capacity) for at in range(head, n, capacity)]


def plan_packing(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs ``(length, rank, per, base, bins, offset)`` and the number of sequences.

    Pieces of ``length`` with ranks rank .. rank + per * bins - 1 go ``per`` to a sequence, into sequences base ..
    base + bins - 1, side by side from ``offset`` on.
    """
    left = {s: c for s, c in histogram.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    sequences = 0

    def free(gap: int, base: int, bins: int) -> None:
        if gap and bins:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((base, bins))

    def put(size: int, per: int, base: int, bins: int, offset: int) -> None:
        runs.append((size, rank[size], per, base, bins, offset))
        rank[size] += per * bins
        left[size] -= per * bins

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for size in large:
        while left[size]:
            mate = next((m for m in large if m <= min(size, capacity - size) and left[m] > (m == size)), None)
            bins = left[size] if mate is None else left[size] // 2 if mate == size else min(left[size], left[mate])
            base, sequences = sequences, sequences + bins
            if mate == size:
                put(size, 2, base, bins, 0)
            else:
                put(size, 1, base, bins, 0)
                if mate is not None:
                    put(mate, 1, base, bins, size)
            free(capacity - size - (mate or 0), base, bins)
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            k = bisect.bisect_left(order, size)
            if k == len(order):
                gap, per = capacity, capacity // size
                bins = max(1, left[size] // per)
                base, sequences = sequences, sequences + bins
            else:
                gap = order[k]
                base, bins = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[k]
                per = gap // size
            per = min(per, left[size])
            use = min(bins, left[size] // per)
            free(gap, base + use, bins - use)
            put(size, per, base, use, capacity - gap)
            free(gap - per * size, base, use)
    return runs, sequences


def _place(runs: list[tuple[int, int, int, int, int, int]]):
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)
    shift = np.int64(48)
    keys = (table[:, 0] << shift) | table[:, 1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            size, rank = f["length"].to_numpy(np.int64), f["rank"].to_numpy(np.int64)
            row = table[np.searchsorted(keys, (size << shift) | rank, side="right") - 1]
            within = rank - row[:, 1]
            yield pd.DataFrame(
                {
                    "doc_id": f["doc_id"], "piece": f["piece"], "start": f["start"], "length": size, "ids_crc32": f["ids_crc32"],
                    "sequence_id": row[:, 3] + within // row[:, 2], "offset": row[:, 5] + within % row[:, 2] * size,
                }
            )

    return run


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack_pieces(spark: SparkSession, pieces: DataFrame, capacity: int, per_salt: int = PER_SALT) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to written pieces ``(doc_id, piece, start, length, ids_crc32)``.

    A length has one salt for every ``per_salt`` pieces and ``LEAST_SALTS`` at least, so a length that many pieces have is ranked by
    many tasks; what meets the driver is one count per salt, some ``pieces / per_salt`` and ``LEAST_SALTS * capacity`` rows.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    histogram.pop(capacity, None)
    runs, sequences = plan_packing(histogram, capacity)
    salts = [0] * capacity
    for size, n in histogram.items():
        salts[size] = max(-(-n // per_salt), LEAST_SALTS)
    first = np.cumsum([0, *salts])  # of each length's salts among all
    own = F.element_at(F.array(*map(F.lit, salts)), F.col("length").cast("int") + 1)
    short = pieces.where(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), own).cast("int"))
    before = np.zeros(int(first[-1]) + 1, dtype=np.int64)
    for r in short.groupBy("length", "salt").agg(F.count("*").alias("n")).collect():
        before[first[r["length"]] + r["salt"]] = r["n"]
    for size in histogram:
        mine = slice(int(first[size]), int(first[size]) + salts[size])
        before[mine] = np.cumsum(before[mine]) - before[mine]

    def shift(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["rank"] = f["rank"].to_numpy() - 1 + before[first[f["length"].to_numpy()] + f["salt"].to_numpy()]
            yield f

    w = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = short.withColumn("rank", F.row_number().over(w).cast("long"))
    place = _place(runs)
    packed = ranked.mapInPandas(lambda frames: place(shift(frames)), PIECES + ", sequence_id long, offset long")
    alone = pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id() + sequences)
    return packed.unionByName(alone.withColumn("offset", F.lit(0).cast("long")))


def tokenise_pieces(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of every document. The tokenizer file has a fixed size and is broadcast."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = tokenizer_for(spec.value)
        for f in frames:
            out = []
            ends = np.array([end_id], dtype="<u4")
            for doc, ids in zip(f["doc_id"], tokenizer.encode(f["text"].tolist()), strict=True):
                ids = np.concatenate([ids, ends]).astype("<u4", copy=False)
                for k, (at, size) in enumerate(cut(len(ids), capacity)):
                    out.append((doc, k, at, size, zlib.crc32(ids[at : at + size].tobytes())))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, PIECES)


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, per_salt: int = PER_SALT) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``.

    A document is its ids and then ``end_id``; only documents above the capacity are cut, into pieces of the
    capacity with a shorter first piece. Null and empty texts are one piece of length 1. Repeated rows are packed as
    often as they come; a null doc_id is kept. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(tokenise_pieces(spark, docs, tokenizer_path, capacity, end_id), "pieces")
    return pack_pieces(spark, pieces, capacity, per_salt)

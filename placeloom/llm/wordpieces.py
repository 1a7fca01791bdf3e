"""Token counts by a linear longest-match automaton.

The vocabulary is a trie; every node carries a failure link and the number of pieces that taking the link pops.
One pass over a word's symbols gives the number of greedy longest-match pieces; no piece is ever built.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "</w>"
MEMO = 1_000_000
UNITS = re.compile(r"\w+|[^\w\s]+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest moves up."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class Automaton:
    """``goto`` holds a dict per node, ``fail`` the failure link (-1: none), ``pops`` the pieces a link pops."""

    def __init__(self, pieces):
        self.goto: list[dict[str, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                nxt = self.goto[node].get(c)
                if nxt is None:
                    nxt = self.goto[node][c] = len(self.goto)
                    self.goto.append({})
                    final.append(False)
                node = nxt
            final[node] = node != 0
        self.fail, self.pops = [-1] * len(self.goto), [0] * len(self.goto)
        queue = [0]
        for node in queue:  # breadth first, so links of shorter strings are ready
            for c, child in self.goto[node].items():
                queue.append(child)
                if final[child]:
                    self.fail[child], self.pops[child] = 0, 1
                    continue
                state, popped = self.fail[node], self.pops[node]
                while state >= 0 and c not in self.goto[state]:
                    popped += self.pops[state]
                    state = self.fail[state]
                if state >= 0:
                    self.fail[child], self.pops[child] = self.goto[state][c], popped

    def count(self, word: str) -> int:
        """Greedy longest-match pieces of a word; 1 (the unknown piece) if it cannot be covered."""
        goto, fail, pops = self.goto, self.fail, self.pops
        node = n = 0
        for c in word:
            while (nxt := goto[node].get(c)) is None:
                if fail[node] < 0:
                    return 1
                n += pops[node]
                node = fail[node]
            node = nxt
        while node:
            if fail[node] < 0:
                return 1
            n += pops[node]
            node = fail[node]
        return n


class Counter(dict):
    """Pieces of a space-delimited token of lower-cased text, remembered up to MEMO tokens."""

    def __init__(self, pieces):
        super().__init__()
        self.symbols = byte_symbols()
        self.end = chr(0xE000)
        self.automaton = Automaton(p[: -len(END)] + self.end if p.endswith(END) else p for p in pieces)

    def __missing__(self, token: str) -> int:
        n = 0
        for unit in UNITS.findall(token):
            n += self.automaton.count("".join([self.symbols[b] for b in unit.encode("utf-8", "surrogatepass")]) + self.end)
        if len(token) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[token] = n
        return n

    def of(self, text: str | None) -> int:
        return sum(map(self.__getitem__, (text or "").lower().split()))


_COUNTERS: dict[int, Counter] = {}


def counter_for(pieces: list[str]) -> Counter:
    """One automaton and memory per Python worker and vocabulary."""
    key = hash(tuple(pieces))
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(pieces)
    return _COUNTERS[key]


def vocabulary(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return list(json.load(f)["model"]["vocab"])


def token_counts(spark: SparkSession, docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_tokens, n_words)``, one row per input row.

    Whole texts are lower-cased and cut at white space into units of word characters and of other symbols; each
    unit is covered greedily by the longest vocabulary pieces. Null and empty texts count 0; very long texts and units are
    counted whole; repeated rows count alike; other columns are ignored; an empty table gives no rows. The vocabulary (a
    file of fixed size) is read on the driver and broadcast, so executors need no file of their own.
    """
    pieces = spark.sparkContext.broadcast(vocabulary(vocabulary_path))

    @F.pandas_udf(T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_words", T.LongType())]))
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = counter_for(pieces.value)
        for texts in batches:
            yield pd.DataFrame(
                {"n_tokens": [counter.of(t) for t in texts], "n_words": [len((t or "").split()) for t in texts]}, dtype="int64"
            )

    return docs.select("doc_id", count("text").alias("c")).select("doc_id", "c.n_tokens", "c.n_words")

"""Exact repeated-substring removal: a multi-document Burrows-Wheeler construction, column by column, over
anchored pieces.

Every window of ``length`` bytes chooses one anchor inside itself (the rightmost smallest hash of its byte grams), so
equal windows anywhere in the corpus choose equal anchors at equal places. Neighbouring windows with the same anchor
form one piece of text.

1. Of pieces with equal bytes only the earliest keeps its windows; map tasks drop their own later copies first. A piece
   whose anchor meets different pieces in its own map task is dealt by content, so a frequent anchor is spread; one
   piece of each such anchor and all others are dealt by anchor, to learn of partners elsewhere.
2. Different pieces with one anchor are a collection of short strings in columns aligned at the anchor. Collections
   above one tile are split by more of the bytes around the anchor, half of the windows' places at a time, until
   every collection fits a tile.
3. From the last column to the first each round inserts one symbol of every string: the order of the suffixes (the
   collection's BWT order) is updated by a stable sort on (collection, symbol), and common prefixes by minima over the
   old prefixes between neighbours. Where neighbours share ``length`` symbols, all but the earliest window is a repeat.
   The strings come as sequential sorted shuffle files; a task holds one tile of them at a time.

Bytes covered by a repeated window are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm.common import Scratch
from placeloom.llm.simhash import _tiles

LENGTH = 100
BLOCK = 1 << 20
TILE = 1000
BATCH = 16 * BLOCK
FIRST_ID = -(1 << 63)
_MASK = np.uint64((1 << 24) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


class Anchors:
    """Pieces of texts: runs of windows that share an anchor."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.gram = 1 << max(0, (length // 3).bit_length() - 1)
        self.width = length - self.gram + 1
        g = np.random.default_rng(17)
        self.code = g.integers(0, 2**64, 256, dtype=np.uint64)
        self.codes2 = g.integers(0, 2**64, 256, dtype=np.uint64)
        self.factor = g.integers(0, 2**63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(g.integers(0, 2**62)) * 2 + 1
        n = BLOCK + 2 * length
        self.power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base, dtype=np.uint64)]))
        self.inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, pow(base, -1, 2**64), dtype=np.uint64)]))

    def blocks(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes, owner, offset in the text, first byte in the block) of segments that together hold every window once."""
        held, owner, offset, at, size = [], [], [], [], 0
        for i, data in enumerate(texts):
            for begin in range(0, len(data) - self.length + 1, BLOCK):
                part = data[begin : begin + BLOCK + self.length - 1]
                if held and size + len(part) > BLOCK + self.length:
                    yield np.frombuffer(b"".join(held), dtype=np.uint8), np.array(owner), np.array(offset), np.array(at)
                    held, owner, offset, at, size = [], [], [], [], 0
                held.append(part)
                owner.append(i)
                offset.append(begin)
                at.append(size)
                size += len(part)
        if held:
            yield np.frombuffer(b"".join(held), dtype=np.uint8), np.array(owner), np.array(offset), np.array(at)

    def pieces(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Of every piece: owner, first window p, windows n, anchor's place ``off`` in it, anchor hash, content hash."""
        out: dict[str, list[np.ndarray]] = {k: [] for k in ("owner", "p", "n", "off", "anchor", "content")}
        for x, owner, offset, at in self.blocks(texts):
            h = self.code[x]
            step, k = 1, 0
            while step < self.gram:
                h = h[:-step] * self.factor[k] + h[step:]
                step, k = 2 * step, k + 1
            h = _mix(h)
            low = (h & ~_MASK) | (_MASK - np.arange(len(h), dtype=np.uint64))
            span = 1
            while 2 * span <= self.width:
                low = np.minimum(low[:-span], low[span:])
                span *= 2
            if span < self.width:
                low = np.minimum(low[: len(low) - (self.width - span)], low[self.width - span :])
            place = (_MASK - (low & _MASK)).astype(np.int64)
            ends = np.append(at[1:], len(x))
            edge = np.zeros(len(x) + 1, dtype=np.int8)
            np.add.at(edge, at, 1)
            np.add.at(edge, ends - self.length + 1, -1)
            valid = np.flatnonzero(np.cumsum(edge[: len(place)], dtype=np.int8) > 0)
            chosen = place[valid]
            cut = np.flatnonzero((chosen[1:] != chosen[:-1]) | (valid[1:] != valid[:-1] + 1)) + 1
            a = valid[np.append(0, cut)]
            b = valid[np.append(cut, len(valid)) - 1]
            total = np.zeros(len(x) + 1, dtype=np.uint64)
            np.cumsum(self.codes2[x] * self.power[: len(x)], out=total[1:])
            n = b - a + 1
            content = (total[b + self.length] - total[a]) * self.inverse[a]
            seg = np.searchsorted(at, a, side="right") - 1
            spot = place[a]
            out["owner"].append(owner[seg])
            out["p"].append(a - at[seg] + offset[seg])
            out["n"].append(n)
            out["off"].append(spot - a)
            out["anchor"].append(h[spot])
            out["content"].append(_mix(content + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        return {k: np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for k, v in out.items()}


def later_copies(key: np.ndarray, doc: np.ndarray, th: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows for which a row with an equal key comes earlier by (doc, th, p), rows that repeat the earliest one)."""
    order = np.lexsort((p, th, doc, key))
    k, d, h, q = key[order], doc[order], th[order], p[order]
    begins = np.append(True, k[1:] != k[:-1])
    head = np.maximum.accumulate(np.where(begins, np.arange(len(k)), 0))
    same = (d == d[head]) & (h == h[head]) & (q == q[head])
    later, again = np.zeros(len(k), dtype=bool), np.zeros(len(k), dtype=bool)
    later[order] = ~same
    again[order] = same & ~begins
    return later, again


# kinds of dealt pieces
ALONE, MIXED, REPEAT, WITNESS = range(4)
DEALT = "pk long, content long, doc long, th long, p int, n short, off short, kind byte"
KINDS = "pk long, doc long, th long, p int, n short, off short, repeat boolean"
HALVES = KINDS.replace("repeat", "lo short, hi short, bytes binary, repeat")


def _kinds(f: pd.DataFrame) -> pd.DataFrame:
    """Set ``kind`` of the pieces of one batch: later copies are REPEAT, different pieces at one anchor MIXED, others ALONE.
    Of every mixed anchor one piece is added as its WITNESS. Repeated rows go."""
    later, again = later_copies(f["content"].to_numpy(), f["doc"].to_numpy(), f["th"].to_numpy(), f["p"].to_numpy())
    kind = np.where(later, REPEAT, ALONE).astype(np.int8)
    fresh = np.flatnonzero(~later & ~again)
    _, first, index, count = np.unique(f["pk"].to_numpy()[fresh], return_index=True, return_inverse=True, return_counts=True)
    kind[fresh[count[index] > 1]] = MIXED
    witness = f.iloc[fresh[first[count > 1]]].assign(kind=np.int8(WITNESS))
    return pd.concat([f.assign(kind=kind)[~again], witness], ignore_index=True)


def _deal(length: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = Anchors(length)
        for f in frames:
            doc, th, texts = f["doc"].to_numpy(np.int64), f["th"].to_numpy(np.int64), f["text"].tolist()
            size, at = 0, 0
            for i in range(len(texts)):
                size += len(texts[i])
                if size >= BATCH or i == len(texts) - 1:
                    part = anchors.pieces([t.encode("utf-8", "surrogatepass") for t in texts[at : i + 1]])
                    if len(part["p"]):
                        rows = pd.DataFrame(
                            {
                                "pk": part["anchor"].view(np.int64), "content": part["content"].view(np.int64), "doc": doc[at : i + 1][part["owner"]],
                                "th": th[at : i + 1][part["owner"]], "p": part["p"].astype(np.int32), "n": part["n"].astype(np.int16), "off": part["off"].astype(np.int16),
                            }
                        )
                        yield _kinds(rows)
                    size, at = 0, i + 1

    return run


def _by_kind() -> Column:
    """Where a dealt piece goes: mixed ones by content, known repeats anywhere, the rest by anchor."""
    kind = F.col("kind")
    return F.when(kind == MIXED, F.col("content")).when(kind == REPEAT, F.xxhash64("th", "p")).otherwise(F.col("pk"))


def _resolve(more: tuple[str, ...] = ()):
    """Repeats among equal pieces, and the earliest of each where an anchor has several different pieces.

    Rows come sorted by (pk, content, doc, th, p, kind); one row is carried from batch to batch, so no anchor or content
    is ever held whole. A witness says that its anchor is mixed; its piece itself has gone by content."""
    columns = ["pk", "doc", "th", "p", "n", "off", *more, "repeat"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None
        for f in frames:
            known = f["kind"].to_numpy() == REPEAT
            out, g = [f[known].assign(repeat=True)], f[~known]
            if len(g):
                if carry is not None:
                    g = pd.concat([carry, g], ignore_index=True)
                pk, content, kind = g["pk"].to_numpy(), g["content"].to_numpy(), g["kind"].to_numpy()
                begins = np.append(True, pk[1:] != pk[:-1])
                head = begins | np.append(True, content[1:] != content[:-1])
                at = np.maximum.accumulate(np.where(head, np.arange(len(g)), 0))
                same = np.ones(len(g), dtype=bool)  # as the earliest piece of this content
                for c in ("doc", "th", "p"):
                    v = g[c].to_numpy()
                    same &= v == v[at]
                starts = np.flatnonzero(begins)
                mixed = (np.add.reduceat(head.astype(np.int64), starts) > 1) | np.logical_or.reduceat(kind != ALONE, starts)
                piece = kind != WITNESS
                out.append(g[~same & piece].assign(repeat=True))
                out.append(g[head & piece & mixed[np.cumsum(begins) - 1]].assign(repeat=False))
                carry = g.iloc[at[-1] : at[-1] + 1]
                if mixed[-1]:  # it has been sent on
                    carry = carry.assign(kind=np.int8(WITNESS))
            found = pd.concat(out, ignore_index=True)[columns]
            if len(found):
                yield found

    return run


PLACED = "key long, doc long, th long, p int, n short, off short, lo short, hi short, bytes binary"


def _strings(length: int, width: int):
    """Cut the candidates' bytes out of the texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, th, text, pieces in zip(f["doc"], f["th"], f["text"], f["pieces"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                rows += [(c["pk"], doc, th, c["p"], c["n"], c["off"], 0, width, data[c["p"] : c["p"] + c["n"] - 1 + length]) for c in pieces]
            if rows:
                yield pd.DataFrame(rows, columns=["key", "doc", "th", "p", "n", "off", "lo", "hi", "bytes"])

    return run


def _digest(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def _halves(length: int):
    """Split strings whose windows hold the anchor at places lo .. hi - 1 into those at places from the middle on and those
    before. The windows of one half share more bytes around the anchor, and these join the key."""

    def cut(key, doc, th, p, n, off, lo, hi, data):
        mid = (lo + hi) // 2
        upper = min(n, off - mid + 1)
        for skip, size, a, b in ((0, upper, mid, hi), (max(0, upper), n - max(0, upper), lo, mid)):
            if size > 0:
                own, place = data[skip : skip + size - 1 + length], off - skip
                where = b"%d,%d," % (key, a)
                new = _digest(where, own[place - a : place - b + 1 + length])
                yield new, _digest(b"%d,%d," % (new, place), own), doc, th, p + skip, size, place, a, b, own

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            columns = [f[c].tolist() for c in ("key", "doc", "th", "p", "n", "off", "lo", "hi", "bytes")]
            rows = [r for row in zip(*columns, strict=True) for r in cut(*row)]
            if rows:
                out = pd.DataFrame(rows, columns=["pk", "content", "doc", "th", "p", "n", "off", "lo", "hi", "bytes"])
                later, again = later_copies(out["content"].to_numpy(), out["doc"].to_numpy(), out["th"].to_numpy(), out["p"].to_numpy())
                yield out.assign(kind=np.where(later, REPEAT, MIXED).astype(np.int8))[~again]

    return run


def repeated_columns(
    group: np.ndarray, doc: np.ndarray, th: np.ndarray, p: np.ndarray, off: np.ndarray, strings: list[bytes], length: int
) -> np.ndarray:
    """(strings, columns) flags of windows that start earlier elsewhere; column c of string i is its window c - shift_i.

    Strings are aligned at their anchors; rounds run over columns from right to left. A string that comes twice is not
    earlier than itself.
    """
    count = len(strings)
    shift = int(off.max()) - off  # columns before the string's first byte
    size = np.array([len(s) for s in strings])
    width = int((shift + size).max())
    grid = np.zeros((width, count), dtype=np.int16)
    flat = np.frombuffer(b"".join(strings), dtype=np.uint8)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(count), size)
    grid[np.arange(len(flat)) - begin[owner] + shift[owner], owner] = flat.astype(np.int16) + 1
    sort = np.lexsort((p, th, doc))
    step = np.append(False, (np.diff(doc[sort]) != 0) | (np.diff(th[sort]) != 0) | (np.diff(p[sort]) != 0))
    rank = np.empty(count, dtype=np.int64)
    rank[sort] = np.cumsum(step)
    _, collection = np.unique(group, return_inverse=True)
    order = np.argsort(collection, kind="stable")
    common = np.zeros(count, dtype=np.int64)  # with the neighbour before in the order
    flags = np.zeros((count, width - length + 1), dtype=bool)
    for col in range(width - 1, -1, -1):
        symbol = grid[col][order]
        new = np.argsort(collection[order] * 257 + symbol, kind="stable")
        old = new  # place in the old order
        s, c = symbol[new], collection[order][new]
        linked = np.append(False, (s[1:] == s[:-1]) & (c[1:] == c[:-1]) & (s[1:] > 0))
        prefix = np.zeros(count, dtype=np.int64)
        at = np.flatnonzero(linked)
        if len(at):
            pairs = np.stack([old[at - 1] + 1, old[at] + 1], axis=1).ravel()
            prefix[at] = 1 + np.minimum.reduceat(np.append(common, 0), pairs)[::2]
        order, common = order[new], prefix
        if col <= width - length:
            joined = common >= length
            if joined.any():
                begins = np.flatnonzero(~joined)
                ranks = rank[order]
                least = np.minimum.reduceat(ranks, begins)
                runs = np.cumsum(~joined) - 1
                flags[order, col] = ranks != least[runs]
    return flags


SPANS = "doc long, th long, a int, b int"


def _columns(length: int, most: int = 10_000):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _tiles((g.rename(columns={"key": "tile_key"}) for g in frames), most):
            doc, th, p, off = (f[k].to_numpy().astype(np.int64) for k in ("doc", "th", "p", "off"))
            flags = repeated_columns(f["tile_key"].to_numpy(), doc, th, p, off, f["bytes"].tolist(), length)
            edge = np.diff(flags.astype(np.int8), axis=1, prepend=0, append=0)
            i, a = np.nonzero(edge == 1)
            _, b = np.nonzero(edge == -1)
            shift = int(off.max()) - off
            if len(i):
                start = p[i] - shift[i]
                yield pd.DataFrame({"doc": doc[i], "th": th[i], "a": (start + a).astype(np.int32), "b": (start + b - 1 + length).astype(np.int32)})

    return run


def _split(scratch: Scratch, strings: DataFrame, length: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """``strings`` whose collections all fit a tile, and the spans of equal strings found on the way. Only the collections
    above a tile are split again; after at most seven halvings a collection holds one place of its windows, and equal
    strings are one."""
    fit, spans = [], []
    hot = scratch.write(strings.groupBy("key").count().where(F.col("count") > tile), "hot")
    while not hot.isEmpty():
        fit.append(strings.join(hot, "key", "left_anti"))
        halves = strings.join(hot.select("key"), "key").select(*strings.columns).mapInPandas(_halves(length), f"{DEALT}, lo short, hi short, bytes binary")
        dealt = halves.repartition(_by_kind()).sortWithinPartitions("pk", "content", "doc", "th", "p", "kind")
        found = scratch.write(dealt.mapInPandas(_resolve(("lo", "hi", "bytes")), HALVES), "halves")
        spans.append(_as_spans(found, length))
        left = found.where("not repeat").withColumnRenamed("pk", "key").drop("repeat").select(*strings.columns)
        sizes = scratch.write(left.groupBy("key").count().where("count > 1"), "sizes")
        strings = left.join(sizes.select("key"), "key", "left_semi")
        hot = sizes.where(F.col("count") > tile)
    fit.append(strings)
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return union(fit), union(spans) if spans else None


def _as_spans(kinds: DataFrame, length: int) -> DataFrame:
    return kinds.where("repeat").select("doc", "th", F.col("p").alias("a"), (F.col("p") + F.col("n") - 1 + length).cast("int").alias("b"))


def removed_runs(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open intervals as maximal runs."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    cut = np.flatnonzero(a[1:] > b[:-1]) + 1
    return list(zip(a[np.append(0, cut)].tolist(), b[np.append(cut, len(a)) - 1].tolist(), strict=True))


def _finish(with_text: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, text, a, b in zip(f["doc_id"], f["text"], f["a"], f["b"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                runs = removed_runs(np.asarray(a), np.asarray(b)) if a is not None and len(a) else []
                kept, at = [], 0
                for x, y in runs:
                    kept.append(data[at:x])
                    at = y
                kept.append(data[at:])
                rest = b"".join(kept)
                row = (doc, len(data), sum(min(y, len(data)) - x for x, y in runs), len(runs), hashlib.sha256(rest).hexdigest())
                out.append(row + (rest,) if with_text else row)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, with_kept: bool = False, tile: int = TILE) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept])``, one row per input row.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a smaller doc_id, or earlier in
    the same document. Null texts are empty, a null doc_id comes before all others. Different texts under one doc_id
    (or without one) are documents of their own, in the order of a 64-bit hash of the text. Rows equal in doc_id and
    text are one document: it is not earlier than itself, and every such row gets its result. Texts are judged as they
    came, not on what is left. Other columns are ignored; an empty table gives no rows. Exact up to 64-bit hash collisions.
    """
    scratch = Scratch(spark, "substrings")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("doc_id", F.lit(FIRST_ID)).cast("long").alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    dealt = rows.select("doc", "th", "text").mapInPandas(_deal(length), DEALT)
    sorted_pieces = dealt.repartition(_by_kind()).sortWithinPartitions("pk", "content", "doc", "th", "p", "kind")
    kinds = scratch.write(sorted_pieces.mapInPandas(_resolve(), KINDS), "kinds")
    per_doc = kinds.where("not repeat").groupBy("doc", "th").agg(F.collect_list(F.struct("pk", "p", "n", "off")).alias("pieces"))
    texts = rows.groupBy("doc", "th").agg(F.first("text").alias("text"))
    strings = scratch.write(texts.join(per_doc, ["doc", "th"]).select("doc", "th", "text", "pieces").mapInPandas(_strings(length, Anchors(length).width), PLACED), "strings")
    fit, spans = _split(scratch, strings, length, tile)
    edges = fit.repartition("key").sortWithinPartitions("key").mapInPandas(_columns(length), SPANS)
    spans = [_as_spans(kinds, length), edges] + ([] if spans is None else [spans])
    spans = scratch.write(reduce(DataFrame.unionByName, spans), "spans")
    scratch.keep(spans)
    grouped = spans.groupBy("doc", "th").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return rows.join(grouped, ["doc", "th"], "left").select("doc_id", "text", "a", "b").mapInPandas(_finish(with_kept), schema)

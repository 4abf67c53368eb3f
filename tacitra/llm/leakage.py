"""Passages of held-out test items standing in training documents.

Pigeonhole matching with an error budget in words: every window of ``window`` consecutive words of an item is split into
``max_edits + 1`` pieces; a document that holds the window with at most ``max_edits`` word insertions, deletions or
replacements holds at least one piece exactly. Pieces are found by hashing the document's word ids at all places at
once; each hit is verified with Myers' bit-parallel distance over words, so hash collisions never count. The smallest
distance of a document and item is part of the result: ``edits = 0`` is a window that stands there word for word.

Words are maximal runs of letters and digits in lower case.

Defined results
* null, empty and blank documents and items give no row; items shorter than the window give no row;
* a repeated item id is treated as one item with several texts; repeated documents each give their rows;
* every (document, item) pair comes out once a document row; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tacitra.session import checkpointed

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    if "İ" in text:  # its lower case holds a mark that is no letter
        return [w.lower() for w in _WORD.findall(text)]
    return _WORD.findall(text.lower())


def distance(pattern: list[int], text: list[int], limit: int) -> int:
    """The edits between ``pattern`` and the nearest substring of ``text``, limit + 1 if more (Myers, one bit per pattern word)."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = min(m, limit + 1)
    for w in text:
        eq = masks.get(w, 0)
        x = eq | minus
        d = (((x & plus) + plus) ^ plus) | x
        hp, hn = minus | (full & ~(d | plus)), plus & d
        score += bool(hp & high) - bool(hn & high)
        hp, hn = hp << 1 & full, hn << 1 & full
        plus, minus = hn | (full & ~(x | hp)), hp & x
        if score < best:
            best = score
            if not best:
                break
    return best


def within_distance(pattern: list[int], text: list[int], limit: int) -> bool:
    """Whether some substring of ``text`` is within ``limit`` edits of ``pattern``."""
    return distance(pattern, text, limit) <= limit


class Pieces:
    """The pieces of all windows of a block of items, with what is needed to verify a hit."""

    def __init__(self, items: list[tuple[int, str]], window: int, max_edits: int):
        self.window, self.max_edits = window, max_edits
        self.vocabulary: dict[str, int] = {}
        cuts = [window * i // (max_edits + 1) for i in range(max_edits + 2)]
        self.windows: list[tuple[int, tuple[int, ...]]] = []
        found: dict[int, dict[tuple[int, ...], list[tuple[int, int]]]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for at in range(len(ids) - window + 1):
                whole = tuple(ids[at : at + window])
                self.windows.append((item, whole))
                for a, b in zip(cuts, cuts[1:]):
                    found.setdefault(b - a, {}).setdefault(whole[a:b], []).append((len(self.windows) - 1, a))
        self.by_size = {}
        for size, pieces in found.items():
            keys = list(pieces)
            hashes = self._roll(np.array([w for k in keys for w in k], np.uint64), size)[::size]
            order = np.argsort(hashes, kind="stable")
            self.by_size[size] = (hashes[order], [keys[i] for i in order], [pieces[keys[i]] for i in order])

    @staticmethod
    def _roll(ids: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(max(ids.size - size + 1, 0), np.uint64)
        for i in range(size):
            out = out * _BASE + ids[i : i + out.size] * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(29)
        return out

    def items_in(self, ids: np.ndarray) -> dict[int, int]:
        """The items with a window in the text of these word ids (0 for words that no item has), each with its fewest edits."""
        found: dict[int, int] = {}
        for size, (hashes, keys, uses) in self.by_size.items():
            if ids.size < size:
                continue
            rolled = self._roll(ids, size)
            at = np.searchsorted(hashes, rolled)
            hit = np.flatnonzero(hashes[np.minimum(at, hashes.size - 1)] == rolled)
            for place in hit:
                k = at[place]
                while k < hashes.size and hashes[k] == rolled[place]:
                    if tuple(ids[place : place + size].tolist()) == keys[k]:
                        for which, offset in uses[k]:
                            item, whole = self.windows[which]
                            best = found.get(item, self.max_edits + 1)
                            if best:
                                low = max(0, place - offset - self.max_edits)
                                part = ids[low : place - offset + self.window + self.max_edits].tolist()
                                edits = distance(list(whole), part, best - 1)
                                if edits < best:
                                    found[item] = edits
                    k += 1
        return found


def leaked_items(
    docs: DataFrame, doc_col: str, text_col: str, items: DataFrame, item_col: str, item_texts: list[str], window: int = 10, max_edits: int = 0, block_chars: int = 20_000_000
) -> DataFrame:
    """(document id, item id, edits) for every document that holds a window of one of the item's texts.

    The items are a stated query set. Up to ``block_chars`` characters of them are read by the driver and broadcast, and
    all documents are held against them in one pass without a shuffle. A larger set stays distributed: the hashes of its
    pieces and those of the documents' words meet in a join, and each hit is verified where it falls.
    """
    lists = items.select(F.col(f"`{item_col}`").alias("i"), F.explode(F.array(*[F.col(f"`{c}`") for c in item_texts])).alias("t")).where("i is not null and trim(t) != ''").distinct()
    source = docs.select(F.col(f"`{doc_col}`").alias("d"), F.col(f"`{text_col}`").alias("t")).where("t is not null")
    if (lists.agg(F.sum(F.length("t"))).first()[0] or 0) <= block_chars:
        out = _against_block(source, lists, window, max_edits)
    else:
        out = _against_joined(source, lists, window, max_edits)
    return out.select(F.col("d").alias(doc_col), F.col("i").alias(item_col), "edits")


def _against_block(source: DataFrame, lists: DataFrame, window: int, max_edits: int) -> DataFrame:
    """The items as one broadcast block, the documents in one pass."""
    item_type = lists.schema["i"].dataType
    types = f"`d` {source.schema['d'].dataType.simpleString()}, `i` {item_type.simpleString()}, edits int"
    arrow_item = to_arrow_type(item_type)
    block = [(r.i, r.t) for r in lists.orderBy("i", "t").toLocalIterator()]  # bounded by block_chars
    pieces = source.sparkSession.sparkContext.broadcast(vars(Pieces(block, window, max_edits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Pieces.__new__(Pieces)
        known.__dict__.update(pieces.value)
        get = known.vocabulary.get
        for batch in batches:
            ids, found = batch.column(0), []
            for at, text in enumerate(batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                words = np.array([get(w, 0) for w in words_of(text)], np.uint64)
                if np.count_nonzero(words):
                    found.extend((at, item, edits) for item, edits in sorted(known.items_in(words).items()))
            if found:
                rows, which, edits = zip(*found)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(which, arrow_item), pa.array(edits, pa.int32())], names=["d", "i", "edits"])

    return source.mapInArrow(run, types)


def _against_joined(source: DataFrame, lists: DataFrame, window: int, max_edits: int) -> DataFrame:
    """The items' pieces and the documents' words met in a join on piece hashes; every hit carries its surroundings.

    A piece that very many windows share (a common phrase) is hot on both sides: its hits are spread over salts.
    """
    cuts = [window * i // (max_edits + 1) for i in range(max_edits + 2)]
    sizes = sorted({b - a for a, b in zip(cuts, cuts[1:])})
    item_kind, doc_kind = lists.schema["i"].dataType.simpleString(), source.schema["d"].dataType.simpleString()
    salts = 16

    def hashes_of(words: list[str], size: int) -> np.ndarray:
        ids = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        return Pieces._roll(ids, size).view(np.int64)

    def cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text)
                hashed = {n: hashes_of(words, n) for n in sizes if len(words) >= n}
                for k in range(len(words) - window + 1):
                    whole = " ".join(words[k : k + window])
                    for a, b in zip(cuts, cuts[1:]):
                        at.append(row)
                        out.append((int(hashed[b - a][k + a]), b - a, a, whole))
            if at:
                h, n, a, w = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(h, pa.int64()), pa.array(n, pa.int32()), pa.array(a, pa.int32()), pa.array(w)], names=["i", "h", "n", "a", "whole"])

    pieces = lists.mapInArrow(cut_items, f"i {item_kind}, h bigint, n int, a int, whole string").distinct()
    present = checkpointed(pieces)
    # a bitmap of fixed size keeps words that no item has out of the exchange; what passes by chance is sorted out by the join
    bits = 1 << 26
    marks = present.select(F.pmod("h", F.lit(bits)).cast("int").alias("b")).distinct().select(F.floor(F.col("b") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("v"))
    words64 = marks.groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()  # 2^20 rows at most
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[words64.w.to_numpy(int)] = words64.v.to_numpy(np.int64)
    shared = source.sparkSession.sparkContext.broadcast(bitmap)

    def cut_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            at, out = [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                words = words_of(text)
                for n in sizes:
                    hashed = hashes_of(words, n)
                    bit = hashed % bits
                    for k in np.flatnonzero(known[bit >> 6] >> (bit & 63) & 1):
                        low = max(0, k - window - max_edits)
                        at.append(row)
                        out.append((int(hashed[k]), n, int(k - low), " ".join(words[low : k + window + max_edits])))
            if at:
                h, n, k, near = zip(*out)
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(h, pa.int64()), pa.array(n, pa.int32()), pa.array(k, pa.int32()), pa.array(near)], names=["r", "d", "h", "n", "k", "near"])

    hits = source.select(F.monotonically_increasing_id().alias("r"), "d", "t").mapInArrow(cut_docs, f"r bigint, d {doc_kind}, h bigint, n int, k int, near string")
    hits = hits.withColumn("salt", F.pmod(F.xxhash64("r", "k"), F.lit(salts)).cast("int"))
    spread = present.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = hits.join(spread, ["h", "n", "salt"]).select("r", "d", "i", "k", "a", "near", "whole")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kept = [], []
            for row, (k, a, near, whole) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("k", "a", "near", "whole")])):
                words, code = near.split(" "), {}
                low = max(0, k - a - max_edits)
                part = [code.setdefault(w, len(code)) for w in words[low : k - a + window + max_edits]]
                edits = distance([code.setdefault(w, len(code)) for w in whole.split(" ")], part, max_edits)
                if edits <= max_edits:
                    at.append(row)
                    kept.append(edits)
            if at:
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("r", "d", "i")), pa.array(kept, pa.int32())], names=["r", "d", "i", "edits"])

    return met.mapInArrow(verify, f"r bigint, d {doc_kind}, i {item_kind}, edits int").groupBy("r", "d", "i").agg(F.min("edits").alias("edits")).select("d", "i", "edits")

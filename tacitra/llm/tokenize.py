"""Encoding of a text column with a byte-level BPE vocabulary of a public tokenizer.

Texts are split by the tokenizer's pattern; the distinct words of a batch are laid out as one flat array of symbols and
merged in rounds. In every round the rank of each adjacent pair is found by binary search over the sorted pair keys,
each word merges all places of its lowest-ranked pair, and words without a known pair leave the array.

Defined results
* null and empty texts have an empty list; strings that look like special tokens are ordinary text;
* blank texts are encoded as they are; texts of any length are encoded whole;
* repeated rows and repeated ids are encoded on their own; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of 'base64 id' lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeTable:
    """The vocabulary as arrays: ids of single bytes, and sorted pair keys with the id of the merged token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.merged = np.array(merged, np.int64)[order]

    @classmethod
    def of(cls, arrays: tuple[np.ndarray, np.ndarray, np.ndarray]) -> MergeTable:
        """The table of the three arrays, which travel as a broadcast."""
        table = cls.__new__(cls)
        table.byte_ids, table.keys, table.merged = arrays
        return table

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, offsets of the words)."""
        none = np.iinfo(np.int64).max
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_owner = [], []
        while symbols.size:
            rank = np.full(symbols.size, none)
            same = np.flatnonzero(owner[1:] == owner[:-1])
            key = symbols[same] << 32 | symbols[same + 1]
            at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
            rank[same] = np.where(self.keys[at] == key, self.merged[at], none)
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            low = np.minimum.reduceat(rank, starts)
            length = np.diff(np.append(starts, symbols.size))
            low = np.repeat(low, length)
            idle = low == none
            if idle.any():
                done_symbols.append(symbols[idle])
                done_owner.append(owner[idle])
                active = ~idle
                symbols, owner, rank, low = symbols[active], owner[active], rank[active], low[active]
                if not symbols.size:
                    break
            hit = rank == low
            # in a run of overlapping places every second one merges
            place = np.flatnonzero(hit)
            first = np.concatenate(([True], np.diff(place) != 1))
            run_start = np.maximum.accumulate(np.where(first, np.arange(place.size), 0))
            take = place[(np.arange(place.size) - run_start) % 2 == 0]
            symbols[take] = rank[take]
            keep = np.ones(symbols.size, bool)
            keep[take + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        ids = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
        who = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
        order = np.argsort(who, kind="stable")
        return ids[order].astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(words)))))


def encode_batch(table: MergeTable, texts: list[str | None], chunk_chars: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, offsets of the texts). Works through about ``chunk_chars`` at a time."""
    import regex

    find = regex.compile(PATTERN).findall  # the library keeps compiled patterns
    ids, counts, at = [], [], 0
    while at < len(texts):
        seen: dict[str, int] = {}
        codes: list[int] = []
        per_text, chars = [], 0
        while at < len(texts) and (chars < chunk_chars or not per_text):
            words = find(texts[at]) if texts[at] else []
            codes.extend([seen.setdefault(w, len(seen)) for w in words])
            per_text.append(len(words))
            chars += len(texts[at] or "")
            at += 1
        if not codes:
            counts.extend([0] * len(per_text))
            continue
        flat, offsets = table.encode_words([w.encode("utf-8", "surrogatepass") for w in seen])
        code = np.array(codes)
        size = np.diff(offsets)[code]
        begin = np.concatenate(([0], np.cumsum(size)))
        ids.append(flat[np.repeat(offsets[code] - begin[:-1], size) + np.arange(begin[-1])])
        ends = begin[np.cumsum(per_text)]
        counts.extend(np.diff(np.concatenate(([0], ends))))
    return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of consecutive slices of at most ``most`` in all, or of one row that is larger."""
    at, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield at, i - at
            at, held = i, 0
        held += int(size)
    if at < len(sizes):
        yield at, len(sizes) - at


def encode_corpus(df: DataFrame, id_col: str, text_col: str, ranks_path: str = DEFAULT_RANKS, slice_bytes: int = 1 << 23) -> DataFrame:
    """(id, ids ARRAY<INT>) for every row. One pass, no shuffle; the vocabulary (fixed size, some MB) is broadcast."""
    made = MergeTable(read_ranks(ranks_path))
    arrays = df.sparkSession.sparkContext.broadcast((made.byte_ids, made.keys, made.merged))
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = MergeTable.of(arrays.value)
        for batch in batches:
            # a text has no more tokens than bytes, so slices by bytes keep the lists within the limit of 32-bit offsets
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for at, rows in slices(sizes, slice_bytes):
                part = batch.slice(at, rows)
                ids, offsets = encode_batch(table, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], names=["id", "ids"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)

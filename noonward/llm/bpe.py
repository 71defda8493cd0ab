"""Byte-level BPE encoding and decoding.

Texts are cut by the tokenizer's pattern, the distinct matches of a batch are sorted into buckets by length,
and each bucket is a padded matrix of token ids. In every round each row merges its leftmost pair of least
rank; the pair's rank comes from an open-addressing hash table. A merge takes one cell from every row that is
still at work, so the matrix loses a column per round, and rows that have no pair left are taken out.

Rank files are read by the workers from `ranks_path`, which must be the same place on every machine (an
installed package or a mounted folder).
"""

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from noonward.llm.common import extended, slices, without

#: A rank no pair has.
NO_PAIR = np.int32(2**31 - 1)
#: Bytes up to which a match goes through the matrices; the work of a row grows with the square of its length,
#: so longer ones (unbroken runs of letters or blanks) are merged with a heap, to the same ids.
MATRIX_BYTES = 1024
#: Cells of a matrix.
MATRIX_CELLS = 1 << 20


class Ranks:
    """Ranks of a byte-level vocabulary, the hash table of its pairs and the bytes of its tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.by_bytes = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.single = np.array([self.by_bytes[bytes([b])] for b in range(256)], np.int32)
        most = max(self.by_bytes.values()) + 1
        sizes = np.zeros(most + 1, np.int64)
        tokens = [b""] * most
        for token, rank in self.by_bytes.items():
            tokens[rank] = token
            sizes[rank + 1] = len(token)
        self.sizes, self.starts = sizes[1:], np.cumsum(sizes)
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self._index_pairs()

    def _index_pairs(self) -> None:
        get = self.by_bytes.get
        left, right, rank = [], [], []
        for token, r in self.by_bytes.items():
            for i in range(1, len(token)):
                if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        keys = self._key(np.array(left, np.int32), np.array(right, np.int32))
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, NO_PAIR, np.int32)
        values, slots, left_over = np.array(rank, np.int32), self._slot(keys), np.arange(len(keys))
        while left_over.size:
            free = left_over[self.keys[slots[left_over]] == np.uint64(2**64 - 1)]
            _, first = np.unique(slots[free], return_index=True)
            won = free[first]
            self.keys[slots[won]], self.values[slots[won]] = keys[won], values[won]
            left_over = left_over[self.keys[slots[left_over]] != keys[left_over]]
            slots[left_over] = (slots[left_over] + 1) & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NO_PAIR where it has none; negative ids are padding."""
        out = np.full(left.shape, NO_PAIR, np.int32)
        real = (left >= 0) & (right >= 0)
        keys = self._key(left[real], right[real])
        found, slots, open_ = np.full(keys.shape, NO_PAIR, np.int32), self._slot(keys), np.arange(keys.size)
        while open_.size:
            held = self.keys[slots[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (held != np.uint64(2**64 - 1))]
            slots[open_] = (slots[open_] + 1) & self.mask
        out[real] = found
        return out

    def _merge_rows(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers and final ids (padded with -1) of the rows of a matrix, as they come to an end."""
        rows = np.arange(len(ids))
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while rows.size:
            if ranks.shape[1] == 0:
                yield rows, ids
                return
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            if (ended := best == NO_PAIR).any():
                yield rows[ended], ids[ended]
                go = ~ended
                rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
                if not rows.size:
                    return
            n, width = ids.shape
            each = np.arange(n)
            ids[each, at] = best
            keep = np.ones((n, width), bool)
            keep[each, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[each, at] = False
            ranks = ranks[keep].reshape(n, width - 2)
            before, after = each[at > 0], each[at < width - 2]
            ranks[before, at[before] - 1] = self.pair_ranks(ids[before, at[before] - 1], ids[before, at[before]])
            ranks[after, at[after]] = self.pair_ranks(ids[after, at[after]], ids[after, at[after] + 1])

    def _merge_long(self, piece: bytes) -> list[int]:
        """Ids of one long match, by a heap of its pairs ordered by rank and place."""
        get = self.by_bytes.get
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, 2) for i in range(len(parts) - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= len(parts) or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < len(parts):
                    whole = parts[x] + parts[after[x]]
                    if (r := get(whole)) is not None:
                        heapq.heappush(heap, (r, x, len(whole)))
        return [self.by_bytes[p] for p in parts if p is not None]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces one after another, and how many each has."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        single, rest = [], []
        for i, piece in enumerate(pieces):
            if (r := self.by_bytes.get(piece)) is not None:
                single.append((i, r))
            elif len(piece) > MATRIX_BYTES:
                done.append((np.array([i]), np.array([self._merge_long(piece)], np.int32)))
            elif piece:
                rest.append(i)
        if single:
            which, ranks = np.array(single, np.int64).T
            done.append((which, ranks.astype(np.int32)[:, None]))
        sizes = np.array([len(pieces[i]) for i in rest], np.int64)
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            size = int(sizes[order[at]])
            width = size if size < 16 else -(-size // 8) * 8
            bucket = order[at : at + max(1, MATRIX_CELLS // width)]
            bucket = bucket[: np.searchsorted(sizes[bucket], width, "right")]
            at += len(bucket)
            chosen = [rest[k] for k in bucket]
            padded = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in chosen), np.uint8)
            ids = self.single[padded.reshape(len(chosen), width)]
            ids[np.arange(width) >= sizes[bucket][:, None]] = -1
            which = np.array(chosen, np.int64)
            done += [(which[rows], out) for rows, out in self._merge_rows(ids)]
        counts = np.zeros(len(pieces), np.int64)
        for which, ids in done:
            counts[which] = (ids >= 0).sum(1)
        ends = np.cumsum(counts)
        flat = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for which, ids in done:
            real = ids >= 0
            places = (ends - counts)[which][:, None] + np.cumsum(real, 1) - 1
            flat[places[real]] = ids[real]
        return flat, counts

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after another, and how many each id has."""
        sizes = self.sizes[ids]
        return self.blob[spread(self.starts[ids], sizes)], sizes


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, `size` numbers each."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


@lru_cache(maxsize=4)
def ranks_at(path: str) -> Ranks:
    """The vocabulary, read once by each worker."""
    return Ranks(path)


@lru_cache(maxsize=4)
def splitter(pattern: str):
    return regex.compile(pattern)


def split_batch(texts: list[str], pattern: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct matches, the number of each match in turn, and how many matches each text has."""
    find = splitter(pattern).findall
    found = [find(t) for t in texts]
    pieces = list(dict.fromkeys(chain.from_iterable(found)))
    index = dict(zip(pieces, range(len(pieces))))
    per_text = np.array([len(p) for p in found], np.int64)
    which = np.fromiter(map(index.__getitem__, chain.from_iterable(found)), np.int64, int(per_text.sum()))
    return pieces, which, per_text


def per_text_sums(values: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Sums of `values` over runs of the given lengths, empty runs included."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(per_text)
    return total[ends] - total[ends - per_text]


def encode_texts(texts: list[str], ranks: Ranks, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts one after another, and how many each text has."""
    pieces, which, per_text = split_batch(texts, pattern)
    flat, counts = ranks.encode_pieces([p.encode() for p in pieces])
    starts = np.cumsum(counts) - counts
    return flat[spread(starts[which], counts[which])], per_text_sums(counts[which], per_text)


def _lists(values: np.ndarray, per_text: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32), pa.array(values, pa.int32()))


def _binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`df` with a column of token ids (array of int) for each whole text.

    A missing or empty text has no ids. Rows stay as they are, repeated ones too; a column that is already
    called `ids` is replaced.
    """
    base = without(df, ids)

    def run(batches):
        ranks = ranks_at(ranks_path)
        for batch, texts in slices(batches, text):
            yield extended(batch, **{ids: _lists(*encode_texts(texts, ranks, pattern))})

    return base.mapInArrow(run, T.StructType([*base.schema, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`df` with the bytes that the ids of each row stand for; no ids, or a missing array, give no bytes.

    An id outside the vocabulary is an error. A column that is already called `decoded` is replaced.
    """
    base = without(df, decoded)

    def run(batches):
        ranks = ranks_at(ranks_path)
        for batch in batches:
            rows = batch.column(ids).to_pylist()
            per_text = np.array([len(r or ()) for r in rows], np.int64)
            flat = np.fromiter((i for r in rows for i in r or ()), np.int64, int(per_text.sum()))
            data, sizes = ranks.decode_flat(flat)
            yield extended(batch, **{decoded: _binaries(data, per_text_sums(sizes, per_text))})

    return base.mapInArrow(run, T.StructType([*base.schema, T.StructField(decoded, T.BinaryType())]))


def encode_and_decode(
    df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """`encode` and, from the ids alone, `decode` in one pass over the rows, for checks of a corpus."""
    base = without(df, ids, decoded)

    def run(batches):
        ranks = ranks_at(ranks_path)
        for batch, texts in slices(batches, text):
            flat, per_text = encode_texts(texts, ranks, pattern)
            data, sizes = ranks.decode_flat(flat)
            made = {ids: _lists(flat, per_text), decoded: _binaries(data, per_text_sums(sizes, per_text))}
            yield extended(batch, **made)

    added = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.BinaryType())]
    return base.mapInArrow(run, T.StructType([*base.schema, *added]))

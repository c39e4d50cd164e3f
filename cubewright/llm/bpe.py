"""Byte-level BPE encoding and decoding with a hierarchical-bitmap queue of merge ranks."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from cubewright.llm.common import batches_of, map_arrow, sized_batches

#: Units and pieces of up to so many characters are remembered, each kind in about so many bytes of
#: a Python worker and until its task ends. What one takes beside its characters and ids is UNIT_BYTES.
CACHE_CHARS, CACHE_BYTES, UNIT_BYTES = 48, 64 << 20, 190
#: Texts are coded together up to so many bytes, which bounds the scratch memory; a longer text
#: goes in parts, cut where the pattern's matches part.
BATCH_BYTES = 2 << 20
#: Text is cut, for remembering, at single spaces between two characters that aren't white space.
#: The pattern's matches never reach over such a space but start with it.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _edgy(unit: str) -> bool:
    return not unit or unit[0].isspace() or unit[-1].isspace()


def _plain(text: str) -> list[str]:
    return text.split(" ")


class RankQueue:
    """Which merge ranks wait, as a bitmap of two levels, and a bucket of positions for each.

    A set bit of the upper level says that a word of the lower one has bits; find-first-set on
    both gives the least waiting rank. Buckets may hold positions that have gone stale.
    """

    __slots__ = ("buckets", "lower", "upper")

    def __init__(self) -> None:
        self.upper, self.lower, self.buckets = 0, {}, {}

    def load(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Fills an empty queue from positions that are sorted by rank."""
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
        for rank, part in zip(ranks[cuts].tolist(), np.split(positions, cuts[1:]), strict=True):
            self.buckets[rank] = part.tolist()
            self.lower[rank >> 8] = self.lower.get(rank >> 8, 0) | 1 << (rank & 255)
            self.upper |= 1 << (rank >> 8)

    def put(self, ranks: list[int], positions: list[int]) -> None:
        buckets, lower = self.buckets, self.lower
        for rank, position in zip(ranks, positions, strict=True):
            bucket = buckets.get(rank)
            if bucket is not None:
                bucket.append(position)
            else:
                buckets[rank] = [position]
                word = rank >> 8
                lower[word] = lower.get(word, 0) | 1 << (rank & 255)
                self.upper |= 1 << word

    def take(self) -> tuple[int, list[int]] | None:
        """The least waiting rank and its bucket, which leave the queue."""
        if not self.upper:
            return None
        word = (self.upper & -self.upper).bit_length() - 1
        bits = self.lower[word]
        rank = word << 8 | ((bits & -bits).bit_length() - 1)
        bits &= bits - 1
        self.lower[word] = bits
        if not bits:
            self.upper &= self.upper - 1
        return rank, self.buckets.pop(rank)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file's lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TokenTable:
    """The bytes of each id, which is all that decoding takes."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        if len(ids) > BATCH_BYTES:
            return b"".join(self.decode(ids[lo : lo + BATCH_BYTES]) for lo in range(0, len(ids), BATCH_BYTES))
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - n), n)
        return self.bytes[at].tobytes()


@lru_cache(maxsize=2)
def token_table(path: str) -> TokenTable:
    return TokenTable(read_ranks(path))


class Bpe:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = ranks = read_ranks(path)
        self.table = token_table(path)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: Stands after each piece; pairs with nothing.
        self.stop = len(self.table.lengths)
        # Every pair of tokens whose union is a token, sorted, and that union's rank.
        found = [(ranks[t[:i]] * (self.stop + 1) + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        found.sort()
        self.pair_keys, self.pair_ranks = np.array(found, np.int64).reshape(-1, 2).T.copy()
        self.find = regex.compile(pattern).findall
        self.forget()

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each two neighbours' union, or -1."""
        key = left * (self.stop + 1) + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Each piece's ids, as little-endian 32-bit integers.

        All pieces lie in one linked list, a stop after each, and share one queue. Pieces don't
        touch one another, so the least rank of all is always due in its pieces; within a piece
        the pairs of one rank merge from left to right. A merge can make a pair of lower rank
        than its own: that one is then the least and comes next, but pairs of the bucket to its
        right in the same piece must wait for it, so only the first of each piece merges at a
        time and the rest of the bucket goes back.
        """
        if not pieces:
            return []
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        total = int(lens.sum()) + len(pieces)
        stops = np.cumsum(lens + 1) - 1
        ids = np.full(total, self.stop, np.int64)
        inside = np.ones(total, bool)
        inside[stops] = False
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.arange(1, total + 1)
        before = np.arange(-1, total - 1)
        rank_at = np.full(total, -1, np.int64)  # of the pair that begins at each position
        rank_at[:-1] = self.merged(ids[:-1], ids[1:])
        queue = RankQueue()
        waiting = np.flatnonzero(rank_at >= 0)
        waiting = waiting[np.argsort(rank_at[waiting], kind="stable")]
        if len(waiting):
            queue.load(rank_at[waiting], waiting)
        while (least := queue.take()) is not None:
            rank, bucket = least
            pos = np.array(sorted(set(bucket)) if len(bucket) > 1 else bucket)
            pos = pos[rank_at[pos] == rank]  # the others are stale
            if not len(pos):
                continue
            if len(pos) > 1:
                piece = np.searchsorted(stops, pos)
                again = np.zeros(len(pos), bool)
                again[1:] = piece[1:] == piece[:-1]
                if again.any():
                    if rank in self.turning:
                        late = pos[again]
                        pos = pos[~again]
                        queue.put([rank] * len(late), late.tolist())
                    else:
                        touch = np.zeros(len(pos), bool)
                        touch[1:] = after[pos[:-1]] == pos[1:]
                        if touch.any():  # of a run of touching pairs every second one goes
                            begins = np.maximum.accumulate(np.where(touch, 0, np.arange(len(pos))))
                            pos = pos[(np.arange(len(pos)) - begins) % 2 == 0]
            gone = after[pos]
            k = after[gone]
            ids[pos] = rank
            rank_at[gone] = -1
            ids[gone] = -1
            after[pos] = k
            before[k] = pos
            h = before[pos]
            h = h[h >= 0]
            at = np.concatenate((pos, h))
            new = self.merged(ids[at], ids[after[at]])
            rank_at[at] = new
            due = new >= 0
            queue.put(new[due].tolist(), at[due].tolist())
        keep = (ids >= 0) & inside
        flat = ids[keep].astype("<i4").tobytes()
        ends = np.cumsum(keep)[stops] * 4
        lo = 0
        out = []
        for hi in ends.tolist():
            out.append(flat[lo:hi])
            lo = hi
        return out

    @cached_property
    def turning(self) -> frozenset[int]:
        """Ranks whose merge can make a pair of lower rank."""
        left, right = np.divmod(self.pair_keys, self.stop + 1)
        return frozenset(np.concatenate((left[self.pair_ranks < left], right[self.pair_ranks < right])).tolist())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        out: list[bytes] = []
        for t in texts if any(len(t) > BATCH_BYTES for t in texts) else ():
            at, parts = 0, []
            while at < len(t):
                # At such a space a match begins; what follows it is coded as any unit but the first.
                cut = _CUT.search(t, at + BATCH_BYTES)
                end = cut.start() if cut else len(t)
                parts += self._encode([t[at:end]], at > 0)
                at = end + 1
            out.append(b"".join(parts))
        return out or self._encode(texts)

    def _encode(self, texts: list[str], inner: bool = False) -> list[bytes]:
        """inner: the texts come after a space that a match begins with."""
        first, rest = self.rest if inner else self.first, self.rest
        heads, others = set(), set()
        for t in texts:
            units = t.split(" ")
            heads.add(units[0])
            del units[0]
            others.update(units)
        others.difference_update(rest)
        heads.difference_update(first)
        # A unit that is empty, or begins or ends with white space, shows a text that plain splitting
        # would cut where the pattern doesn't. Such units are never remembered, so none goes unseen.
        odd = any(_edgy(u) for u in heads) or any(_edgy(u) for u in others)
        split = self._careful if odd else _plain
        if odd:
            heads, others = set(), set()
            for t in texts:
                units = split(t)
                heads.add(units[0])
                others.update(units[1:])
            others.difference_update(rest)
            heads.difference_update(first)
        if inner:
            others |= heads
            heads = set()
        heads, others = list(heads), list(others)
        find = self.find
        splits = [find(u) for u in heads] + [find(" " + u) for u in others]
        pieces = {p for s in splits for p in s}
        known = self.pieces
        fresh = list(pieces.difference(known))
        known.update(zip(fresh, self.merge([p.encode() for p in fresh]), strict=True))
        got = known.__getitem__
        coded = [got(s[0]) if len(s) == 1 else b"".join(map(got, s)) for s in splits]
        self.first.update(zip(heads, coded[: len(heads)], strict=True))
        rest.update(zip(others, coded[len(heads) :], strict=True))
        out = []
        for t in texts:
            units = split(t)
            head = first[units[0]]
            del units[0]
            out.append(head + b"".join(map(rest.__getitem__, units)))
        self._shrink(known, fresh, 0)
        for cache, new in ((self.first, heads), (rest, others)):
            if odd:
                for u in [u for u in new if _edgy(u)]:
                    del cache[u]
                new = [u for u in new if u in cache]
            self._shrink(cache, new, 1)
        return out

    def _shrink(self, cache: dict[str, bytes], fresh: list[str], kind: int) -> None:
        """Of what has come into a cache only that stays which there is room for."""
        held = self.held[kind]
        for u in fresh:
            size = UNIT_BYTES + len(u) + len(cache[u])
            if len(u) > CACHE_CHARS or held + size > CACHE_BYTES:
                del cache[u]
            else:
                held += size
        self.held[kind] = held

    def forget(self) -> None:
        """Empties the caches."""
        self.held = [0, 0]
        self.first, self.rest, self.pieces = {}, {}, {}

    @staticmethod
    def _careful(text: str) -> list[str]:
        units = text.split(" ")
        return _CUT.split(text) if any(map(_edgy, units)) else units

    def decode(self, ids: np.ndarray) -> bytes:
        return self.table.decode(ids)


@lru_cache(maxsize=2)
def bpe(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def _forget(path: str, pattern: str) -> None:
    bpe(path, pattern).forget()


def _ids_of(coder: Bpe, texts: pa.Array) -> tuple[list[bytes], pa.ListArray]:
    parts = coder.encode([t or "" for t in texts.to_pylist()])
    off = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype(np.int32)
    return parts, pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def bpe_encode(
    df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", keep_cols: list[str] | None = None, decoded_col: str | None = None
) -> DataFrame:
    """Adds ids_col (array<int>): text_col's ids by the rank file at path, each match of pattern by itself.

    With decoded_col, adds the bytes (binary) that the ids decode to as well, in the same pass.
    Keeps keep_cols (default: all columns); columns of the added names are replaced. A null text
    counts as empty and gives an empty array. Repeated rows are encoded each; an empty table
    gives an empty result. A very long text is coded in parts. path must be there on every
    executor.
    """
    added = [ids_col] + ([decoded_col] if decoded_col else [])
    keep = [c for c in (df.columns if keep_cols is None else keep_cols) if c not in added]
    kinds = [T.ArrayType(T.IntegerType(), False), T.BinaryType()]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, k) for c, k in zip(added, kinds, strict=False)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        for b in sized_batches(it, len(keep), BATCH_BYTES):
            parts, ids = _ids_of(coder, b.column(len(keep)))
            more = [pa.array([coder.decode(np.frombuffer(p, np.int32)) for p in parts], pa.binary())] if decoded_col else []
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], ids, *more], schema.names)

    return map_arrow(df.select(*keep, F.col(text_col).alias("_bpe_text")), run, schema, lambda: _forget(path, pattern))


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded", keep_cols: list[str] | None = None) -> DataFrame:
    """Adds bytes_col (binary): the bytes that ids_col's ids stand for in the rank file at path.

    Keeps keep_cols (default: all columns); a column called bytes_col is replaced. Null ids give
    empty bytes; ids outside of the rank file fail the task. An empty table gives an empty result.
    """
    keep = [c for c in (df.columns if keep_cols is None else keep_cols) if c != bytes_col]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(bytes_col, T.BinaryType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(path)
        for b in batches_of(it, 1000):
            col = b.column(len(keep))
            off, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
            out = [table.decode(flat[x:y]) for x, y in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(out, pa.binary())], [*keep, bytes_col])

    return map_arrow(df.select(*keep, F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("_bpe_ids")), run, schema)

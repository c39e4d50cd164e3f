"""Best-fit packing of token pieces into sequences, planned on the histogram of lengths."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from cubewright.llm.common import map_arrow, sized_batches, staged

#: Parts of words of up to so many characters are remembered, in about so many bytes of a Python
#: worker as long as it lives. What one takes beside its characters and ids is PART_BYTES.
CACHE_CHARS, CACHE_BYTES, PART_BYTES = 48, 40 << 20, 190
#: In texts of these Latin-1 characters alone, without "<|", the tokenizer changes nothing but case,
#: and codes the parts that its splitting pattern gives by themselves.
_PLAIN = bytes([*b"\t\n\x0b\x0c\r ", *range(0x21, 0x7F), 0x85, *range(0xA0, 0x100)])
#: The splitting pattern that _part_starts knows.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LOWER = np.array([ord(chr(c).lower()) for c in range(256)], np.uint8)
_NUMBER, _KIND = 2, np.array([0 if chr(c).isspace() else {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3) for c in range(256)], np.uint8)
_PLAIN_SPACE = re.compile(rb"[\t-\r \x85\xa0]")
#: Python's split() takes these for white space, the tokenizers don't.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Texts are coded together up to so many bytes, which bounds the scratch memory.
BATCH_BYTES = 8 << 20
#: Pieces of one length are ranked in groups of about so many.
GROUP_ROWS = 100_000


def _part_starts(data: np.ndarray) -> np.ndarray:
    """Where the parts that _SPLIT gives, and the white space between them, start in lower-cased
    Latin-1 text that ends in white space."""
    kind = _KIND[data]
    cut = np.ones(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    cut |= kind == _NUMBER
    # An apostrophe after another sign belongs to the signs.
    at = np.flatnonzero(data == ord("'"))
    at = at[cut[at]]
    x, y = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
    pair = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
    for some, size in ((at[np.isin(x, list(b"stmd"))], 2), (at[pair], 3)):
        cut[some + 1] = False
        cut[some + size] = True
    return np.flatnonzero(cut)


class WordTokenizer:
    """A tokenizer that drops white space, so that each word between spaces is coded by itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.find = _part_starts if self._splits_as_known(path) else None
        self.parts: dict[bytes, bytes] = {}
        self.held = 0
        special = [(t.content, i) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.mark, self.mark_id = special[0] if special else (None, -1)

    def _code(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _splits_as_known(path: str) -> bool:
        """Whether the file says that lower-cased words are split in the way known here."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        kinds = [n["type"] for n in steps]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        known = kinds == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and spec["model"].get("continuing_subword_prefix") is None
        known = known and [s["type"] for s in split] == ["Split", "ByteLevel"] and split[0]["behavior"] == "Removed" and split[0]["invert"] and not split[1]["use_regex"]
        return known and split[0]["pattern"] == {"Regex": _SPLIT}

    def _code_parts(self, parts: list[bytes]) -> list[bytes]:
        out = list(map(self.parts.get, parts))
        fresh = [i for i, code in enumerate(out) if code is None]
        for lo in range(0, len(fresh), 20_000):
            some = fresh[lo : lo + 20_000]
            for i, code in zip(some, self._code_words([parts[i].decode("latin-1") for i in some]), strict=True):
                out[i] = code
                size = PART_BYTES + len(parts[i]) + len(code)
                if len(parts[i]) <= CACHE_CHARS and self.held + size <= CACHE_BYTES:
                    self.parts[parts[i]] = code
                    self.held += size
        return out

    def _code_latin(self, texts: list[bytes]) -> list[bytes]:
        """Texts of _PLAIN characters, each with a line end after it, by the distinct parts of them all."""
        data = _LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        starts = self.find(data)
        offsets = np.append(starts, len(data)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        ids = pa.array(self._code_parts(parts.dictionary.to_pylist()), pa.binary()).take(parts.indices)
        ends, whole = np.frombuffer(ids.buffers()[1], np.int32), ids.buffers()[2].to_pybytes()
        limits = ends[np.searchsorted(starts, np.cumsum([0, *map(len, texts)]))].tolist()
        return [whole[x:y] for x, y in zip(limits[:-1], limits[1:], strict=True)]

    def _code_long(self, text: bytes) -> bytes:
        """One text in slices of about BATCH_BYTES, cut after white space."""
        out, lo = [], 0
        while lo < len(text):
            space = _PLAIN_SPACE.search(text, lo + BATCH_BYTES)
            hi = space.end() if space else len(text)
            out += self._code_latin([text[lo:hi]])
            lo = hi
        return b"".join(out)

    def _code_plain(self, texts: list[str]) -> list[bytes | None]:
        """Codes texts of which it is known that their parts can be coded by themselves; None for others."""
        out: list[bytes | None] = [None] * len(texts)
        rows, plain = [], []
        for i, t in enumerate(texts if self.find is not None else ()):
            if "<|" in t:
                continue
            try:
                raw = t.encode("latin-1")
            except UnicodeEncodeError:
                continue
            if raw.translate(None, _PLAIN):
                continue
            if len(raw) > BATCH_BYTES:
                out[i] = self._code_long(raw + b"\n")
            else:
                rows.append(i)
                plain.append(raw + b"\n")
        if plain:
            for i, code in zip(rows, self._code_latin(plain), strict=True):
                out[i] = code
        return out

    def _code_words(self, words: list[str]) -> list[bytes]:
        """Many words in one call, with a special token between them, whose id then parts their ids."""
        if self.mark is None:
            return self._code(words)
        plain = [w for w in words if self.mark not in w]
        coded = {}
        for lo in range(0, len(plain), 1000):
            part = plain[lo : lo + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = [-1, *np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            whole = ids.tobytes()
            coded.update((w, whole[4 * x + 4 : 4 * y]) for w, x, y in zip(part, cuts[:-1], cuts[1:], strict=True))
        odd = [w for w in words if w not in coded]
        coded.update(zip(odd, self._code(odd), strict=True))
        return [coded[w] for w in words]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        codes = self._code_plain(texts)
        odd = [c is None and _ODD_SPACE.search(t) is not None for t, c in zip(texts, codes, strict=True)]
        words = list({w for t, c, o in zip(texts, codes, odd, strict=True) if c is None and not o for w in t.split()})
        known = dict(zip(words, self._code_plain(words), strict=True))
        rest = [w for w in words if known[w] is None]
        known.update(zip(rest, self._code_words(rest), strict=True))
        for t, c, o in zip(texts, codes, odd, strict=True):
            if c is None:
                c = self._code([t])[0] if o else b"".join(map(known.__getitem__, t.split()))
            yield c


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(
    df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """Codes each text, adds end_id and cuts what is longer than capacity.

    Returns id_col, piece (int, from 0), start, length, ids_crc32 (long) and, with_ids, ids
    (array<long>). The tokenizer must drop white space. A null text counts as empty: one piece
    that holds end_id. Ids may be null or repeat; each row gives its own pieces.
    """
    fields = [T.StructField("piece", T.IntegerType())] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]
    fields += [T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else []
    schema = T.StructType([df.schema[id_col], *fields])
    tail, width = np.array([end_id], "<u4").tobytes(), capacity * 4

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_tokenizer(tokenizer_path)
        for b in sized_batches(it, 1, BATCH_BYTES):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, code in enumerate(coder.encode([t or "" for t in b.column(1).to_pylist()])):
                code += tail
                for p, lo in enumerate(range(0, len(code), width)):
                    part = code[lo : lo + width]
                    row.append(i)
                    piece.append(p)
                    start.append(lo // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int64))
            cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.list_(pa.int64()))] if with_ids else []), schema.names)

    return map_arrow(df.select(F.col(id_col), F.col(text_col).alias("_pack_text")), run, schema)


# The plan ------------------------------------------------------------------------------------


class _Sums:
    """Which lengths are to be had, and how many pairs of them make each sum."""

    def __init__(self, counts: np.ndarray):
        self.count = counts.copy()
        self.capacity = len(counts) - 1
        there = (counts > 0).astype(np.int64)
        both = np.convolve(there, there)[: self.capacity + 1]
        same = np.zeros(self.capacity + 1, np.int64)
        same[::2] = there[: self.capacity // 2 + 1]
        self.pairs = (both + same) // 2

    def use(self, parts: Counter, times: int) -> None:
        for x, k in parts.items():
            self.count[x] -= k * times
            if not self.count[x]:
                self.count[x] = 1  # it pairs with itself too
                others = np.flatnonzero(self.count[: self.capacity + 1 - x] > 0)
                self.pairs[others + x] -= 1
                self.count[x] = 0

    def free(self, taken: Counter, x: int, more: int = 0) -> bool:
        return self.count[x] - taken[x] - more > 0

    def pair(self, total: int, taken: Counter) -> tuple[int, int] | None:
        if total < 2 or self.pairs[total] <= 0:
            return None
        a = np.arange(total - 1, (total + 1) // 2 - 1, -1)
        for x in a[(self.count[a] > 0) & (self.count[total - a] > 0)].tolist():
            y = total - x
            if self.free(taken, x) and self.free(taken, y, x == y):
                return x, y
        return None

    def exact(self, gap: int, taken: Counter) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap, the largest first."""
        if self.free(taken, gap):
            return (gap,)
        if got := self.pair(gap, taken):
            return got
        if gap < 3:
            return None
        a = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)
        for x in a[(self.count[a] > 0) & (self.pairs[gap - a] > 0)].tolist():
            if self.free(taken, x):
                taken[x] += 1
                got = self.pair(gap - x, taken)
                taken[x] -= 1
                if got:
                    return (x, *got)
        return None


def plan_patterns(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) of sequences that hold counts[n] pieces of each length n up to the capacity.

    The largest length left opens a sequence. Indexes of single, pair and (a single and a pair)
    triple sums are asked for lengths that fill its gap exactly; where there are none the largest
    length that fits goes in and the smaller gap is asked for. A combination is used as often as
    the counts allow, which uses up one of its lengths. Lengths without a combination are packed
    by best fit, largest first. Time and size depend on the capacity only, not on the counts.
    """
    capacity = len(counts) - 1
    sums, out, rest = _Sums(counts), [], np.zeros(capacity + 1, np.int64)
    if counts[capacity]:
        out.append(((capacity,), int(counts[capacity])))
        sums.use(Counter({capacity: 1}), int(counts[capacity]))
    for length in range(capacity - 1, 0, -1):
        while sums.count[length] > 0:
            parts, gap = [length], capacity - length
            taken = Counter(parts)
            while (got := sums.exact(gap, taken)) is None:
                fits = [x for x in np.flatnonzero(sums.count[1 : gap + 1] > 0)[::-1] + 1 if sums.free(taken, x)][:1]
                if not fits:
                    break
                parts.append(int(fits[0]))
                taken[parts[-1]] += 1
                gap -= parts[-1]
            if got is None:
                rest[length] += sums.count[length]
                sums.use(Counter([length]), int(sums.count[length]))
                break
            taken.update(got)
            taken = +taken
            times = min(int(sums.count[x]) // k for x, k in taken.items())
            sums.use(taken, times)
            out.append((tuple(sorted(taken.elements(), reverse=True)), times))
    # Best fit: open sequences by the gap they leave.
    gaps: dict[int, list[list]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        left = int(rest[length])
        while left:
            gap = min((g for g, x in gaps.items() if g >= length and x), default=0)
            if gap:
                parts, times = gaps[gap].pop()
                if times > left:
                    gaps[gap].append([parts, times - left])
                    times = left
                gaps[gap - length].append([(*parts, length), times])
                left -= times
            else:
                k = min(left, capacity // length)
                times = left // k
                gaps[capacity - k * length].append([(length,) * k, times])
                left -= times * k
    return out + [(tuple(parts), times) for x in gaps.values() for parts, times in x]


def _segments(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> np.ndarray:
    """Rows (length, first rank, copies in a sequence, first sequence, first offset), by length and rank."""
    rank, sequence, rows = Counter(), 0, []
    for parts, times in patterns:
        at = 0
        for length, k in sorted(Counter(parts).items(), reverse=True):
            rows.append((length, rank[length], k, sequence, at))
            rank[length] += k * times
            at += k * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_lengths(pieces: DataFrame, length_col: str = "length", order_cols: tuple[str, ...] = ("doc_id", "piece"), capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset (long) so that each sequence holds at most capacity, in few sequences.

    pieces must give the same rows each time it is read (a staged table). Lengths are from 1 to
    capacity; others fail. Only the histogram of lengths, capacity rows at most, goes to the
    driver, and a plan of a few rows for each length goes back. A piece finds its place by its
    rank among those of its length, which is counted in salted groups: no length, however
    frequent, meets in one task. Columns called sequence_id or offset are replaced.
    """
    spark = pieces.sparkSession
    hist = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}
    if any(x is None or not 1 <= x <= capacity for x in hist):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    counts = np.zeros(capacity + 1, np.int64)
    for x, k in hist.items():
        counts[x] = k
    plan = spark.sparkContext.broadcast(_segments(plan_patterns(counts), capacity))
    n_groups = max(64, int(counts.sum()) // GROUP_ROWS)
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    salted = pieces.select(*keep, F.col(length_col).cast("long").alias("_len"), F.pmod(F.xxhash64(*order_cols), F.lit(n_groups)).alias("_salt"))
    sizes = salted.groupBy("_len", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_len").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_len", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_len", "_salt").orderBy(*order_cols)
    ranked = salted.withColumn("_own", F.row_number().over(own)).join(bases, ["_len", "_salt"])
    ranked = ranked.select(*keep, "_len", (F.col("_own") - 1 + F.col("_base")).alias("_rank"))
    schema = T.StructType([*[ranked.schema[c] for c in keep], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = plan.value
        wide = int(seg[:, 1].max(initial=0)) + 2**40
        keys = seg[:, 0] * wide + seg[:, 1]
        for b in it:
            n, r = b.column(len(keep)).to_numpy(), b.column(len(keep) + 1).to_numpy()
            s = seg[np.searchsorted(keys, n * wide + r, "right") - 1]
            t = r - s[:, 1]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(s[:, 3] + t // s[:, 2]), pa.array(s[:, 4] + t % s[:, 2] * n)], schema.names)

    return map_arrow(ranked, place, schema)


def pack_documents(
    df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """Tokenizes and packs: token_pieces, staged once, then pack_lengths. See both."""
    pieces = staged(token_pieces(df, tokenizer_path, id_col, text_col, capacity, end_id, with_ids), "pieces")
    return pack_lengths(pieces, "length", (id_col, "piece"), capacity)

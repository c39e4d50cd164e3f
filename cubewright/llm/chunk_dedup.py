"""Deduplication of repeated passages by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cubewright.llm.common import Words, batches_of, groups, map_arrow, mix, powers, staged

#: The gear hash's 32-bit value at a byte depends on the last 32 bytes, and the bits that are
#: tested on the last WINDOW only.
WINDOW = 24
#: A cut may come at a word's start where CUT_BITS bits are 0, after at least MIN_WORDS words of
#: the chunk and at the latest after MAX_WORDS.
CUT_BITS, MIN_WORDS, MAX_WORDS = 2, 4, 32
#: Repeated chunks go where a run of them holds at least so many words.
MIN_RUN_WORDS = 12
#: Bits of the filter of repeated digests: of this size at any scale, it only spares work.
FILTER_BITS = 1 << 26

#: The gear table: a random 32-bit number for each byte.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i - 1] + GEAR[data[i]] modulo 2^32, by doubling the number of bytes summed."""
    h, width = GEAR[data], 1
    while width < 32:
        more = h.copy()
        more[width:] += h[:-width] << np.uint32(width)
        h, width = more, 2 * width
    return h


def chunk_starts(w: Words) -> np.ndarray:
    """Whether each word of a group begins a chunk."""
    n = len(w.start)
    begins = np.zeros(n, bool)
    if not n:
        return begins
    h = gear_hash(w.data)
    at = w.start
    may = np.zeros(n, bool)
    inner = at - w.offsets[w.doc] >= WINDOW  # no byte of another text in the window
    may[inner] = (h[at[inner] - 1] >> np.uint32(WINDOW - CUT_BITS)) & np.uint32((1 << CUT_BITS) - 1) == 0
    first = np.ones(n, bool)
    first[1:] = w.doc[1:] != w.doc[:-1]
    begins[first] = True
    firsts = np.flatnonzero(first)
    ends = np.append(firsts[1:], n)
    cand = np.flatnonzero(may)
    lo = np.searchsorted(cand, firsts)
    hi = np.searchsorted(cand, ends)
    cand = cand.tolist()
    cuts: list[int] = []
    for a, e, x, y in zip(firsts.tolist(), ends.tolist(), lo.tolist(), hi.tolist(), strict=True):
        last = a
        for c in (*cand[x:y], e):
            while c - last > MAX_WORDS:
                last += MAX_WORDS
                cuts.append(last)
            if c < e and c - last >= MIN_WORDS:
                last = c
                cuts.append(c)
    begins[cuts] = True
    return begins


class Chunks:
    """The chunks of a group's texts: first word, text, position in the text, words and two digests."""

    def __init__(self, w: Words):
        begins = chunk_starts(w)
        self.first = np.flatnonzero(begins)
        self.doc = w.doc[self.first]
        self.words = np.diff(np.append(self.first, len(begins)))
        head = np.searchsorted(self.doc, self.doc, "left")
        self.position = np.arange(len(self.first)) - head
        pw, inv = powers(len(begins) + 1)
        end = self.first + self.words
        self.digests = []
        for salt in (0, 0x5851F42D4C957F2D):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(w.hash ^ np.uint64(salt)) * pw[: len(begins)])))
            self.digests.append(mix((sums[end] - sums[self.first]) * inv[self.first] + self.words.astype(np.uint64)))
        self.start = w.start[self.first]


def _rows(docs: DataFrame, bitmap=None) -> DataFrame:
    """(d1, d2, id, v, position) of each chunk; with a bitmap, of those whose digest's bit is set."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else bitmap.value
        for b in batches_of(it):
            ids, v = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, w in groups(b.column(2)):
                c = Chunks(w)
                d1, d2 = c.digests
                keep = slice(None)
                if bits is not None:
                    h = (d1 >> np.uint64(64 - 26)).astype(np.int64)
                    keep = np.flatnonzero((bits[h >> 3] >> (h & 7).astype(np.uint8)) & 1)
                doc = lo + c.doc[keep]
                cols = [d1[keep].view(np.int64), d2[keep].view(np.int64), ids[doc], v[doc], c.position[keep].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], ["d1", "d2", "id", "v", "position"])

    return map_arrow(docs, run, "d1 long, d2 long, id long, v long, position int")


def _bitmap(repeated: DataFrame):
    """The repeated digests' bits: FILTER_BITS / 8 bytes, whatever their number."""
    h = F.expr("shiftrightunsigned(d1, 38)")
    words = repeated.select(F.floor(h / 32).cast("int").alias("w"), F.expr("shiftleft(1L, cast(shiftrightunsigned(d1, 38) % 32 as int))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS // 32, "<u4")
    bits[got["w"].to_numpy()] = got["b"].to_numpy().astype(np.uint32)
    return repeated.sparkSession.sparkContext.broadcast(bits.view(np.uint8))


FIELDS = [T.StructField(n, T.LongType()) for n in ("n_chunks", "n_dropped", "dropped_words")] + [T.StructField("first_ids", T.ArrayType(T.LongType()))]


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    """Drops passages that an earlier document, or an earlier place of the same one, holds too.

    Texts are cut into chunks where a gear rolling hash of the bytes before a word has certain
    bits 0, so that a passage is cut alike wherever it stands, but for its ends. A chunk's
    digest is over its words. A chunk is repeated unless it is the one of its digest with the
    smallest (id, text's hash, position); runs of repeated chunks of at least min_run_words words
    go, the rest stays as it is.

    Returns df's columns with text_col replaced by what stays, and n_chunks, n_dropped,
    dropped_words (long) and first_ids (array<long>: the ids that hold the dropped chunks first,
    sorted). Columns of these names are replaced. A null text has no chunks and stays null; a
    null id takes no part: its text stays and drops nothing. Rows that repeat an id and text are
    one. An empty table gives an empty result.
    """
    version = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    docs = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), version.alias("v"), F.col(text_col).alias("t"))
    place = F.struct("id", "v", "position")
    by_digest = _rows(docs).groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = staged(by_digest.where("first <> last").select("d1", "d2", "first"), "repeated-chunks")
    again = _rows(docs, _bitmap(repeated)).join(repeated, ["d1", "d2"]).where(F.struct("id", "v", "position") != F.col("first"))
    marks = again.groupBy("id", "v").agg(F.collect_set(F.struct("position", F.col("first.id").alias("first"))).alias("marks"))
    own = {f.name for f in FIELDS}
    names = [c for c in df.columns if c not in own]
    rows = df.select(F.struct(*names).alias("row"), F.col(id_col).cast("long").alias("rid"), version.alias("rv"))
    rows = rows.join(marks, (F.col("rid") == F.col("id")) & (F.col("rv") == F.col("v")), "left")
    rows = rows.select("row.*", F.transform("marks", lambda m: m["position"]).alias("_at"), F.transform("marks", lambda m: m["first"]).alias("_first"))
    at = names.index(text_col)
    schema = T.StructType([df.schema[c] for c in names] + FIELDS)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it):
            texts, marked, firsts = b.column(at).to_pylist(), b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist()
            n_chunks, n_dropped, words = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            ids = [[] for _ in range(b.num_rows)]
            for lo, w in groups(b.column(at)):
                c = Chunks(w)
                k = len(w.offsets) - 1
                limits = np.searchsorted(c.doc, np.arange(k + 1))
                n_chunks[lo : lo + k] = np.diff(limits)
                for i in range(k):
                    if not marked[lo + i]:
                        continue
                    x, y = limits[i], limits[i + 1]
                    rep = np.zeros(y - x, bool)
                    where = np.array(marked[lo + i])
                    rep[where] = True
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], rep, [0]))))
                    size, raw = c.words[x:y], bytes(w.data[w.offsets[i] : w.offsets[i + 1]])
                    starts = np.append(c.start[x:y] - w.offsets[i], len(raw))
                    parts, last, gone = [], 0, np.zeros(y - x, bool)
                    for p, q in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        if size[p:q].sum() >= min_run_words:
                            parts.append(raw[last : starts[p]])
                            last = starts[q]
                            gone[p:q] = True
                    if gone.any():
                        texts[lo + i] = (b"".join(parts) + raw[last:]).decode()
                        n_dropped[lo + i], words[lo + i] = gone.sum(), size[gone].sum()
                        ids[lo + i] = sorted({f for p, f in zip(where.tolist(), firsts[lo + i], strict=True) if gone[p]})
            cols = [b.column(j) for j in range(len(names))]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_chunks), pa.array(n_dropped), pa.array(words), pa.array(ids, pa.list_(pa.int64()))], schema.names)

    return map_arrow(rows, run, schema)

"""Shared pieces: staged tables, connected components, vectorised word hashing."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes that separate words and that line keys are stripped of.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: Texts are hashed in groups of about so many bytes, which bounds the scratch memory.
GROUP_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a
    local one and any other an error, since executors wouldn't see one another's files."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = os.path.join(tempfile.gettempdir(), "cubewright-shared")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Paths of the staged tables that are still there, in order.
_STAGED: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and rereads it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/{app}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if path in _STAGED:
            _STAGED.remove(path)


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more, and the shuffle files of plans that are gone."""
    for t in tables:
        _delete(t.sparkSession, [t.staged_path])
    if tables:
        release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def staged_paths() -> list[str]:
    return list(_STAGED)


def drop_staged(spark: SparkSession, keep: tuple[str, ...] | list[str] = ()) -> None:
    """Deletes staged tables, but those at the paths to keep; call it once what reads them is written."""
    _delete(spark, [p for p in _STAGED if p not in keep])


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run: Callable, schema, at_end: Callable[[], None] | None = None) -> DataFrame:
    """df.mapInArrow(run, schema), after each task of which its Python worker, which others use
    next, calls at_end and gives memory back."""

    def tidy(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(it)
        finally:
            if at_end is not None:
                at_end()
            _give_back()

    return df.mapInArrow(tidy, schema)


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """edges(a, b) -> (node, component): the smallest node reachable; only nodes with an edge.

    Alternates large-star and small-star rounds, each a keyed aggregate and an equi-join, until
    the edge set stands still. Nothing but a count and a checksum reaches the driver.
    """
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    old, last = e, mark(e)
    while last[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The joins' key isn't the aggregates' own, so that each side is dealt out for the join alone
        # and Spark can split the rows of a centre.
        key = F.bitwise_not("u").alias("k")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(key, F.least("u", "m").alias("m"))
        e = both.where("v > u").select("v", key).join(least, "k").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m")).select(key, "m")
        e = e.select("u", "v", key).join(least, "k")
        e = e.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x"))
        before, e = old, staged(e.select("x.u", "x.v").where("u <> v").distinct(), name)
        old = e
        unstage(before)
        now = mark(e)
        if now == last:
            break
        last = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


# Word hashing on raw bytes -------------------------------------------------------------------

_MULT = 0x9E3779B97F4A7C15 | 1
_POW: list[np.ndarray] = []
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, GROUP_BYTES + 1)
        out = []
        for base in (_MULT, pow(_MULT, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if size > 4 * GROUP_BYTES:
            return out[0], out[1]
        _POW[:] = out
    return _POW[0][:n], _POW[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a group of texts, as arrays over all of them.

    data: bytes; offsets: text limits; start, end: byte limits of each word; doc: its text;
    hash: its 64-bit hash.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n = len(data)
        if lower:
            data = _LOWER[data]
        self.data, self.offsets = data, offsets
        word = ~_SPACE[data]
        fresh = np.zeros(n + 1, bool)
        fresh[offsets] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = word[:-1]
        self.word = word
        self.start = np.flatnonzero(word & (~before | fresh[:n]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = word[1:]
        self.end = np.flatnonzero(word & (~after | fresh[1:])) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        pw, self.inv = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[:n], out=self.sums[1:])
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(np.uint64))

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.offsets) - 1)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, text, hash) of every run of size words within one text."""
        n = len(self.doc) - size + 1
        if n <= 0:
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(0, np.uint64)
        first = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        h = self.hash[first]
        for j in range(1, size):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + self.hash[first + j])
        return first, self.doc[first], h


def groups(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, Words]]:
    """(index of the first text, Words) for groups of texts of about GROUP_BYTES; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + GROUP_BYTES, "right")) - 1)
        yield lo, Words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lower)
        lo = hi


def batches_of(it: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for b in it:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def sized_batches(it: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches with about size bytes of text in a string column, at least one row each."""
    for b in it:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi

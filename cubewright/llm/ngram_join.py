"""Jaccard self-join of shingle sets through PartEnum signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cubewright.llm.common import Words, batches_of, connected_components, groups, map_arrow, mix, release, staged, unstage

#: Size bands grow by this factor, in tenths.
BAND_TENTHS = 15
#: A first-level part has so many second-level parts, of which each signature takes all but one.
PARTS = 3
#: Star rounds compare a bucket's members with one centre; the centre is the least in one of so
#: many orders, which the signature picks.
ORDERS = 2
#: So many of a document's signatures go along with each of its rows when components face each other.
LOW_SIGS = 8
#: The size bands are dealt into so many slices of about as many signatures. Buckets never span
#: bands, so one slice after the other is shuffled, and its files go before the next.
SLICES = 3
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MASK = 2**64 - 1


def bands(threshold_pct: int, up_to: int) -> list[tuple[int, int, int]]:
    """(least size, largest size, k) of each band, for sets of up to up_to elements.

    A band is home to sizes [least, largest]; sets a little larger, up to largest / threshold,
    visit it, so that every pair that can reach the threshold meets in the smaller set's band.
    k is the largest symmetric difference of such a pair: from 100 I >= t U follows
    (100 + t) D <= (100 - t) S for difference D and sizes' sum S.
    """
    out, least, t = [], 1, threshold_pct
    while least <= up_to:
        largest = max(least, least * BAND_TENTHS // 10)
        out.append((least, largest, (100 - t) * (largest + largest * 100 // t) // (100 + t)))
        least = largest + 1
    return out


class Shingles:
    """The distinct shingles of a group's texts: values, sorted within each text; limits of each text."""

    def __init__(self, w: Words, size: int):
        n = len(w.offsets) - 1
        _, doc, h = w.windows(size)
        short = np.flatnonzero((c := w.word_counts()) < size)
        short = short[c[short] > 0]
        if len(short):  # the whole sequence is the one shingle
            first = np.searchsorted(w.doc, short)
            whole = mix(w.hash[first])
            for j in range(1, size):
                more = c[short] > j
                whole[more] = mix(whole[more] * np.uint64(0xC2B2AE3D27D4EB4F) + w.hash[first[more] + j])
            doc, h = np.concatenate((doc, short)), np.concatenate((h, whole))
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
        edges = np.searchsorted(doc, np.arange(n + 1)).tolist()
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            h[lo:hi].sort()
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.values, self.limits = h[keep], np.searchsorted(doc[keep], np.arange(n + 1))


def set_digest(values: np.ndarray) -> tuple[int, int]:
    a = mix(values + _GOLD).sum(dtype=np.uint64)
    b = mix(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def first_parts(k: int) -> tuple[int, int]:
    """Parts of the first level of a band with difference k, and how many of them are spare."""
    need = k // 2 + 1
    spare = 0 if need < 4 else 2 + need // 16
    return need + spare, spare


def signatures(values: np.ndarray, band_list: list[tuple[int, int, int]], threshold_pct: int, only: frozenset[int] | None = None) -> np.ndarray:
    """The PartEnum signatures of one set (sorted, distinct 64-bit values), in all bands or some.

    The domain is cut into parts, each of PARTS smaller ones. A pair with a difference of at most
    k differs in at most one element, and so in one smaller part, in all but k // 2 parts. Each
    signature hashes the elements in all but one smaller part of a part. Where those are empty
    the part's elements lie in the one left out, and signatures hash them, and them without each
    one element, of which two sets that differ by one element share one.

    Signatures that hash fewer than two elements that way are shared by sets that have little in
    common. So there are `spare` more parts than k needs, and every pair agrees in `spare` + 1 parts:
    a set in which at most half as many as `spare` parts can give such signatures leaves them out,
    and has, whatever its partner leaves out, another part that agrees.
    Bands whose k is 0 ask for equal sets, which the digest finds; they have no signatures.
    """
    n, out = len(values), []
    for b, (least, largest, k) in enumerate(band_list):
        if n < least:
            break
        if k == 0 or 100 * largest < threshold_pct * n or (only is not None and b not in only):
            continue
        n1, spare = first_parts(k)
        edges = (np.arange(1, n1 * PARTS, dtype=np.float64) * (2.0**64 / (n1 * PARTS))).astype(np.uint64)
        at = np.concatenate(([0], np.searchsorted(values, edges), [n]))
        hashed = mix(values + np.uint64((b + 1) * int(_GOLD) & _MASK))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashed)))
        raw = np.diff(sums[at]).reshape(n1, PARTS)
        count = np.diff(at).reshape(n1, PARTS)
        own = mix(raw + np.arange(1, n1 * PARTS + 1, dtype=np.uint64).reshape(n1, PARTS) * _GOLD)
        sig = mix(own.sum(axis=1, dtype=np.uint64)[:, None] - own + np.uint64(7 * b + 1))
        empty = count.sum(axis=1)[:, None] == count
        out.append(sig[~empty])
        if empty.any():
            i, j = np.nonzero(empty)
            small = np.unique(i[count[i, j] <= 2])
            all_of = 2 * len(small) > spare
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                c = int(count[x, y])
                if c <= 1 and not all_of:
                    continue
                key = np.uint64((int(raw[x, y]) + ((b * n1 + x + 1) * PARTS + y) * 0xC2B2AE3D27D4EB4F) & _MASK)
                lo = at[x * PARTS + y]
                less = key - hashed[lo : lo + c]
                out.append(mix(np.append(less if c > 2 or all_of else less[:0], key)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def band_slices(sets: DataFrame, band_list: list[tuple[int, int, int]], pct: int) -> list[frozenset[int]]:
    """The bands' numbers in SLICES groups with about as many signatures each; one row goes to the driver."""
    n = F.col("n_shingles")
    held = [F.count_if((n >= least) & (100 * largest >= pct * n)) for least, largest, _ in band_list]
    counts = sets.agg(*held).first() if band_list else ()
    work = {b: c * first_parts(k)[0] * PARTS for b, (c, (_, _, k)) in enumerate(zip(counts, band_list, strict=True)) if k}
    out, load = [set() for _ in range(SLICES)], [0] * SLICES
    for b in sorted(work, key=lambda b: (-work[b], b)):
        i = load.index(min(load))
        out[i].add(b)
        load[i] += work[b]
    return [frozenset(x) for x in out if x]


def _signature_rows(it: Iterator[pa.RecordBatch], size: int, band_list: list, pct: int, only: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """(key, id, sig, centre) of the signatures in some bands, combined within each batch.

    Of equal sets in one batch only the first gives signatures. Where several sets of a batch have
    a signature, one of them is their centre and goes on under the signature's key to meet other
    batches, with sig set; the others keep it as their centre and have a key of their own. So a
    signature, however frequent, has no more rows under its key than there are batches.
    """
    for b in batches_of(it):
        ids = b.column(0).to_numpy(zero_copy_only=False)
        seen, sig, row = set(), [], []
        for lo, w in groups(b.column(1), lower=True):
            s = Shingles(w, size)
            for i in range(len(s.limits) - 1):
                v = s.values[s.limits[i] : s.limits[i + 1]]
                if not len(v) or (key := set_digest(v)) in seen:
                    continue
                seen.add(key)
                got = signatures(v, band_list, pct, only)
                sig.append(got)
                row.append(np.full(len(got), ids[lo + i]))
        if not sig:
            continue
        sig, row = np.concatenate(sig), np.concatenate(row).astype(np.int64)
        order = mix(row.view(np.uint64) + (sig % np.uint64(ORDERS)) * _GOLD)
        at = np.lexsort((order, sig))
        sig, row = sig[at], row[at]
        first = np.ones(len(sig), bool)
        first[1:] = sig[1:] != sig[:-1]
        starts = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        centre = row[starts][group]
        shared = np.diff(np.append(starts, len(sig)))[group] > 1
        key = np.where(first, sig, mix(sig + row.view(np.uint64) * _GOLD))
        back = np.empty(len(at), np.int64)  # a document's rows stay together, which packs better
        back[at] = np.arange(len(at))
        key, row, sig, centre, shared, first = (x[back] for x in (key, row, sig, centre, shared, first))
        cols = [pa.array(key.view(np.int64)), pa.array(row), pa.array(sig.view(np.int64), mask=~shared), pa.array(centre, mask=first)]
        yield pa.RecordBatch.from_arrays(cols, ["key", "id", "sig", "centre"])


def _bucket_rows(rows: DataFrame) -> DataFrame:
    """(sig, id, centre) of the buckets with two members or more, from (key, id, sig, centre)."""
    by_key = Window.partitionBy("key")
    order = F.xxhash64("id", F.pmod("key", F.lit(ORDERS)))
    held = rows.select("*", F.struct(order.alias("o"), F.col("id").alias("i")).alias("x"))
    held = held.select("key", "id", "sig", F.coalesce("centre", F.min("x").over(by_key)["i"]).alias("centre"), F.count("*").over(by_key).alias("n"))
    return held.where("n > 1 or sig is not null").select(F.coalesce("sig", "key").alias("sig"), "id", "centre")


#: (least size, longs) of the parity sketch: a set's elements flip its bits, so two sketches, the
#: longer one folded by XOR, differ in no more bits than their sets in elements. So many bits that
#: sets of that size which have little in common differ in more than links allow.
SKETCH_LONGS = ((0, 4), (512, 16), (2048, 64))


def sketches(s: Shingles) -> pa.ListArray:
    """The parity sketch of each of the texts, as longs."""
    sizes = np.diff(s.limits)
    longs = np.array([x for _, x in SKETCH_LONGS])[np.searchsorted([x for x, _ in SKETCH_LONGS], sizes, "right") - 1]
    offsets = np.concatenate(([0], np.cumsum(longs)))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = (mix(s.values) >> np.uint64(40)).astype(np.int64) & (64 * longs - 1)[doc]
    bits = np.bincount(64 * offsets[doc] + at, minlength=64 * int(offsets[-1])) & 1
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.packbits(bits.astype(np.uint8)).view(np.int64)))


def wide_sketch(values: np.ndarray) -> bytes:
    """A parity sketch of at least two bits an element, a power of two of them; halves fold by XOR."""
    bits = 256
    while bits < 2 * len(values):
        bits *= 2
    at = (mix(values + _GOLD) >> np.uint64(20)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """docs(id, text) -> (id, n_shingles, d1, d2: a 128-bit digest, sketch)."""
    names = ["id", "n_shingles", "d1", "d2"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it):
            n, d, sketch = [], [], []
            for _, w in groups(b.column(1), lower=True):
                s = Shingles(w, size)
                n.append(np.diff(s.limits))
                d += [set_digest(s.values[lo:hi]) for lo, hi in zip(s.limits[:-1], s.limits[1:], strict=True)]
                sketch.append(sketches(s))
            cols = [np.concatenate(n), *np.array(d, np.int64).reshape(-1, 2).T]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(x), pa.int64()) for x in cols), pa.concat_arrays(sketch)], [*names, "sketch"])

    return map_arrow(docs, run, T.StructType([*[T.StructField(n, T.LongType()) for n in names], T.StructField("sketch", T.ArrayType(T.LongType()))]))


#: Bits of the filter of wanted ids: it is of this size at any scale, and only spares work.
FILTER_BITS = 1 << 25


def _of_wanted(docs: DataFrame, wanted: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run over batches of docs(id, text) of the wanted ids and, by chance, few others.

    A bitmap of hashed ids, of fixed size, goes to the tasks that read the texts, so that neither
    texts nor the sets of other documents are shuffled. If the ids fill it, it lets more pass.
    """
    spark = docs.sparkSession
    hashed = wanted.select(F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("h"))
    words = hashed.groupBy((F.col("h") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("bits"))
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    got = words.toArrow()
    bitmap[got["w"].to_numpy()] = got["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(bitmap)
    tested = docs.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("h"))

    def those(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in it:
            h = b.column(2).to_numpy()
            yield b.filter(pa.array((bits[h >> 6] >> (h & 63)) & 1 == 1)).select(["id", "text"])

    return map_arrow(tested, lambda it: run(those(it)), schema)


def shingle_values(docs: DataFrame, wanted: DataFrame, size: int, of_set: Callable[[np.ndarray], bytes] = np.ndarray.tobytes) -> DataFrame:
    """(id, n_shingles, shingles: what of_set makes of a set's sorted 64-bit values) of the wanted
    ids' sets that aren't empty and, by chance, few others."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it):
            ids = b.column(0).to_pylist()
            for lo, w in groups(b.column(1), lower=True):
                s = Shingles(w, size)
                parts = [s.values[x:y] for x, y in zip(s.limits[:-1], s.limits[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo : lo + len(parts)], pa.int64()), pa.array(np.diff(s.limits)), pa.array([of_set(p) for p in parts], pa.binary())], ["id", "n_shingles", "shingles"]
                )

    return _of_wanted(docs, wanted, run, "id long, n_shingles long, shingles binary").where("n_shingles > 0")


def _may_link(one: str, two: str, pct: int) -> Column:
    """Whether sizes and sketches of two sets, in columns with these endings, let them link."""
    na, nb = F.col(f"n{one}"), F.col(f"n{two}")
    m = F.least(F.size(f"sketch{one}"), F.size(f"sketch{two}"))

    def folded(name: str) -> Column:
        c = F.col(name)

        def place(i: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(c) / m).cast("int") - 1), F.lit(0).cast("long"), lambda x, j: x.bitwiseXOR(F.get(c, i + j * m)))

        return F.when(F.size(c) == m, c).otherwise(F.transform(F.sequence(F.lit(0), m - 1), place))

    differ = F.aggregate(F.zip_with(folded(f"sketch{one}"), folded(f"sketch{two}"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * pct) & (differ * (100 + pct) <= (na + nb) * (100 - pct))


def _widely_sketched(pairs: DataFrame, wide: DataFrame, pct: int) -> DataFrame:
    """Of pairs(a, b), those whose wide sketches let them link."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keep = []
            for x, y, both in zip(b.column("wa"), b.column("wb"), b.column("n").to_pylist(), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                if len(x) < len(y):
                    x, y = y, x
                while len(x) > len(y):
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                keep.append(int(np.bitwise_count(x ^ y).sum()) * (100 + pct) <= both * (100 - pct))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = wide.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("shingles").alias("wa"))
    two = wide.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("shingles").alias("wb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "wa", "wb")
    return map_arrow(both, run, "a long, b long").distinct()


def _sketched(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Of pairs(a, b), those whose sizes and sketches let them link."""

    def side(x: str) -> DataFrame:
        return sets.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").where(_may_link("_a", "_b", pct)).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Of pairs(a, b), those with 100 * intersection >= pct * union."""
    schema = "a long, b long"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(100 * both >= pct * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("shingles").alias("sb"))
    near = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * pct)
    return map_arrow(pairs.join(one, "a").join(two, "b").where(near).select("a", "b", "sa", "sb"), run, schema)


def ngram_jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, threshold_pct: int = 80
) -> DataFrame:
    """One row for each row of df: id_col, n_shingles and component_id (long).

    A text's set holds its distinct runs of shingle_words words (A-Z lower-cased, words cut at
    ASCII white space), or its whole sequence of words if it has fewer. Two rows link when
    100 * intersection >= threshold_pct * union; component_id is the smallest id reachable by
    links, the row's own included.

    Equal sets are found by digest and one of them stands for all; as long as the filter of their
    ids isn't full, only that one gives signatures. By PartEnum signatures every pair at the
    threshold meets in a bucket. Its members first face one centre; what that links is one
    component. Only pairs of a bucket that lie in different components then face each other, so
    that a group of near copies costs a few pairs a member. Pairs count after an exact comparison
    of their sets.

    A null or wordless text has no shingles and links with nothing. Rows with a null id come
    back with a null component and link nothing. Rows that repeat an id count as one document
    with the sets of each. Other columns play no part, whatever their names. An empty table gives
    an empty result. df must give the same rows each time it is read.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = staged(shingle_sets(docs, shingle_words), "sets")
    most = sets.agg(F.max("n_shingles")).first()[0] or 0
    some = sets.where("n_shingles > 0 and id is not null")
    # Of rows that repeat an id each set may link; sketches of all are tried.
    reps = staged(some.groupBy("d1", "d2").agg(F.min("id").alias("rep")), "representatives")
    rep_of = staged(some.join(reps, ["d1", "d2"]).select("id", "rep").distinct(), "rep-of")
    band_list = bands(threshold_pct, most)
    known = docs.where("id is not null and text is not null")
    rep_ids = reps.select(F.col("rep").alias("id"))
    slices = []
    for only in band_slices(some.join(rep_ids.distinct(), "id", "left_semi"), band_list, threshold_pct):
        rows = _of_wanted(known, rep_ids, lambda it, only=only: _signature_rows(it, shingle_words, band_list, threshold_pct, only), "key long, id long, sig long, centre long")
        slices.append(staged(_bucket_rows(rows), "buckets"))
        del rows
        release(spark)
    unstage(reps)
    buckets = reduce(DataFrame.union, slices) if slices else spark.createDataFrame([], "sig long, id long, centre long")
    stars = buckets.where("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    stars = staged(_sketched(stars, some, threshold_pct).distinct(), "stars")

    def check(pairs: DataFrame, name: str) -> DataFrame:
        """Those of pairs that link: wide sketches first, then the sets of what they leave."""

        def values(of: DataFrame, *how: Callable) -> DataFrame:
            return staged(shingle_values(known, of.select(F.explode(F.array("a", "b")).alias("id")), shingle_words, *how), f"{name}-values")

        wide = values(pairs, wide_sketch)
        near = staged(_widely_sketched(pairs, wide, threshold_pct), f"{name}-near")
        unstage(wide)
        whole = values(near)
        out = staged(_verified(near, whole, threshold_pct), name)
        unstage(near, whole)
        return out

    linked = check(stars, "links")
    same = rep_of.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    comp = staged(connected_components(same.union(linked)), "components")
    unstage(linked)
    # Buckets that still hold several components: their pairs across components. Two aggregates of
    # a bucket's labels tell which, and a join brings those back, so that none meets in one task.
    label = staged(buckets.join(comp, buckets["id"] == comp["node"], "left").select("sig", "id", F.coalesce("component", "id").alias("c")), "labels")
    unstage(*slices)
    mixed = label.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("sig")
    # Each row carries the least of its document's open signatures: a pair is left to the bucket of
    # a smaller signature where both have one among these, so that it is seldom made twice.
    mine = label.join(mixed, "sig").groupBy("id", "c").agg(F.sort_array(F.collect_list("sig")).alias("sigs"))
    sketch = some.select(F.col("id").alias("_s"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("sketch_a"))
    mine = mine.join(sketch, mine["id"] == sketch["_s"]).withColumn("low_a", F.slice("sigs", 1, LOW_SIGS))
    wide = ["n_a", "sketch_a", "low_a"]
    open_ = staged(mine.select(F.explode("sigs").alias("sig"), "c", F.col("id").alias("a"), *wide), "open")
    unstage(label)
    other = open_.select("sig", F.col("c").alias("cb"), F.col("a").alias("b"), *[F.col(c).alias(f"{c[:-1]}b") for c in wide])
    apart = (F.col("one.sig") == F.col("two.sig")) & (F.col("a") < F.col("b")) & (F.col("c") != F.col("cb")) & _may_link("_a", "_b", threshold_pct)
    apart = apart & (F.coalesce(F.array_min(F.array_intersect("low_a", "low_b")), F.col("one.sig")) >= F.col("one.sig"))
    cross = open_.alias("one").join(other.alias("two"), apart).select("a", "b").distinct()
    cross = staged(cross.join(stars, ["a", "b"], "left_anti"), "cross")
    unstage(open_, stars)
    late = check(cross, "late-links")
    # Links found late join components.
    ends = late.select("a", "b")
    for side in ("a", "b"):
        ends = ends.join(comp.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left").withColumn(side, F.coalesce(f"c{side}", side)).select("a", "b")
    merged = connected_components(ends, "cc-late").select(F.col("node").alias("_c"), F.col("component").alias("_to"))
    unstage(late, cross)
    final = comp.union(rep_of.join(comp, rep_of["id"] == comp["node"], "left_anti").select("id", "id"))
    final = final.join(merged, F.col("component") == F.col("_c"), "left").select(F.col("node").alias("_n"), F.coalesce("_to", "component").alias("_component"))
    out = sets.select("id", "n_shingles").join(final.distinct(), F.col("id") == F.col("_n"), "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("_component", "id").alias("component_id"))

"""Cosine self-join of vectors by epsilon grid order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from cubewright.llm.common import connected_components, map_arrow, staged, unstage

#: Principal dimensions of the grid and of the blocks' boxes; of these so many make the join key.
GRID_DIMS, KEY_DIMS = 6, 3
#: Vectors in a block of the sequence, and in a leaf of the recursion.
BLOCK, LEAF = 4096, 512


def _principal(vectors: DataFrame, dim: int) -> np.ndarray:
    """The leading principal directions (dim, GRID_DIMS) of all unit vectors, from sums of products.

    Each partition gives dim * (dim + 3) / 2 sums, which are added up by key; that many go to the driver.
    """
    upper = np.triu_indices(dim)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, product = np.zeros(dim), 0, np.zeros((dim, dim))
        for b in it:
            u = _unit(b.column(0), dim)
            total += u.sum(axis=0)
            product += u.T @ u
            n += len(u)
        values = np.concatenate(([n], total, product[upper]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["k", "v"])

    rows = map_arrow(vectors.select("embedding"), run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    values = np.zeros(1 + dim + len(upper[0]))
    for r in rows:
        values[r["k"]] = r["v"]
    n = max(values[0], 1)
    cov = np.zeros((dim, dim))
    cov[upper] = values[1 + dim :] / n
    cov = cov + np.triu(cov, 1).T - np.outer(values[1 : 1 + dim], values[1 : 1 + dim]) / n**2
    return np.linalg.eigh(cov)[1][:, ::-1][:, :GRID_DIMS].copy()


def _unit(col: pa.Array, dim: int) -> np.ndarray:
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, initial=0, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _local_labels(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a boolean matrix of links between rows and columns: a label for each row and column that is
    the same for what the links connect. Rows and columns without links have their own."""
    n, m = linked.shape
    a, b = np.arange(n), np.arange(n, n + m)
    while True:
        new_a = np.minimum(a, np.where(linked, b[None, :], n + m).min(axis=1, initial=n + m))
        new_b = np.minimum(b, np.where(linked, new_a[:, None], n + m).min(axis=0, initial=n + m))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


class PairJoin:
    """Joins two blocks of the sequence, or one with itself: link weights of each vector, and forests."""

    def __init__(self, u: np.ndarray, v: np.ndarray | None, w_u: np.ndarray, w_v: np.ndarray | None, basis: np.ndarray, least: float):
        self.same = v is None
        self.u, self.v = u, u if v is None else v
        self.wu, self.wv = w_u, w_u if v is None else w_v
        self.yu, self.yv = self.u @ basis, self.v @ basis
        self.least = least
        self.reach = 2 - 2 * least + 1e-9  # squared distance of unit vectors at the threshold
        self.nu = np.zeros(len(self.u), np.int64)
        self.nv = self.nu if self.same else np.zeros(len(self.v), np.int64)
        offset = 0 if self.same else len(self.u)
        self.offset, self.root = offset, np.arange(offset + len(self.v))
        self.leaves = 0

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, a: int, b: int, c: int, d: int) -> None:
        """Rows [a, b) of the one interval with rows [c, d) of the other."""
        y, z = self.yu[a:b], self.yv[c:d]
        gap = np.maximum(0, np.maximum(y.min(axis=0) - z.max(axis=0), z.min(axis=0) - y.max(axis=0)))
        if (gap * gap).sum() > self.reach:
            return
        if b - a <= LEAF and d - c <= LEAF:
            self.leaf(a, b, c, d)
            return
        if self.same and a == c:
            m = (a + b) // 2
            self.join(a, m, a, m)
            self.join(a, m, m, b)
            self.join(m, b, m, b)
        elif b - a >= d - c:
            m = (a + b) // 2
            self.join(a, m, c, d)
            self.join(m, b, c, d)
        else:
            m = (c + d) // 2
            self.join(a, b, c, m)
            self.join(a, b, m, d)

    def leaf(self, a: int, b: int, c: int, d: int) -> None:
        self.leaves += 1
        linked = self.u[a:b] @ self.v[c:d].T >= self.least
        own = self.same and a == c
        if own:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return
        self.nu[a:b] += linked @ self.wv[c:d]
        if not own:
            self.nv[c:d] += self.wu[a:b] @ linked
        la, lb = _local_labels(linked)
        ids = np.concatenate((np.arange(a, b), np.arange(c, d) + self.offset))
        for x, label in zip(ids.tolist(), np.concatenate((la, lb)).tolist(), strict=True):
            p, q = self.find(x), self.find(int(ids[label]))
            if p != q:
                self.root[max(p, q)] = min(p, q)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least_cosine: float = 0.95) -> DataFrame:
    """One row for each vector: id_col, n_links, component_id (long) and kept (boolean).

    n_links counts the other rows at a cosine of at least least_cosine, in double precision;
    component_id is the smallest id reachable by such links, the row's own included; kept says
    that it is the row's own. Vectors that are null, empty or zero or hold a null or non-finite
    component link with nothing, and those of one length only among themselves. Pairs at exactly
    least_cosine link. Rows that repeat an id count as vectors of their own. A null id links
    nothing and has a null component. Other columns play no part, whatever their names. An empty
    table gives an empty result.

    Equal vectors stand as one with a weight. Each length is joined by itself, one after the
    other. Vectors are put in epsilon grid order: sorted by
    grid cells, as wide as the threshold's distance, on the leading principal dimensions of all
    vectors. The sequence is cut into blocks; pairs of blocks meet whose cells are neighbours and
    whose boxes are near enough, and each pair joins its intervals recursively, skipping halves
    that are provably distant. What a pair sends on is a count and a tree edge for each vector.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"))
    fine = F.col("id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    digest = (F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding"))
    keyed = rows.select("id", F.when(fine, F.struct(F.size("embedding").alias("d"), digest[0].alias("a"), digest[1].alias("b"))).alias("k"), "embedding")
    reps = keyed.where("k is not null").groupBy("k").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.any_value("embedding").alias("embedding"))
    reps = staged(reps.select("k", "rep", "weight", "embedding"), "vectors")
    lengths = sorted(r[0] for r in reps.select("k.d").distinct().collect())
    width_of = np.dtype("<f4" if isinstance(df.schema[vector_col].dataType.elementType, T.FloatType) else "<f8")  # blocks hold vectors as they came
    links = [_links(reps.where(F.col("k.d") == d), d, width_of, least_cosine) for d in lengths]
    found = reduce(DataFrame.union, links) if links else spark.createDataFrame([], "rep long, n long, root long")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comp = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vector-components")
    per_rep = reps.select("k", "rep", "weight").join(counts, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    per_rep = staged(per_rep.select("k", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")), "per-vector")
    unstage(reps, *links)
    out = keyed.select("id", "k").join(per_rep, "k", "left")
    label = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), label.alias("component_id"), F.coalesce(F.col("id") == label, F.lit(False)).alias("kept"))


def _links(reps: DataFrame, dim: int, width_of: np.dtype, least_cosine: float) -> DataFrame:
    """(rep, n, root), staged, of distinct vectors(rep, weight, embedding) of one length: the linked
    weights that a pair of blocks finds for a vector, and a tree edge to another vector linked with it."""
    basis, width = _principal(reps, dim), float(np.sqrt(2 - 2 * least_cosine) + 1e-9)
    dims = basis.shape[1]
    cells = [f"c{i}" for i in range(dims)]
    cell_schema = T.StructType([reps.schema["rep"], reps.schema["weight"], reps.schema["embedding"], *[T.StructField(c, T.IntegerType()) for c in cells]])

    def to_cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            y = np.floor(_unit(b.column(2), dim) @ basis / width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(y[:, i].copy()) for i in range(dims)]], cell_schema.names)

    placed = map_arrow(reps.select("rep", "weight", "embedding"), to_cells, cell_schema)
    n_parts = reps.count() // BLOCK + 1
    ordered = placed.repartitionByRange(n_parts, *cells, "rep").sortWithinPartitions(*cells, "rep")
    ordered = ordered.coalesce(n_parts)  # neighbours go together, should there be more partitions than blocks
    block_schema = "block long, n int, reps binary, weights binary, vectors binary, lo array<double>, hi array<double>, keys array<string>"

    def to_blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k, held, count = TaskContext.get().partitionId() << 32, 0, [], 0

        def flush(n: int) -> Iterator[pa.RecordBatch]:
            nonlocal held, count, k
            t = pa.Table.from_batches(held).combine_chunks()
            part, rest = t.slice(0, n), t.slice(n)
            held, count = rest.to_batches() if rest.num_rows else [], rest.num_rows
            raw = part["embedding"].combine_chunks()
            y = _unit(raw, dim) @ basis
            cell = np.unique(np.stack([part[c].to_numpy() for c in cells[:KEY_DIMS]], axis=1), axis=0)
            keys = [",".join(map(str, c)) for c in cell.tolist()]
            flat = raw.flatten().to_numpy(zero_copy_only=False).astype(width_of)
            out = [[base + k], [part.num_rows], [part["rep"].to_numpy().astype("<i8").tobytes()], [part["weight"].to_numpy().astype("<i8").tobytes()], [flat.tobytes()]]
            out += [[y.min(axis=0).tolist()], [y.max(axis=0).tolist()], [keys]]
            k += 1
            types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["block", "n", "reps", "weights", "vectors", "lo", "hi", "keys"])

        for b in it:
            held.append(b)
            count += b.num_rows
            while count >= BLOCK:
                yield from flush(BLOCK)
        if count:
            yield from flush(count)

    blocks = staged(map_arrow(ordered, to_blocks, block_schema), "blocks")
    meta = blocks.select("block", "lo", "hi", F.explode("keys").alias("key"))
    steps = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    near = meta.select("block", "lo", "hi", F.split("key", ",").cast("array<int>").alias("c"))
    for i in range(min(KEY_DIMS, dims)):
        near = near.select("block", "lo", "hi", "c", *[f"s{j}" for j in range(i)], F.explode(steps).alias(f"s{i}"))
    near = near.select(
        "block", "lo", "hi", F.concat_ws(",", *[(F.get("c", F.lit(i)) + F.col(f"s{i}")).cast("string") for i in range(min(KEY_DIMS, dims))]).alias("key")
    ).distinct()
    one = near.select(F.col("block").alias("a"), F.col("lo").alias("la"), F.col("hi").alias("ha"), "key")
    two = meta.select(F.col("block").alias("b"), F.col("lo").alias("lb"), F.col("hi").alias("hb"), "key")
    gap = F.aggregate(
        F.arrays_zip("la", "ha", "lb", "hb"), F.lit(0.0), lambda s, x: s + F.pow(F.greatest(F.lit(0.0), x["la"] - x["hb"], x["lb"] - x["ha"]), F.lit(2.0))
    )
    pairs = one.join(two, "key").where("a <= b").where(gap <= width * width).select("a", "b").distinct()
    left = blocks.select(F.col("block").alias("a"), F.col("reps").alias("ra"), F.col("weights").alias("wa"), F.col("vectors").alias("va"))
    right = blocks.select(F.col("block").alias("b"), F.col("reps").alias("rb"), F.col("weights").alias("wb"), F.col("vectors").alias("vb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "wa", "va", "rb", "wb", "vb")

    def links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unit(x: pa.Scalar) -> np.ndarray:
            flat = pa.array(np.frombuffer(x.as_buffer(), width_of))
            return _unit(pa.FixedSizeListArray.from_arrays(flat, dim), dim)

        for b in it:
            for i in range(b.num_rows):
                a, c, ra, wa, va, rb, wb, vb = (b.column(j)[i] for j in range(8))
                same = a.as_py() == c.as_py()
                ids = [np.frombuffer(x.as_buffer(), np.int64) for x in ((ra,) if same else (ra, rb))]
                job = PairJoin(unit(va), None if same else unit(vb), np.frombuffer(wa.as_buffer(), np.int64), None if same else np.frombuffer(wb.as_buffer(), np.int64), basis, least_cosine)
                job.join(0, len(job.u), 0, len(job.v))
                every = np.concatenate(ids)
                n = job.nu if same else np.concatenate((job.nu, job.nv))
                some = np.flatnonzero(n)
                root = every[np.array([job.find(x) for x in some.tolist()], np.int64)] if len(some) else every[:0]
                yield pa.RecordBatch.from_arrays([pa.array(every[some]), pa.array(n[some]), pa.array(root)], ["rep", "n", "root"])

    found = staged(map_arrow(joined, links, "rep long, n long, root long"), "vector-links")
    unstage(blocks)
    return found

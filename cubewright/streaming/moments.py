"""Streaming moments: frames may come late, twice over several files, or in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def streaming_sums(voxels: DataFrame, dims: int) -> DataFrame:
    """Running sums of a stream of voxels (scan_id, y, x, v, c0[, c1, ...]) for each pixel.

    The sums add up in any order, so the state is one row a pixel and needs no watermark; use
    output mode update or complete.
    """
    aggs = [F.sum("v").alias("s")]
    for d in range(dims):
        aggs.append(F.sum(F.col("v") * F.col(f"c{d}")).alias(f"s{d}"))
        aggs += [F.sum(F.col("v") * F.col(f"c{d}") * F.col(f"c{e}")).alias(f"q{d}_{e}") for e in range(d, dims)]
    return voxels.groupBy("scan_id", "y", "x").agg(*aggs)


def moments_of_sums(sums: DataFrame, dims: int) -> DataFrame:
    """(scan_id, y, x, mu, cov) of streaming_sums' rows; zeros for pixels without counts."""

    def mean(c):
        return F.when(F.col("s") > 0, c / F.col("s")).otherwise(F.lit(0.0))

    mu = [mean(F.col(f"s{d}")) for d in range(dims)]
    cov = F.array(*[F.array(*[mean(F.col(f"q{min(d, e)}_{max(d, e)}")) - mu[d] * mu[e] for e in range(dims)]) for d in range(dims)])
    return sums.select("scan_id", "y", "x", F.array(*mu).alias("mu"), cov.alias("cov"))

"""Line deduplication with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cubewright.llm.common import staged

#: Stripped from both ends of a line's key.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _keys(lines: Column, min_chars: int) -> Column:
    """The 128-bit digest of each line's key, or null where the key is too short to count."""
    stripped = F.transform(lines, lambda x: F.btrim(x, F.lit(SPACES)))
    return F.transform(stripped, lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit("second"), k).alias("b"))))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drops lines that many documents share, but for those of the largest id that holds them.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at least
    min_chars code points held by at least min_docs distinct ids lose all their lines, except in
    the largest such id. Returns df's columns with text_col replaced by the kept lines, and
    n_lines, n_dropped (long), which replace columns of those names.

    Lines go as 128-bit digests: one row per distinct key and document counts documents per
    digest, and only the digests to drop come back to their documents. No line's text is
    shuffled but with its document, once.

    A null text counts as one empty line and comes back empty. A null id counts as no document:
    its lines drop like any other's but add nothing to a count. Rows that repeat an id are one
    document. An empty table gives an empty result.
    """
    def text_of(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    text = text_of(F.col(text_col))
    folded = F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    lines = df.select(
        F.col(id_col).alias("_id"), F.xxhash64(text).alias("_v"), F.posexplode(_keys(F.split(folded, "\n", -1), min_chars)).alias("_p", "_k")
    )
    held = lines.where(F.col("_k").isNotNull()).select("_id", "_v", "_p", "_k.a", "_k.b")
    shared = (
        held.groupBy("a", "b")
        .agg(F.count_distinct("_id").alias("_n"), F.max("_id").alias("_last"))
        .where(F.col("_n") >= min_docs)
        .select("a", "b", "_last")
    )
    # A table of its own, so that joining it can split the rows of a frequent line.
    shared = staged(shared, "shared-lines")
    drop = (
        held.join(shared, ["a", "b"])
        .where(F.col("_id").isNull() | (F.col("_id") != F.col("_last")))
        .groupBy("_id", "_v")
        .agg(F.collect_list("_p").alias("_drop"))
    )
    names = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    rows = df.select(F.struct(*names).alias("_row"), F.col(id_col).alias("_rid"), F.xxhash64(text).alias("_rv"))
    joined = rows.join(drop, F.col("_rid").eqNullSafe(F.col("_id")) & (F.col("_rv") == F.col("_v")), "left")
    text = text_of(F.col(f"_row.{text_col}"))
    n_lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"))) + 1
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    done = joined.select(
        "*", n_lines.cast("long").alias("_n_lines"), F.when(F.col("_drop").isNotNull(), F.split(text, "\n", -1)).alias("_lines")
    ).select(
        "_row",
        F.col("_n_lines").alias("n_lines"),
        F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(F.size("_lines") - F.size(kept)).cast("long").alias("n_dropped"),
        F.when(F.col("_drop").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda p: F.get(F.col("_lines"), p)), "\n")).alias("_text"),
    )
    return done.select(*[(F.col("_text") if c == text_col else F.col("_row")[c]).alias(c) for c in names], "n_lines", "n_dropped")

"""Line dedup: overlapping windows of three lines, found again anywhere, lose their later occurrences.

Each run of three consecutive lines of a document is hashed to 128 bits, lines being trimmed of spaces.
The first occurrence of a window, by document id, then text, then position, stays. All lines that a later
occurrence covers are removed, overlapping occurrences together; the rest are joined again.

Windows of blank lines only are left out; documents of fewer than three lines have no window and stay as
they are. Null texts stay null. A null id comes before all others. Rows that repeat an id and its text are
one document with one result each, and don't count as an occurrence of each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import col, text_hash

SPAN = 3


def _windows(lines: Column) -> Column:
    """An array of (position, hashes) of the windows of an array of lines; null for fewer lines.

    Lines are zipped with those that follow: a lambda that reads the whole array would cost lines squared.
    """
    cut = F.transform(lines, lambda x: F.trim(x))
    n = F.size(lines) - (SPAN - 1)
    names = [f"l{i}" for i in range(SPAN)]
    zipped = F.arrays_zip(*[F.slice(cut, i + 1, n).alias(name) for i, name in enumerate(names)])

    def window(x: Column, i: Column) -> Column:
        part = [x[name] for name in names]
        blank = reduce(lambda p, q: p & q, [q == "" for q in part])
        return F.when(~blank, F.struct(i.alias("pos"), F.xxhash64(*part).alias("w1"), F.xxhash64(F.lit(31), *part).alias("w2")))

    return F.when(n > 0, F.filter(F.transform(zipped, window), lambda x: x.isNotNull()))


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h1, h2, kept): the positions of the lines that stay of each document that loses some."""
    lines = F.split(col(text_col), "\n")
    rows = docs.select(col(id_col).alias("id"), *text_hash(col(text_col)), F.size(lines).alias("n"), _windows(lines).alias("found"))
    found = rows.select("id", "h1", "h2", "n", F.explode("found").alias("w")).select("id", "h1", "h2", "n", "w.*")
    first = found.groupBy("w1", "w2").agg(F.min(F.struct("id", "h1", "h2", "pos")).alias("first"), F.max(F.struct("id", "h1", "h2", "pos")).alias("last"))
    first = first.where("first <> last").select("w1", "w2", "first")
    later = found.join(first, ["w1", "w2"]).where(~F.struct("id", "h1", "h2", "pos").eqNullSafe(F.col("first")))
    gone = F.array_distinct(F.flatten(F.collect_set(F.sequence("pos", F.col("pos") + (SPAN - 1)))))
    return later.groupBy("id", "h1", "h2").agg(gone.alias("gone"), F.first("n").alias("n")).select("id", "h1", "h2", F.array_except(F.sequence(F.lit(0), F.col("n") - 1), "gone").alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", drop_emptied: bool = True) -> DataFrame:
    """`docs`, all columns, with the covered lines cut from the text, and its new length in `length_col` if there.

    A document whose lines are all covered is dropped, or kept with an empty text.
    """
    known = covered_lines(docs, id_col, text_col).select(F.col("id").alias("k_id"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), "kept")
    others = [col(c) for c in docs.columns if c != text_col]
    # the text goes through the join as its lines, once
    rows = docs.select(F.struct(*others).alias("row"), col(id_col).alias("id"), *text_hash(col(text_col)), F.split(col(text_col), "\n").alias("lines"))
    rows = rows.join(known, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    if drop_emptied:
        rows = rows.where("kept is null or size(kept) > 0")
    left = F.when(F.col("kept").isNull(), F.col("lines")).otherwise(F.transform("kept", lambda i: F.col("lines")[i]))
    rows = rows.select("row", F.array_join(left, "\n").alias("text"))
    new = {text_col: F.col("text")} | ({length_col: F.length("text").cast(docs.schema[length_col].dataType)} if length_col in docs.columns else {})
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])

"""Removal of repeated passages by overlapping windows of lines, in DataFrame operations only.

Lines are split at \\n; blank lines (ASCII white space only) take no part and
always stay.  A window of three consecutive lines begins at every other line;
one or two lines of over WINDOW_WORDS words are windows besides, so that a long
passage of few lines is found too.  A document of fewer lines has one window of
all its lines.  Windows of equal lines are found over the whole corpus by a
128-bit hash; the first occurrence in the order of (doc_id, line) stays, and the
lines that later occurrences cover are removed, overlaps merged.

The report tells lines that windows of three lines cover, or of a whole shorter
document, from those that only the further windows do; with words=None there are
no further windows.  First occurrences reach the windows by a join on counted
keys, in which a very common window is broadcast.

Defined cases: a null text has no lines and stays null; a document with blank
lines only stays as it is; a null doc_id comes first in the order, and texts of
one doc_id are ordered by their hash; rows equal in doc_id and text are one
document and share its fate; an empty table gives no rows; other columns of
documents are carried along, whatever their names; a very long text is split
within its row, and its windows are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import join_counted, once, written

WINDOW_WORDS = 50

_SPACES = r"[\x20\x09-\x0D]+"
_SOLID = r"[^\x20\x09-\x0D]"
#: Names of helper columns, which no table of documents has.
_ID, _HASH, _GONE, _THREE, _LINES = (f"__line_dedup_{x}" for x in ("id", "hash", "gone", "three", "lines"))


def _lasts(words: int | None) -> str:
    """SQL: (last line, whether it is a window of three lines or of a whole document) of the windows that begin at line i of hs."""
    three = "if(i + 2 < size(hs), named_struct('j', i + 2, 'three', true), null)"
    whole = "if(i = 0 and size(hs) < 3, named_struct('j', size(hs) - 1, 'three', true), null)"
    if words is None:
        return f"filter(array({three}, {whole}), x -> x is not null)"
    one = f"if(hs[i].w > {words} and not (i = 0 and size(hs) = 1), named_struct('j', i, 'three', false), null)"
    two = f"if(i + 1 < size(hs) and hs[i].w + hs[i + 1].w > {words} and not (i = 0 and size(hs) = 2), named_struct('j', i + 1, 'three', false), null)"
    return f"filter(array({one}, {two}, {three}, {whole}), x -> x is not null)"


def windows(docs: DataFrame, words: int | None = WINDOW_WORDS) -> DataFrame:
    """id, text_hash, the window's hash (a, b), its first line i and covered, the numbers of its lines in the text; and three, whether it is one of three lines."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("p"), x.alias("line"))), lambda x: x["line"].rlike(_SOLID))
    hashed = F.transform(lines, lambda x: F.struct(x["p"].alias("p"), F.xxhash64(x["line"]).alias("a"), F.xxhash64(F.lit(17), x["line"]).alias("b"), F.size(F.array_remove(F.split(x["line"], _SPACES), "")).alias("w")))
    df = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), once(hashed).alias("hs"))
    # explode_outer: for explode() Spark infers a filter, and evaluates hs for it once more for every line
    made = F.expr(f"""if(size(hs) < 1, array(), flatten(transform(sequence(0, size(hs) - 1), i -> transform({_lasts(words)}, x -> named_struct('i', i, 'j', x.j, 'three', x.three)))))""")
    df = df.select("id", "text_hash", "hs", F.explode_outer(made).alias("x")).where("x is not null")
    return df.selectExpr(
        "id", "text_hash", "xxhash64(transform(slice(hs, x.i + 1, x.j - x.i + 1), y -> y.a)) as a", "xxhash64(transform(slice(hs, x.i + 1, x.j - x.i + 1), y -> y.b)) as b",
        "hs[x.i].p as i", "transform(slice(hs, x.i + 1, x.j - x.i + 1), y -> y.p) as covered", "x.three",
    )


def removals(docs: DataFrame, words: int | None = WINDOW_WORDS) -> DataFrame:
    """id, text_hash, gone, the numbers of the lines to remove, and n_three, how many of them lie in windows of three lines, for each document that loses any."""
    found = written(windows(docs, words).dropDuplicates(["id", "text_hash", "a", "b", "i"]), "windows")
    place = F.struct(F.col("id").isNotNull().alias("known"), "id", "text_hash", "i")
    repeated = written(found.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(place).alias("kept")).where("n > 1"), "repeated-windows")
    later = join_counted(found, repeated, ["a", "b"], "n").where(~place.eqNullSafe(F.col("kept")))
    lost = later.select("id", "text_hash", F.explode("covered").alias("p"), "three").groupBy("id", "text_hash", "p").agg(F.max("three").alias("three"))
    return lost.groupBy("id", "text_hash").agg(F.sort_array(F.collect_list("p")).alias("gone"), F.count_if("three").alias("n_three"))


def _joined(docs: DataFrame, words: int | None) -> DataFrame:
    gone = removals(docs, words).toDF(_ID, _HASH, _GONE, _THREE)
    # removals grow with the documents: never broadcast
    return docs.join(gone.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(gone[_ID]) & (F.xxhash64("text") == gone[_HASH]), "left").drop(_ID, _HASH).withColumn(_LINES, once(F.split("text", "\n")))


def _kept_text() -> Column:
    kept = F.array_except(F.sequence(F.lit(0), F.size(_LINES) - 1), _GONE)
    return F.when(F.col(_GONE).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda p: F.get(_LINES, p)), "\n"))


def remove_repeats(docs: DataFrame, words: int | None = WINDOW_WORDS, drop_emptied: bool = True) -> DataFrame:
    """docs with repeated lines removed from the texts; drop_emptied: without the documents that lose all they had."""
    out = _joined(docs, words).withColumn("text", _kept_text())
    if drop_emptied:
        out = out.where(F.col(_GONE).isNull() | F.col("text").rlike(_SOLID))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, words: int | None = WINDOW_WORDS) -> DataFrame:
    """doc_id, n_lines (not blank), n_removed, n_removed_three (of them, in windows of three lines), text_sha256 of what stays (null for a null text)."""
    df = _joined(docs.select("doc_id", "text"), words)
    n_lines = F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(_SOLID))), F.lit(0)).cast("long")
    n_lines = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n_lines)
    gone = F.when(F.col(_GONE).isNull(), F.lit(0)).otherwise(F.size(_GONE)).cast("long")
    three = F.coalesce(F.col(_THREE), F.lit(0)).cast("long")
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), n_lines.alias("n_lines"), gone.alias("n_removed"), three.alias("n_removed_three"), F.sha2(_kept_text(), 256).alias("text_sha256"))

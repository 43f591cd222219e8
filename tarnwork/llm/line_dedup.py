"""Line dedup with overlapping three-line windows.

Every run of three consecutive lines is hashed; a window that occurs more than once in the corpus keeps its first
occurrence (smallest id, then position), and the lines that any later occurrence covers are removed: the covered
positions of a document are merged, so that a long repeated passage goes as a whole.

The windows' first occurrences come from a partial aggregation (one row per window and task, however common it is).
Windows that hold more than 1/HOT of all rows are fewer than HOT and are broadcast; all others meet their first
occurrence in a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, may_be_in, text_of, written

HOT = 1000


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, body and two hashes of both that name the document, alike whenever it is computed."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("body"))
    return rows.withColumn("k", F.xxhash64("doc_id", "body")).withColumn("k2", F.xxhash64("body", "doc_id", F.lit(1)))


#: Hashes of the line before the first and of the line after the last, which no text holds.
EDGES = tuple(f"named_struct('a', {a}L, 'b', {b}L, 'w', false)" for a, b in ((2718281828459045235, 3602874713526624977), (5772156649015328606, 651209008240243104)))


def windows(rows: DataFrame, size: int = 3, edges: bool = False) -> DataFrame:
    """k, k2, doc_id, pos, h, h2: the windows of `size` lines that hold a word, with two independent hashes.

    edges: a text has a line 0 before its first and one after its last line, and windows may hold them.
    """
    # each line is hashed once, each window from the hashes of its lines
    line = F.transform(F.split("body", "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b"), x.rlike(WORD).alias("w")))
    if edges:
        line = F.concat(F.array(F.expr(EDGES[0])), line, F.array(F.expr(EDGES[1])))
    hashed = rows.select("k", "k2", "doc_id", line.alias("l")).where(F.size("l") >= size)
    at = F.expr(f"transform(sequence(1, size(l) - {size - 1}), p -> struct(p - {int(edges)} as pos, slice(l, p, {size}) as w))")
    each = hashed.select("k", "k2", "doc_id", F.explode(at).alias("x")).where(F.exists("x.w.w", lambda y: y))
    return each.select("k", "k2", "doc_id", F.col("x.pos").alias("pos"), F.xxhash64("x.w.a").alias("h"), F.xxhash64("x.w.b", F.lit(2)).alias("h2"))


def line_dedup(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text", edges: bool = False) -> DataFrame:
    """One row per input row: doc_id, text (without the removed lines), n_lines, n_removed, removed (line numbers from 1).

    Lines end at \\n and are compared as they are; windows without a word in any line never count. A text of fewer than
    `size` lines is kept whole, unless `edges` puts a line of its own before the first and after the last of each text: then
    whole texts from `size` - 2 lines on and passages of `size` - 1 lines at either end are found, too. A null text counts as
    empty (one empty line). A null id comes after all others. Rows that repeat an id and its text are one document, and each
    gets its result. An empty table gives an empty result; other columns are ignored. A text of any length is cut into all its
    lines, which one row's worth of memory must hold.
    """
    rows = keyed(docs, id_col, text_col)
    win = written(windows(rows, size, edges), "lines-windows")
    order = F.struct(F.col("doc_id").isNull().alias("anon"), "doc_id", "k", "k2", "pos")
    again = win.groupBy("h", "h2").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = written(again.select(F.col("h").alias("g"), F.col("h2").alias("g2"), F.col("first.k").alias("f"), F.col("first.k2").alias("f2"), F.col("first.pos").alias("f_pos"), "n"), "lines-repeated")
    bar = win.count() / HOT
    same = (F.col("h") == F.col("g")) & (F.col("h2") == F.col("g2"))
    first = (F.col("k") == F.col("f")) & (F.col("k2") == F.col("f2")) & (F.col("pos") == F.col("f_pos"))
    hits = [win.join(g, same).where(~first).select("k", "k2", "pos") for g in (F.broadcast(again.where(F.col("n") > bar)), again.where(F.col("n") <= bar))]
    # a document's positions are bounded by its own lines
    gone = hits[0].unionByName(hits[1]).groupBy("k", "k2").agg(F.collect_set("pos").alias("at"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + (size - 1))))))
    gone = written(gone.select(F.col("k").alias("g"), F.col("k2").alias("g2"), covered.alias("removed")), "lines-gone")

    # only documents that may lose lines meet their line numbers; the others are not shuffled
    sure, doubtful = may_be_in(rows, F.col("k"), gone, F.col("g"))
    met = doubtful.join(gone, (F.col("k") == F.col("g")) & (F.col("k2") == F.col("g2")), "left").select("doc_id", "body", "removed")
    out = sure.select("doc_id", "body", F.lit(None).cast("array<int>").alias("removed")).unionByName(met)
    lines = F.split("body", "\n", -1)
    if edges:
        out = out.withColumn("removed", F.filter("removed", lambda p: p.between(1, F.size(lines))))
    rest = F.transform(F.array_except(F.sequence(F.lit(1), F.size(lines)), "removed"), lambda p: F.get(lines, p - 1))
    return out.select(
        "doc_id", F.when(F.col("removed").isNull(), F.col("body")).otherwise(F.array_join(rest, "\n")).alias("text"),
        F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )

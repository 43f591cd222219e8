"""The refinement queue: a predicate over a table, batches that go out, rows that come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import utrim
from ..functions.values import ANALYSIS_RANGE, EVIDENCE_LONG


def refinable(text: Column, file_exists: Column | None = None) -> Column:
    has_text = F.length(utrim(F.coalesce(text, F.lit("")))) > 0
    return has_text if file_exists is None else has_text | F.coalesce(file_exists, F.lit(False))


def queued(refined_at: Column, text: Column, file_exists: Column | None = None) -> Column:
    return (F.coalesce(refined_at, F.lit(0)) == 0) & refinable(text, file_exists)


def unrefinable(refined_at: Column, text: Column, source_file: Column, file_exists: Column) -> Column:
    """Not refined, names a source file, but there is neither text nor file."""
    named = F.coalesce(source_file, F.lit("")) != ""
    return (F.coalesce(refined_at, F.lit(0)) == 0) & named & ~refinable(text, file_exists)


def stamped(old: DataFrame, refined: DataFrame, key: str, columns: list[str], corrections: list[str], now_ms: int, stamp: str = "ai_refined_at") -> DataFrame:
    """Refined columns, corrections and the mark in one update; a null correction keeps the cell, no column no mark."""
    r = refined.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in (*columns, *corrections)])
    j = old.join(r, old[key] == F.col("__key"), "left")
    some = F.coalesce(*[F.when(F.col(f"__{c}") != "", F.lit(True)) for c in columns], F.lit(False))
    new = {c: F.coalesce(F.nullif(f"__{c}", F.lit("")), old[c]) for c in (*columns, *corrections)}
    return j.withColumns(new | {stamp: F.when(some, F.lit(now_ms)).otherwise(old[stamp])}).drop("__key", *[f"__{c}" for c in (*columns, *corrections)])


def attribution(pending: DataFrame, done: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, misattributed): rows of done that their own part asked for, and the others."""
    keys = pending.select(*on).distinct()
    return done.join(keys, on, "left_semi"), done.join(keys, on, "left_anti")


def integrity(pending: DataFrame, done: DataFrame, part: str = "part", key: str = "id") -> DataFrame:
    """Per part: whether done holds exactly the pending ids, each once; also how many are missing, foreign, repeated."""
    p = pending.groupBy(part, key).agg(F.count(F.lit(1)).alias("p"))
    d = done.groupBy(part, key).agg(F.count(F.lit(1)).alias("d"))
    j = p.join(d, [part, key], "full_outer")
    out = j.groupBy(part).agg(
        F.count_if(F.col("d").isNull()).alias("n_missing"), F.count_if(F.col("p").isNull()).alias("n_foreign"), F.coalesce(F.sum(F.col("d") - 1), F.lit(0)).alias("n_repeated")
    )
    return out.withColumn("complete", (F.col("n_missing") == 0) & (F.col("n_foreign") == 0) & (F.col("n_repeated") == 0))


def merged(done: DataFrame, by: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(first row of each key, the others), in the order of parts and positions; what order leaves open is left open here."""
    w = Window.partitionBy(*by).orderBy(*order)
    n = done.withColumn("__n", F.row_number().over(w))
    return n.where("__n = 1").drop("__n"), n.where("__n > 1").drop("__n")


def counts(tables: dict[str, DataFrame], predicate: dict[str, Column]) -> DataFrame:
    """table, n_queued of several tables."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count_if(predicate[name]).alias("n_queued")).select(F.lit(name).alias("table"), "n_queued")
        out = one if out is None else out.unionByName(one)
    return out


def match_observations(rows: DataFrame, expected: DataFrame, on: list[str]) -> DataFrame:
    """kind and key of what a reader should look at; nothing is dropped for it. rows: keys, evidence, ai_analysis, keep."""
    n, said = F.length("ai_analysis"), F.trim(F.coalesce("ai_analysis", F.lit(""))) != ""
    kinds = F.array_compact(F.array(
        F.when(F.length("evidence") > EVIDENCE_LONG, F.lit("overlong_evidence")),
        F.when(said & (n > ANALYSIS_RANGE[1]), F.lit("overlong_analysis")).when(said & (n < ANALYSIS_RANGE[0]), F.lit("thin_analysis")),
        F.when(~said & F.coalesce("keep", F.lit(False)), F.lit("missing_fields")),
        F.when(F.col("keep").isNull(), F.lit("missing_keep")),
    ))
    seen = rows.select(*on, F.explode(kinds).alias("kind"))
    lost = expected.select(*on).distinct().join(rows.select(*on), on, "left_anti").withColumn("kind", F.lit("missing_pairs"))
    return seen.unionByName(lost)


def unread(written: DataFrame, read: DataFrame, key: str, cell: str) -> DataFrame:
    """Rows that were written but are not found again (gone), or whose cell was written but reads empty (empty)."""
    back = read.select(F.col(key).alias("__key"), F.col(cell).alias("__cell"))
    j = written.join(back, written[key] == F.col("__key"), "left")
    kind = F.when(F.col("__key").isNull(), "gone").when((F.coalesce(written[cell], F.lit("")) != "") & (F.coalesce("__cell", F.lit("")) == ""), "empty")
    return j.select(written[key], kind.alias("kind")).where("kind is not null")


def new_options(labels: DataFrame, options: DataFrame) -> DataFrame:
    """Labels in use that the list of options lacks."""
    return labels.toDF("label").where("label <> ''").distinct().join(options.toDF("label"), "label", "left_anti")


def parts_summary(df: DataFrame, part: str = "part") -> DataFrame:
    """part, n: sizes of batches."""
    return df.groupBy(part).agg(F.count(F.lit(1)).alias("n"))

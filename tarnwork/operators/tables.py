"""Upkeep of keyed tables: upsert, delete, replacement, greedy dedupe, look-ups by fallback keys, drift of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null, utrim


def scan(df: DataFrame, equal: dict | None = None, fields: list[str] | None = None) -> DataFrame:
    """Rows where all named columns equal their values, and the named columns; both reach the file scan."""
    for k, v in (equal or {}).items():
        if k not in df.columns:
            raise ValueError(f"unknown column {k}; there are {', '.join(df.columns)}")
        df = df.where(F.col(k) == F.lit(v))
    return df.select(*fields) if fields else df


def nonempty(new: Column, kind: T.DataType) -> Column:
    """A cell that may be written: null, '' and [] never clear a cell."""
    if isinstance(kind, T.StringType):
        return F.when(new != "", new)
    if isinstance(kind, T.ArrayType):
        return F.when(F.size(new) > 0, new)
    return new


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The snapshot after new rows: their non-empty cells replace, unknown keys are added, columns of old only stay."""
    fresh = new.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in new.columns if c != key])
    j = old.join(fresh, old[key] == F.col("__key"), "full_outer")
    cols = [F.coalesce(old[key], F.col("__key")).alias(key)]
    for f in old.schema.fields:
        if f.name != key:
            cols.append(F.coalesce(nonempty(F.col(f"__{f.name}"), f.dataType), old[f.name]).alias(f.name) if f.name in new.columns else old[f.name])
    return j.select(*cols)


def delete(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def replace_groups(old: DataFrame, new: DataFrame, by: list[str], owned: Column, groups: DataFrame | None = None) -> DataFrame:
    """Rows of old that are owned and whose group new brings go; the others (and groups that new lacks) stay.

    groups: the groups of new, if they are known without computing it.
    """
    touched = (new if groups is None else groups).select(*by).distinct().withColumn("__touched", F.lit(True))
    kept = old.join(touched, by, "left").where(~(F.coalesce(F.col("__touched"), F.lit(False)) & F.coalesce(owned, F.lit(False)))).drop("__touched")
    return kept.unionByName(new)


def lookup(left: DataFrame, right: DataFrame, keys: list[tuple[Column, Column]], value: str, order: Column, last: bool = False) -> DataFrame:
    """left with `value` of right by the first key that finds a row; of several rows the first (or last) by order."""
    out, names = left, []
    for k, (mine, theirs) in enumerate(keys):
        pick = F.max_by if last else F.min_by
        side = right.groupBy(theirs.alias(f"__k{k}")).agg(pick(F.col(value), order).alias(f"__v{k}")).where(F.col(f"__k{k}").isNotNull())
        out = out.join(side, mine == F.col(f"__k{k}"), "left").drop(f"__k{k}")
        names.append(f"__v{k}")
    return out.withColumn(value, F.coalesce(*names)).drop(*names)


def greedy_dedupe(batch: DataFrame, known: DataFrame | None = None, order: str = "file", within: bool = True) -> DataFrame:
    """batch: order column, phone, md5, has_contact -> reason: accepted, md5, needs_ocr or phone.

    Rows are taken in order; a known or accepted hash skips a row, then rows without contact wait for recognition, then a known
    or accepted phone skips it. Equal bytes have equal phones, so one window by phone (else hash) gives the accepted rows
    and, from the accepted row of the group, the reason of the others. known: phone, md5. Without within, rows are held against
    known only, as if each came alone.
    """
    df = batch.withColumn("phone", blank_to_null(F.col("phone")))
    if known is None:
        df = df.withColumns({"known_md5": F.lit(False), "known_phone": F.lit(False)})
    else:
        m = known.where("md5 <> ''").select(F.col("md5").alias("k_md5")).distinct()
        p = known.where("phone <> ''").select(F.col("phone").alias("k_phone")).distinct()
        df = df.join(m, F.col("md5") == F.col("k_md5"), "left").join(p, F.col("phone") == F.col("k_phone"), "left")
        df = df.withColumns({"known_md5": F.col("k_md5").isNotNull(), "known_phone": F.col("k_phone").isNotNull()}).drop("k_md5", "k_phone")
    reason = F.when(F.col("known_md5"), "md5").when(~F.col("has_contact"), "needs_ocr").when(F.col("known_phone"), "phone")
    if not within:
        return df.withColumn("reason", reason.otherwise("accepted")).drop("known_md5", "known_phone")
    usable = F.col("has_contact") & ~F.col("known_md5") & ~F.col("known_phone")
    w = Window.partitionBy(F.coalesce("phone", "md5"), usable).orderBy(order)
    df = df.withColumns({"place": F.row_number().over(w), "first_md5": F.first("md5").over(w)})
    reason = reason.when(F.col("place") == 1, "accepted").when(F.col("first_md5") == F.col("md5"), "md5").otherwise("phone")
    return df.withColumn("reason", reason).drop("place", "first_md5", "known_md5", "known_phone")


def surplus(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """Rows after the first of each non-empty key."""
    w = Window.partitionBy("__key").orderBy(*order)
    return df.withColumn("__key", key).where("__key <> ''").withColumn("__n", F.row_number().over(w)).where("__n > 1").drop("__key", "__n")


def first_rows(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; null keys are one key."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def missing_keys(written: DataFrame, read: DataFrame, on: str) -> DataFrame:
    """Keys that were written but are not found again."""
    return written.select(on).where(F.col(on).cast("string") != "").distinct().join(read.select(on), on, "left_anti")


def drift(df: DataFrame, declared: list[str], primary: str | None = None) -> dict[str, list[str]]:
    """Declared columns that are missing, and columns that are not declared."""
    have = df.columns
    return {"missing": [c for c in declared if c not in have], "extra": [c for c in have if c not in declared and c != primary]}


def add_missing(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns}) if set(schema.names) - set(df.columns) else df


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    if old not in df.columns or new in df.columns:
        raise ValueError(f"cannot rename {old} to {new}")
    return df.withColumnRenamed(old, new)


def drop(df: DataFrame, column: str, declared: list[str]) -> DataFrame:
    if column in declared:
        raise ValueError(f"{column} is declared")
    return df.drop(column)


def parse_spec(spec: str) -> tuple[str, str, str | None]:
    """`table:column` or `table:column=new` as (table, column, new)."""
    table, colon, column = spec.partition(":")
    if not colon:
        raise ValueError(f"{spec} is not table:column[=new]")
    column, _, new = column.partition("=")
    return table.strip(), column.strip(), new.strip() or None


def specs(c: Column) -> Column:
    """parse_spec() of a column: struct<table, column, new>, null where there is no colon."""
    rest = F.regexp_replace(c, "(?s)^[^:]*:", "")
    new = F.when(F.contains(rest, F.lit("=")), F.nullif(utrim(F.regexp_replace(rest, "(?s)^[^=]*=", "")), F.lit("")))
    return F.when(F.contains(c, F.lit(":")), F.struct(utrim(F.substring_index(c, ":", 1)).alias("table"), utrim(F.substring_index(rest, "=", 1)).alias("column"), new.alias("new")))


def create(spark, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)

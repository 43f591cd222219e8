"""Refinement of résumés and openings: queued rows out in parts, rows of readers back, repaired, applied and verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize
from ..functions.text import blank_to_null, tokens
from ..functions.values import CORRECTIONS, JOB_KEYS, JOB_REFINED
from ..operators import refine, tables
from . import parts

MARK = "ai_refined_at"


def prepared(rows: DataFrame, text: Column, key: str, file_exists: Column | None = None, batch: int | None = None) -> DataFrame:
    """The queued rows of a table with the part that each goes out in, in order of their key."""
    return parts.parts(rows.where(refine.queued(F.col(MARK), text, file_exists)), [F.col(key)], batch)


def _first_rows(done: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(the first row of each key by part and position, key and reason of the others and of rows without a key)."""
    named = done.where(blank_to_null(F.col(key).cast("string")).isNotNull())
    first, again = refine.merged(named, [key], ["part", "position"])
    nameless = done.where(blank_to_null(F.col(key).cast("string")).isNull()).select(F.lit(None).cast(done.schema[key].dataType).alias(key), F.lit("no key").alias("reason"))
    return first, again.select(key, F.lit("repeated").alias("reason")).unionByName(nameless)


def merged_resumes(done: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows to write with the kinds of repair, key and reason of the rows left out).

    done: part, position, key, ai_structured, ai_deep, skills and corrections as texts. The first row of a key counts; it is repaired,
    never rejected for its form; a row without anything in its three columns is left out.
    """
    first, lost = _first_rows(done, key)
    row = normalize.resume_row(F.col("ai_structured"), F.col("ai_deep"), F.col("skills"), {c: F.col(c) for c in CORRECTIONS if c in done.columns})
    out = first.select(key, row.alias("r")).select(key, "r.*")
    filled = normalize.has_content(F.col("ai_extract"), F.col("ai_deep"), F.array_join("skills", ""))
    return out.where(filled), lost.unionByName(out.where(~filled).select(key, F.lit("empty").alias("reason")))


def applied_resumes(table: DataFrame, rows: DataFrame, now_ms: int, key: str = "id") -> DataFrame:
    """The table with the refined columns, the corrections and the mark that takes a row off the queue, in one update."""
    rows = rows.drop("kinds").join(table.select(key), key, "left_semi").withColumn(MARK, F.lit(now_ms).cast("long"))
    return tables.upsert(table, rows, key)


def merged_jobs(done: DataFrame, key: str = "job_id") -> tuple[DataFrame, DataFrame]:
    """The same for openings: gates in full, skills in one form, none of must again in bonus. done: part, position, key, the three columns."""
    first, lost = _first_rows(done, key)
    row = normalize.job_row(F.col("hard_gates"), F.col("must_skills"), F.col("bonus_skills"))
    out = first.select(key, row.alias("r")).select(key, "r.*")
    filled = normalize.has_content(*map(F.col, JOB_REFINED))
    return out.where(filled), lost.unionByName(out.where(~filled).select(key, F.lit("empty").alias("reason")))


def synced_jobs(table: DataFrame, payload: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(the table with the payload's cells, keys that no opening has).

    payload: key (a job_id, or department|job_name) and cells; only the writable ones are written, and only where they say
    something. The mark is set where one of the three refined columns is among them.
    """
    by_name = F.concat_ws("|", "department", "job_name")
    side = table.select(F.col("job_id").alias("t_id"), by_name.alias("t_name"), F.col("job_id").alias("found"))
    met = tables.lookup(payload, side, [(F.col("key"), F.col("t_id")), (F.col("key"), F.col("t_name"))], "found", F.col("t_id"), last=True)
    cells = [c for c in JOB_KEYS if c in payload.columns]
    said = F.lit(False)
    for c in JOB_REFINED:
        if c in cells:
            said = said | (F.coalesce(F.col(c), F.lit("")) != "")
    new = met.where("found is not null").select(F.col("found").alias("job_id"), *cells, F.when(said, F.lit(now_ms).cast("long")).alias(MARK))
    return tables.upsert(table, new, "job_id"), met.where("found is null").select("key")


def corrected(table: DataFrame, payload: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(the table with what people corrected, keys that no row has); nothing is marked as refined.

    payload: key (a phone number or a name), name and cells. A row is found by phone, else by name (the payload's, else the key);
    of several rows the last. A key of digits fills in the phone of a payload that has none.
    """
    side = table.select(blank_to_null(F.col("phone")).alias("t_phone"), blank_to_null(F.col("name")).alias("t_name"), F.col(key).alias("found"))
    name = F.coalesce(blank_to_null(F.col("name")), F.col("key"))
    met = tables.lookup(payload, side, [(F.col("key"), F.col("t_phone")), (name, F.col("t_name"))], "found", F.col("found"), last=True)
    cells = [c for c in payload.columns if c not in ("key", "phone")]
    phone = blank_to_null(F.col("phone")) if "phone" in payload.columns else F.lit(None).cast("string")
    phone = F.coalesce(phone, F.when(F.col("key").rlike("^[0-9]+$"), F.col("key")))
    new = met.where("found is not null").select(F.col("found").alias(key), *cells, phone.alias("phone"))
    return tables.upsert(table, new, key), met.where("found is null").select("key")


def verified(rows: DataFrame, table: DataFrame, key: str = "id", cell: str = "skills") -> DataFrame:
    """key and kind of the rows that are not found again (gone) or whose words read empty (empty)."""
    text = lambda df: df.select(key, F.array_join(cell, "、").alias(cell) if dict(df.dtypes)[cell].startswith("array") else cell)
    return refine.unread(text(rows), text(table), key, cell)


def options(rows: DataFrame, known: DataFrame, cell: str = "skills") -> DataFrame:
    """Labels of the rows that the list of options lacks."""
    words = F.col(cell) if dict(rows.dtypes)[cell].startswith("array") else tokens(F.col(cell))
    return refine.new_options(rows.select(F.explode(words)), known)

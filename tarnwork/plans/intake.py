"""Intake of résumés and job descriptions: texts in, typed and deduplicated rows out, with the reason for every row left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import job, resume
from ..functions.normalize import unknown_keys
from ..functions.text import blank_to_null, tokens
from ..operators import tables
from ..operators.stats import outcome
from ..schema import RESUME

#: Characters of a text that are stored, columns that only refinement writes.
TEXT_LENGTH, PRODUCED = 20_000, ("skills", "ai_extract", "ai_deep", "ai_refined_at")


def resumes(texts: DataFrame, known: DataFrame | None, now_ms: int) -> DataFrame:
    """texts: file, text, md5, needs_ocr, error -> all fields and reason: accepted, md5, phone, needs_ocr or failed.

    known: phone, md5 of the table. Files without contact data wait for recognition; a file that could not be read failed.
    """
    p = resume.parsed(texts, "text", "file").withColumn("has_contact", F.col("phone").isNotNull() | F.col("email").isNotNull())
    p = p.withColumn("has_contact", F.col("has_contact") & ~F.col("needs_ocr") & F.col("error").isNull())
    p = tables.greedy_dedupe(p, known)
    reason = F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("reason"))
    return p.withColumns({
        "reason": reason, "certificates": F.array_join("certificates", "、"), "full_text": F.substring("text", 1, TEXT_LENGTH), "attach_md5": F.col("md5"),
        "upload_time": F.lit(now_ms).cast("long"), "source_file": F.col("file"), "years_experience": F.col("years_experience").cast("double"),
    }).drop("text", "has_contact")


def resume_rows(intake: DataFrame) -> DataFrame:
    """The accepted rows in the form of the table."""
    return tables.add_missing(intake.where("reason = 'accepted'"), RESUME).select(*RESUME.names)


def report(intake: DataFrame) -> DataFrame:
    """One row: files by outcome, and the level of the run."""
    n = lambda r: F.count_if(F.col("reason") == r)
    r = intake.agg(F.count(F.lit(1)).alias("total"), *[n(x).alias(x) for x in ("accepted", "md5", "phone", "needs_ocr", "failed")])
    return r.withColumn("level", outcome(F.lit(None).cast("string"), F.lit(0), F.col("failed"), F.col("needs_ocr")))


def backfill(records: DataFrame, known: DataFrame | None, within: bool = True) -> DataFrame:
    """records: file and cells, a map of texts -> cells that may be written, derived ones filled, what was stripped, reason.

    Columns that refinement produces are stripped; keys that are no columns are told. Known phones are skipped, and
    those of earlier records, unless within is off: then each record is held against the table only.
    """
    own = [c for c in RESUME.names if c not in PRODUCED]
    df = records.withColumns({"unknown": unknown_keys(F.col("cells"), tuple(RESUME.names)), "stripped": F.array_intersect(F.map_keys("cells"), F.array(*map(F.lit, PRODUCED)))})
    cell = {c: F.try_element_at("cells", F.lit(c)) for c in own if c not in ("attachment",)}
    words = tokens(F.try_element_at("cells", F.lit("skills")))
    cell = resume.derived(cell | {"skills": words})
    cell.pop("skills")
    df = df.withColumns(cell).withColumns({"md5": F.md5(F.to_json("cells")), "has_contact": blank_to_null(F.col("phone")).isNotNull() | blank_to_null(F.col("email")).isNotNull()})
    return tables.greedy_dedupe(df, known, within=within).drop("cells", "has_contact", "md5")


def jobs(texts: DataFrame, known_ids: DataFrame | None = None) -> DataFrame:
    """texts: file, text -> all fields, job_id and reason: accepted, or exists (in the table, or in an earlier file)."""
    p = job.parsed(texts, "text", "file").withColumn("job_id", job.job_id(F.col("department"), F.col("job_name")))
    if known_ids is not None:
        p = p.join(known_ids.select("job_id", F.lit(True).alias("known")).distinct(), "job_id", "left")
    else:
        p = p.withColumn("known", F.lit(None).cast("boolean"))
    later = tables.surplus(p.select("job_id", "file"), F.col("job_id"), [F.col("file")]).withColumn("later", F.lit(True))
    p = p.join(later, ["job_id", "file"], "left")
    return p.withColumn("reason", F.when(F.col("known").isNotNull() | F.col("later").isNotNull(), "exists").otherwise("accepted")).drop("known", "later")

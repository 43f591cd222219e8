"""Statistics of openings and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import none_if_empty
from ..functions.values import NO_DEPARTMENT, OPEN_STATUS, RECOMMEND, REPORT_HEAD, REPORT_TAIL, SUMMARY_FIELDS, SUMMARY_ROWS, UNJUDGED


def job_stats(jobs: DataFrame, matches: DataFrame) -> DataFrame:
    """Per opening: matches in all and by label; an unknown label counts as the last; openings without a match have zeros.

    matches: a row per match, or, with a column n, a row for n of them.
    """
    label, n = F.col("recommend"), _each(matches)
    known = [F.sum(F.when(label == r, n).otherwise(0)).alias(name) for r, name in zip(RECOMMEND[:-1], ("stat_recommend", "stat_pending"))]
    rest = F.sum(F.when(label.isNull() | ~label.isin(*RECOMMEND[:-1]), n).otherwise(0)).alias("stat_reject")
    s = matches.groupBy("job_id").agg(F.sum(n).alias("stat_total"), *known, rest)
    names = ("stat_total", "stat_recommend", "stat_pending", "stat_reject")
    return jobs.select("job_id").join(s, "job_id", "left").na.fill(0, list(names))


def _each(matches: DataFrame) -> Column:
    return F.col("n").cast("long") if "n" in matches.columns else F.lit(1).cast("long")


def label_stats(matches: DataFrame, order: Column) -> DataFrame:
    """Per job_id ('?' if unknown): the first job_name, the number of matches, and how many per label, in one text.

    matches: a row per match, or, with a column n, a row for n of them.
    """
    m = matches.select(F.coalesce(none_if_empty(F.col("job_id")), F.lit("?")).alias("job_id"), "job_name", F.coalesce(none_if_empty(F.col("recommend")), F.lit(UNJUDGED)).alias("label"), order.alias("o"), _each(matches).alias("each"))
    per = m.groupBy("job_id", "label").agg(F.sum("each").alias("n"), F.min(F.struct("o", "job_name")).alias("first"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "n"))), lambda x: F.concat_ws("=", x["label"], x["n"])), ";")
    return per.groupBy("job_id").agg(F.min("first")["job_name"].alias("job_name"), F.sum("n").alias("total"), said.alias("by_label"))


def funnel(jobs: DataFrame) -> DataFrame:
    """One row: sums over openings that have been matched, the number of those that have not, the latest submission."""
    done = F.col("stat_total").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(done, F.coalesce(c, F.lit(0)))), F.lit(0)).alias(c)
    return jobs.agg(
        *map(total, ("stat_total", "stat_recommend", "stat_pending", "stat_reject")), F.count_if(~done).alias("unmatched"),
        F.count(F.lit(1)).alias("jobs"), F.max(F.nullif("submit_time", F.lit(0))).alias("as_of"),
    )


def departments(jobs: DataFrame) -> DataFrame:
    """Openings per department, open ones (in the strict sense) and all."""
    d = F.coalesce(none_if_empty(F.col("department")), F.lit(NO_DEPARTMENT)).alias("department")
    return jobs.groupBy(d).agg(F.count_if(F.col("status") == OPEN_STATUS).alias("n_open"), F.count(F.lit(1)).alias("n_all"))


def top(matches: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The n best recommended matches; ties in the given order."""
    return matches.where(F.col("recommend") == RECOMMEND[0]).orderBy(F.desc(F.coalesce("total_score", F.lit(0))), *order).limit(n)


def is_open(status: Column) -> Column:
    """For matching, an opening without a status is open."""
    return F.coalesce(none_if_empty(status), F.lit(OPEN_STATUS)) == OPEN_STATUS


def outcome(error: Column, n_missing: Column, n_failed: Column, n_ocr: Column) -> Column:
    """The level of a report."""
    return F.when(F.coalesce(error != "", F.lit(False)) | (n_missing > 0), "BAD").when((n_failed > 0) | (n_ocr > 0), "WARN").otherwise("OK")


def summary(rows: DataFrame, order: list[Column], fields: tuple[str, ...] = SUMMARY_FIELDS, most: int = SUMMARY_ROWS) -> DataFrame:
    """The first rows with their filled cells as a map, and, where there are more, a row that says how many."""
    have = [f for f in fields if f in rows.columns]
    pairs = F.filter(F.array(*[F.struct(F.lit(f).alias("k"), F.col(f).cast("string").alias("v")) for f in have]), lambda p: F.coalesce(p["v"], F.lit("")) != "")
    first = rows.orderBy(*order).limit(most).select(F.map_from_entries(pairs).alias("cells"), F.lit(None).cast("long").alias("more"))
    rest = rows.agg((F.count(F.lit(1)) - most).alias("more")).where("more > 0").select(F.lit(None).cast("map<string,string>").alias("cells"), "more")
    return first.where(F.size("cells") > 0).unionByName(rest)


def report_order(names) -> list[str]:
    """The keys of a report as they are shown: the fixed ones first, then others as they came, errors and times last."""
    names = list(names)
    fixed = (*REPORT_HEAD, *REPORT_TAIL)
    return [n for n in REPORT_HEAD if n in names] + [n for n in names if n not in fixed] + [n for n in REPORT_TAIL if n in names]


def ordered(report: DataFrame) -> DataFrame:
    return report.select(*report_order(report.columns))

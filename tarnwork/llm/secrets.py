"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by its content (SHA-256). The ledger holds the findings of each pair of blob and
rule version that has been scanned; a run scans only the pairs that are not in it, one representative per blob, and joins all
findings back to the paths of every version. A rule whose pattern changes gets a new version and is scanned anew;
everything else comes from the ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import salted, scratch, text_of, written

#: Kind, version, pattern, group whose length counts, least length, a cheaper pattern that any match contains.
RULES = (
    ("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8, r"(?i:passw|secret|token|api_?key)"),
    # a run that is too short holds no longer one: the least length may stand in the pattern
    ("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16, r"AKIA[A-Z0-9]{12}"),
    ("hex", 1, r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
    ("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, r"PRIVATE KEY-----"),
    ("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, r"gh[pousr]_[A-Za-z0-9]{36}"),
)
BASE = ("assign", "access", "hex")


#: What the arrays of matches hold: the gap before a match, its length and that of the group that counts.
STEPS = "array<struct<kind:string,version:int,i:int,gap:int,m:int,g:int,least:int>>"


def matches(text: Column, kind: str, version: int, pattern: str, group: int, least: int, needs: str) -> Column:
    """The leftmost non-overlapping matches in order. Matches and gaps alternate, so their lengths add up to offsets."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    got = F.transform(
        F.arrays_zip(whole.alias("m"), part.alias("g"), F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("gap")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), F.lit(version).alias("version"), i.alias("i"), F.length(x["gap"]).alias("gap"),
            F.length(x["m"]).alias("m"), F.length(x["g"]).alias("g"), F.lit(least).alias("least"),
        ),
    )
    return F.when(text.rlike(needs), got).otherwise(F.expr(f"cast(array() as {STEPS})"))


SPANS = "array<struct<kind:string,version:int,start:int,end:int>>"
LEDGER = f"blob binary, scanned array<struct<kind:string,version:int>>, found {SPANS}"


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def read_ledger(spark: SparkSession, at: str) -> DataFrame:
    """The ledger in a folder, as open_ledger() and scan_into() keep it."""
    return spark.read.schema(LEDGER).parquet(at)


def open_ledger(spark: SparkSession) -> str:
    """A new, empty ledger in the shared folder."""
    at = scratch(spark, "secrets-ledger")
    empty_ledger(spark).write.parquet(at)
    return at


def scan_into(versions: DataFrame, at: str, rules=RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The findings of scan() with the ledger in folder `at`, to which the pairs that were scanned now are appended.

    Findings are read back from the ledger, so that one row's blob costs a scan once, whatever the number of runs and paths.
    """
    spark = versions.sparkSession
    _, added = scan(versions, read_ledger(spark, at), rules, path_col, text_col)
    added.write.mode("append").parquet(at)
    return scan(versions, read_ledger(spark, at), rules, path_col, text_col)[0]


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES, path_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, additions to the ledger).

    versions: a path and the text it had, one row per historical version. findings: path, blob and found, an array of
    (start, rank of the kind, kind, end) in that order, one row per row of versions. Additions: blob, scanned (kind, version),
    found; appended to the ledger they make the next run skip these pairs, and with no pair left no text is read. A null text
    counts as empty; a text of any length is scanned whole by the regular expressions of the JVM. Null paths and repeated rows
    each get their findings; empty tables give empty results; other columns are ignored.
    """
    spark = versions.sparkSession
    ledger = empty_ledger(spark) if ledger is None else ledger
    rules = list(rules)
    rank = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r[0], k)])
    current = F.array(*[F.struct(F.lit(r[0]).alias("kind"), F.lit(r[1]).alias("version")) for r in rules])
    none = F.array().cast("array<struct<kind:string,version:int>>")

    rows = versions.select(F.col(path_col).alias("path"), text_of(text_col).alias("body")).withColumn("blob", F.unhex(F.sha2("body", 256)))
    paths = written(rows.select("path", "blob"), "secrets-paths")
    # one path per blob stands for it
    stands = paths.groupBy("blob").agg(F.min("path").alias("path"))
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
    fresh = stands.join(seen, "blob", "left").withColumn("todo", F.array_except(current, F.coalesce("seen", none)))
    fresh = written(fresh.where(F.size("todo") > 0).select("blob", "path", "todo"), "secrets-todo")
    if fresh.isEmpty():
        new = spark.createDataFrame([], f"blob binary, found {SPANS}")
    else:
        pick = rows["path"].eqNullSafe(fresh["path"]) & (rows["blob"] == fresh["blob"])
        texts = rows.join(fresh, pick).select(rows["blob"], "body", "todo")
        each = [F.when(F.array_contains("todo.kind", r[0]), matches(F.col("body"), *r)) for r in rules]
        hits = texts.select("blob", F.explode(F.flatten(F.array_compact(F.array(*each)))).alias("x")).select("blob", "x.*")
        # rows that repeat a path and its text give the same hits twice
        hits = hits.dropDuplicates(["blob", "kind", "i"])
        end = F.sum(F.col("gap") + F.col("m")).over(Window.partitionBy("blob", "kind").orderBy("i")).cast("int")
        hits = hits.withColumn("end", end).where("g >= least").withColumn("start", F.col("end") - F.col("m"))
        new = written(hits.groupBy("blob").agg(F.collect_list(F.struct("kind", "version", "start", "end")).alias("found")), "secrets-found")
    added = fresh.join(new, "blob", "left").select("blob", F.col("todo").alias("scanned"), F.coalesce("found", F.array().cast(SPANS)).alias("found"))

    old = ledger.select("blob", F.filter("found", lambda s: F.exists(current, lambda c: (c["kind"] == s["kind"]) & (c["version"] == s["version"]))).alias("found")).where(F.size("found") > 0)
    told = old.unionByName(new).groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("found"))
    ordered = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    # one blob may be that of a third of all paths, as the empty text
    dealt, each = salted(paths, told.select("blob", ordered.alias("found")), "blob", "path")
    findings = dealt.join(each, ["blob", "salt"], "left")
    return findings.select("path", "blob", F.coalesce("found", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")).alias("found")), added

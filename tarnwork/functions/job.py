"""Fields of a job description from its text and file name, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resume import bare_name, found
from .text import any_in, none_if_empty, utrim, words_in
from .values import BONUS_WEIGHT, CITIES, DEFAULT_ORGANISATION, DEPARTMENT_ALIASES, DEPARTMENTS, MUST_WEIGHT, OPEN_STATUS, ORGANISATIONS, SKILLS

# Patterns of the fields.
SKIPPED = r"^(附件\d*[:：]?岗位说明书|岗位说明书|说明书|曲靖制造基地|曲靖基地|.*基地)$"
JOB_NAME = r"(?U)(?:岗位名称|职位名称|职位)\s*(?:Position)?\s*[:：]\s*([^\n：:]{2,40})"
SECTIONS = {
    "responsibilities": r"(岗位职责|工作职责|主要工作职责|工作内容|Major responsibilities)",
    "requirements": r"(任职要求|资格条件|任职资格|岗位要求|Qualifications)",
}
SECTION_END = r"(?U)(关键绩效指标|KPI|工作地点|职位名称|职等|直接上司|下属)|(?m:^\s*(?:起草|Draft|审核|批准)\s*[:：])"
GATE = r"([^\n。；;]*(?:学历|大专|本科|硕士|博士|年及以上|年以上|证书|电工证|注册)[^\n。；;]*)"
GATE_ENDS, GATE_WORDS = r"[\n。；;]", ("学历", "大专", "本科", "硕士", "博士", "年及以上", "年以上", "证书", "电工证", "注册")
PREFERRED = "优先"
LIMITS = {"job_name": 40, "section": 3000, "must": 12, "must_body": 10, "bonus": 8, "gates": 6}


def job_id(department: Column, job_name: Column) -> Column:
    digest = F.md5(F.concat(department, F.lit("|"), job_name).cast("binary"))
    return F.concat(F.lit("J"), F.upper(F.substring(digest, 1, 10)))


def file_parts(filename: Column) -> Column:
    """(org, department, rest of the name): departments are taken greedily, pairs of tokens before single ones."""
    base = bare_name(filename)
    orgs = "|".join(ORGANISATIONS)
    toks = F.filter(F.transform(F.split(base, "[-－—]"), utrim), lambda t: (t != "") & ~t.rlike(SKIPPED) & ~t.rlike(f"^(?:{orgs})"))
    known = F.array(*map(F.lit, DEPARTMENTS))
    alias = F.create_map(*[F.lit(x) for kv in DEPARTMENT_ALIASES.items() for x in kv])

    def dept(t):
        return F.coalesce(F.try_element_at(alias, t), F.when(F.array_contains(known, t), t))

    def pair_of(a, b):
        p = F.concat_ws("-", a, b)
        return F.when(F.array_contains(known, p), p).otherwise(F.try_element_at(alias, p))

    # state: the department so far, whether to skip the second token of a pair, whether departments have ended, how many are used
    start = F.struct(F.lit("").alias("d"), F.lit(False).alias("skip"), F.lit(False).alias("end"), F.lit(0).alias("i"))

    def step(s, t):
        after = F.get(toks, s["i"] + 1)
        pair = F.when(after.isNotNull(), pair_of(t, after))
        here = F.coalesce(pair, dept(t))
        going = ~s["end"] & ~s["skip"]
        return F.struct(
            F.when(going & here.isNotNull(), here).otherwise(s["d"]).alias("d"),
            (going & pair.isNotNull()).alias("skip"),
            (s["end"] | (going & here.isNull())).alias("end"),
            F.when(s["end"] | (going & here.isNull()), s["i"]).otherwise(s["i"] + 1).alias("i"),
        )

    got = F.aggregate(toks, start, step)
    own = F.split(got["d"], "-")
    rest = F.filter(F.slice(toks, got["i"] + 1, F.greatest(F.size(toks) - got["i"], F.lit(0))), lambda t: ~F.array_contains(known, t) & ~F.array_contains(own, t))
    tail = utrim(F.regexp_replace(F.array_join(rest, "、"), r"\d+$", ""))
    return F.struct(F.coalesce(found(base, f"({orgs})"), F.lit(DEFAULT_ORGANISATION)).alias("org"), got["d"].alias("department"), tail.alias("tail"))


def section(text: Column, name: str) -> Column:
    """What follows the title up to the nearest first match of an end that lies beyond its second character."""
    at = F.regexp_instr(text, F.lit(SECTIONS[name]))
    title = F.regexp_extract(text, SECTIONS[name], 0)
    rest = F.when(at > 0, text.substr(at + F.length(title), F.length(text)))
    stops = [F.regexp_instr(rest, F.lit(p)) - 1 for p in (*SECTIONS.values(), SECTION_END)]
    end = F.least(*[F.when(s > 2, s) for s in stops])
    return utrim(F.when(end.isNull(), rest).otherwise(rest.substr(F.lit(1), end)))


def gates(c: Column) -> Column:
    """What GATE finds: the fragments between its ends that hold one of its words. Taken apart first, long lines cost their length only."""
    parts = F.filter(F.split(c, GATE_ENDS), lambda g: any_in(g, GATE_WORDS))
    parts = F.transform(parts, lambda g: F.regexp_replace(g, "^[ 、，,：:]+|[ 、，,：:]+$", ""))
    return F.slice(F.array_distinct(F.filter(parts, lambda g: g != "")), 1, LIMITS["gates"])


def locations(text: Column, filename: Column) -> Column:
    cities = "(" + "|".join(CITIES) + ")"
    here = F.regexp_extract_all(text, F.lit(cities), F.lit(1))
    return F.array_distinct(F.when(F.size(here) > 0, here).otherwise(F.regexp_extract_all(bare_name(filename), F.lit(cities), F.lit(1))))


FIELDS = (
    "job_name", "department", "org", "status", "work_location", "responsibilities", "requirements", "hard_gates", "must_skills", "bonus_skills", "must_weight",
    "bonus_weight",
)


def parsed(df: DataFrame, text_col: str, file_col: str) -> DataFrame:
    """df with all fields, in projections that build on each other."""
    own = [c for c in df.columns if c not in FIELDS]
    t, f = F.col("__t"), F.col(file_col)
    df = df.withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumns({
        "__file": file_parts(f), "__named": found(t, JOB_NAME), "work_location": locations(t, f),
        "__resp": F.coalesce(section(t, "responsibilities"), F.lit("")), "__reqs": F.coalesce(section(t, "requirements"), F.lit("")),
    })
    df = df.withColumn("__asked", words_in(F.col("__reqs"), SKILLS))
    df = df.withColumn("__must", F.when(F.size("__asked") > 0, F.col("__asked")).otherwise(F.slice(words_in(t, SKILLS), 1, LIMITS["must_body"])))
    lines = F.filter(F.split("__reqs", r"\r\n|[\n\r]"), lambda x: F.contains(x, F.lit(PREFERRED)))
    bonus = F.filter(F.flatten(F.transform(lines, lambda x: words_in(x, SKILLS))), lambda w: ~F.array_contains("__must", w))
    df = df.withColumns({
        "job_name": F.substring(utrim(F.regexp_replace(F.coalesce("__named", "__file.tail"), r"(?U)\s+", " ")), 1, LIMITS["job_name"]),
        "department": F.col("__file.department"), "org": F.col("__file.org"), "status": F.lit(OPEN_STATUS),
        "responsibilities": F.substring("__resp", 1, LIMITS["section"]), "requirements": F.substring("__reqs", 1, LIMITS["section"]),
        "hard_gates": gates(F.coalesce(none_if_empty(F.col("__reqs")), t)), "must_skills": F.slice("__must", 1, LIMITS["must"]), "bonus_skills": F.slice(bonus, 1, LIMITS["bonus"]),
        "must_weight": F.lit(MUST_WEIGHT), "bonus_weight": F.lit(BONUS_WEIGHT),
    })
    return df.select(*own, *FIELDS)

"""Gates of an opening: a text of segments is read once into values, then compared with a candidate's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import none_if_empty, utrim
from .values import GATE_ABSENT, GATE_SEGMENTS, LEVELS


def segment(gates: Column, name: str) -> Column:
    """What follows `name：` up to a semicolon; empty if there is none."""
    return utrim(F.regexp_extract(F.coalesce(gates, F.lit("")), name + r"[：:](?U:\s)*([^；;]+)", 1))


def needed_level(gates: Column) -> Column:
    """The level that the education segment asks for; 0: none is enforced."""
    s = segment(gates, "学历")
    has = lambda w: F.contains(s, F.lit(w))
    return (
        F.when(has("放宽至大专"), 1).when(has("本科及以上"), 2).when(has("大专及以上"), 1).when(has("硕士") | has("研究生"), 3).when(has("博士"), 4).otherwise(0)
    )


def level(education: Column) -> Column:
    e, out = utrim(F.coalesce(education, F.lit(""))), None
    for name, n in LEVELS.items():
        out = F.when(e == name, n) if out is None else out.when(e == name, n)
    return out.otherwise(0)


def needed_years(gates: Column) -> Column:
    """The least number of years named; 0 where graduates may apply or nothing is asked for."""
    s = segment(gates, "经验")
    years = F.array_min(F.transform(F.regexp_extract_all(s, F.lit(r"(\d{1,2})(?U:\s)*年"), F.lit(1)), lambda x: x.cast("int")))
    return F.when(F.contains(s, F.lit("应届")) | F.contains(s, F.lit("不作")), 0).otherwise(F.coalesce(years, F.lit(0)))


def needed_certificates(gates: Column) -> Column:
    """Certificates that are asked for; preferred ones are left out."""
    s = segment(gates, "证书")
    hard = F.regexp_replace(F.regexp_replace(s, r"（[^）]*优先[^）]*）", ""), r"(?U)[^、，,\s]*优先", "")
    items = F.transform(F.split(hard, "[、,，]"), lambda x: utrim(F.regexp_replace(x, "等.*$", "")))
    return F.when((s == "") | F.contains(s, F.lit(GATE_ABSENT)), F.array().cast("array<string>")).otherwise(F.filter(items, lambda x: x != ""))


def missing_certificates(gates: Column, certificates: Column, skills: Column) -> Column:
    pool = F.concat(F.coalesce(certificates, F.lit("")), F.lit("|"), F.array_join(F.coalesce(skills, F.array().cast("array<string>")), "|"))
    return F.filter(needed_certificates(gates), lambda c: ~F.contains(pool, c))


def age_range(gates: Column) -> Column:
    """(least, most) of the ages named; null with fewer than two."""
    ages = F.transform(F.regexp_extract_all(segment(gates, "年龄"), F.lit(r"(\d{2})"), F.lit(1)), lambda x: x.cast("int"))
    return F.when(F.size(ages) >= 2, F.struct(F.array_min(ages).alias("least"), F.array_max(ages).alias("most")))


def needed_majors(gates: Column) -> Column:
    """Words of the major segment: its tokens of two or more characters and its runs of two to six Han characters."""
    s = segment(gates, "专业")
    parts = F.filter(F.transform(F.split(s, r"[、,，；;（）()]|(?U:\s){2,}"), utrim), lambda x: F.length(x) >= 2)
    return F.array_distinct(F.concat(parts, F.regexp_extract_all(s, F.lit(r"([\u4e00-\u9fff]{2,6})"), F.lit(1))))


def parsed(gates: Column) -> Column:
    """All of a gate text in one struct, so that a pair compares values only."""
    return F.struct(
        needed_level(gates).alias("level"), needed_years(gates).alias("years"), needed_certificates(gates).alias("certificates"), age_range(gates).alias("age"),
        segment(gates, "专业").alias("major"), needed_majors(gates).alias("majors"),
    )


def other_org(own: Column, asked: Column) -> Column:
    """Both are named and differ."""
    return F.coalesce(none_if_empty(own) != none_if_empty(asked), F.lit(False))


def normalized(gates: Column) -> Column:
    """(text, kinds): full-width marks, missing segments appended; a blank text stays blank."""
    t = F.coalesce(utrim(gates), F.lit(""))
    fixed = t
    for name in GATE_SEGMENTS:
        fixed = F.replace(fixed, F.lit(f"{name}:"), F.lit(f"{name}："))
    fixed = F.replace(fixed, F.lit(";"), F.lit("；"))
    absent = F.filter(F.array(*[F.lit(f"{n}：") for n in GATE_SEGMENTS]), lambda n: ~F.contains(fixed, n))
    parts = F.filter(F.transform(F.split(fixed, "；"), utrim), lambda x: x != "")
    full = F.array_join(F.concat(parts, F.transform(absent, lambda n: F.concat(n, F.lit(GATE_ABSENT)))), "；")
    filled = F.size(absent) > 0
    kinds = F.array_compact(F.array(F.when(gates != t, F.lit("coerced_str")), F.when((t != "") & (fixed != t), F.lit("punct_fixed")), F.when((t != "") & filled, F.lit("gate_filled"))))
    return F.struct(F.when(t == "", "").when(filled, full).otherwise(fixed).alias("text"), kinds.alias("kinds"))

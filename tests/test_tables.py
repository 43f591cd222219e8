import itertools
import random

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import refine, stats, tables
from tarnwork.plans import parts
from tarnwork.schema import TABLES


def greedy(batch, known_md5=(), known_phone=()):
    seen_m, seen_p, out = set(known_md5), set(known_phone), {}
    for file, phone, md5, contact in sorted(batch):
        if md5 in seen_m:
            out[file] = "md5"
        elif not contact:
            out[file] = "needs_ocr"
        elif phone and phone in seen_p:
            out[file] = "phone"
        else:
            out[file] = "accepted"
            seen_m.add(md5)
            if phone:
                seen_p.add(phone)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_dedupe_equals_the_loop(spark, seed):
    rnd = random.Random(seed)
    files = {f"m{k}": (rnd.choice(["", None, "p1", "p2", "p3", "p4"]), rnd.random() < 0.8) for k in range(12)}
    batch = [(f"f{k:03}", files[m][0], m, files[m][1]) for k, m in enumerate(rnd.choice(sorted(files)) for _ in range(60))]
    known = [("p1", "m0"), ("", "m5")] if seed % 2 else []
    df = spark.createDataFrame(batch, "file string, phone string, md5 string, has_contact boolean")
    k = spark.createDataFrame(known, "phone string, md5 string") if known else None
    got = {r.file: r.reason for r in tables.greedy_dedupe(df, k).collect()}
    assert got == greedy(batch, [m for _, m in known], [p for p, _ in known if p])


def test_upsert_never_clears_a_cell(spark):
    old = spark.createDataFrame([(1, "a", ["x"]), (2, "b", ["y"])], "id int, s string, l array<string>")
    new = spark.createDataFrame([(1, "", []), (2, "c", ["z"]), (3, None, None)], "id int, s string, l array<string>")
    assert sorted(map(tuple, tables.upsert(old, new, "id").collect())) == [(1, "a", ["x"]), (2, "c", ["z"]), (3, None, None)]


def test_replace_keeps_rows_of_others(spark):
    old = spark.createDataFrame([("j1", "系统匹配", 1), ("j1", "人工匹配", 2), ("j2", "系统匹配", 3)], "job_id string, source string, v int")
    new = spark.createDataFrame([("j1", "系统匹配", 9)], "job_id string, source string, v int")
    got = tables.replace_groups(old, new, ["job_id"], F.col("source") == "系统匹配")
    assert sorted(r.v for r in got.collect()) == [2, 3, 9]


def test_lookup_falls_back_and_may_take_the_last(spark):
    left = spark.createDataFrame([("a", "n1"), (None, "n2"), ("z", "n2"), ("z", "zz")], "k string, n string")
    right = spark.createDataFrame([("a", "n9", 1, 10), ("b", "n2", 2, 20), ("c", "n2", 3, 30)], "rk string, rn string, o int, v int")
    keys = [(F.col("k"), F.col("rk")), (F.col("n"), F.col("rn"))]
    for last, want in ((False, 20), (True, 30)):
        got = sorted(tables.lookup(left, right, keys, "v", F.col("o"), last).select("n", "v").collect(), key=str)
        assert [r.v for r in got] == [10, want, want, None]


def test_drift_rename_drop_create(spark):
    df = spark.createDataFrame([(1, 2, 3)], "id int, a int, b int")
    assert tables.drift(df, ["a", "c"], "id") == {"missing": ["c"], "extra": ["b"]}
    assert tables.rename(df, "a", "c").columns == ["id", "c", "b"]
    with pytest.raises(ValueError):
        tables.rename(df, "a", "b")
    with pytest.raises(ValueError):
        tables.drop(df, "a", ["a"])
    for schema in TABLES.values():
        assert tables.add_missing(tables.create(spark, schema), schema).schema == schema
    with pytest.raises(ValueError):
        tables.scan(df, {"nope": 1})


@pytest.mark.parametrize("n, batch, cap, want", [(26, None, 20, (2, 13)), (20, None, 20, (1, 20)), (200, None, 20, (10, 20)), (100, 2, 20, (5, 20)), (30, 3, 10, (3, 10)), (0, None, 20, (0, 0)), (45, None, 99, (3, 15))])
def test_part_plan(spark, n, batch, cap, want):
    size = parts.batch_size(n, batch, cap)
    assert (size, -(-n // size) if size else 0) == want
    if n:
        got = parts.parts(spark.range(n), [F.col("id")], batch, cap).groupBy("part").agg(F.min("id").alias("a"), F.count("*").alias("c")).orderBy("part").collect()
        assert [(r.part, r.a, r.c) for r in got] == [(k + 1, k * size, min(size, n - k * size)) for k in range(want[1])]


def test_numbered_is_total_and_in_order(spark):
    df = spark.range(5000).withColumn("k", F.xxhash64("id") % 7)
    got = parts.numbered(df, [F.col("k"), F.col("id")]).collect()
    assert [r.ord for r in sorted(got, key=lambda r: (r.k, r.id))] == list(range(1, 5001))


def test_blocks(spark):
    df = spark.createDataFrame([("a", k) for k in range(17)] + [("b", 1)], "g string, o int")
    got = parts.blocks(df, ["g"], [F.col("o")]).groupBy("g", "block").count().orderBy("g", "block").collect()
    assert [tuple(r) for r in got] == [("a", 1, 8), ("a", 2, 8), ("a", 3, 1), ("b", 1, 1)]


def test_dashboard(spark):
    jobs = [("a", "招聘中", 10, 3, 4, 3, 5), (None, "已关闭", 5, 1, 2, 2, 9), ("a", None, None, None, None, None, 0)]
    df = spark.createDataFrame(jobs, "department string, status string, stat_total int, stat_recommend int, stat_pending int, stat_reject int, submit_time long")
    r = stats.funnel(df).first()
    assert (r.stat_total, r.stat_recommend, r.stat_pending, r.stat_reject, r.unmatched, r.as_of) == (15, 4, 6, 5, 1, 9)
    assert sorted(map(tuple, stats.departments(df).collect())) == [("a", 1, 2), ("未填部门", 0, 1)]
    m = spark.createDataFrame([(1, "待定", 65), (2, "推荐", 92), (3, "推荐", 88), (4, "推荐", 95), (5, "不推荐", 40), (6, "推荐", None)], "id int, recommend string, total_score int")
    assert [r.total_score for r in stats.top(m, 2, [F.col("id")]).collect()] == [95, 92]


def test_unknown_labels(spark):
    m = spark.createDataFrame([("j", "推荐", "n", 1), ("j", "??", "n", 2), ("j", None, "n", 3), (None, "待定", "o", 4)], "job_id string, recommend string, job_name string, o int")
    s = stats.job_stats(spark.createDataFrame([("j",), ("k",)], "job_id string"), m)
    assert sorted(map(tuple, s.collect())) == [("j", 3, 1, 0, 2), ("k", 0, 0, 0, 0)]
    got = {r.job_id: (r.job_name, r.total, r.by_label) for r in stats.label_stats(m, F.col("o")).collect()}
    assert got == {"j": ("n", 3, "??=1;推荐=1;未判定=1"), "?": ("o", 1, "待定=1")}


def test_attribution_and_integrity(spark):
    p = spark.createDataFrame([(1, "J1", "张三"), (2, "J2", "李四")], "part int, job_id string, name string")
    d = spark.createDataFrame([(1, "J1", "张三"), (2, "J2", "李四"), (2, "J1", "张三")], "part int, job_id string, name string")
    ok, bad = refine.attribution(p, d, ["part", "job_id", "name"])
    assert ok.count() == 2 and [tuple(r) for r in bad.collect()] == [(2, "J1", "张三")]
    ids = lambda rows: spark.createDataFrame(rows, "part int, id string")
    got = refine.integrity(ids([(1, "a"), (1, "b"), (2, "c"), (3, "d")]), ids([(1, "a"), (1, "b"), (2, "c"), (2, "c"), (2, "x")])).orderBy("part").collect()
    assert [(r.part, r.n_missing, r.n_foreign, r.n_repeated, r.complete) for r in got] == [(1, 0, 0, 0, True), (2, 0, 1, 1, False), (3, 1, 0, 0, False)]


@pytest.mark.parametrize("error, missing, failed, ocr, want", [("x", 0, 0, 0, "BAD"), (None, 1, 0, 0, "BAD"), ("", 0, 1, 0, "WARN"), (None, 0, 0, 2, "WARN"), (None, 0, 0, 0, "OK")])
def test_outcome(spark, error, missing, failed, ocr, want):
    df = spark.createDataFrame([(error, missing, failed, ocr)], "e string, m int, f int, o int")
    assert df.select(stats.outcome(F.col("e"), F.col("m"), F.col("f"), F.col("o"))).first()[0] == want


def test_empty_tables(spark):
    e = spark.createDataFrame([], "file string, phone string, md5 string, has_contact boolean")
    assert tables.greedy_dedupe(e).count() == 0
    assert parts.parts(spark.range(0), [F.col("id")]).count() == 0
    assert list(itertools.chain(tables.surplus(e, F.col("md5"), [F.col("file")]).collect())) == []

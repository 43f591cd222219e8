import json

import pytest
from pyspark.sql import functions as F

from tarnwork import cli
from tarnwork.functions import normalize
from tarnwork.plans import chain, intake
from tarnwork.schema import RESUME

BODY = "姓名：{}\n电话：{}\n学历：本科\n专业：会计\n"


def test_resume_intake(spark):
    rows = [
        ("a.txt", BODY.format("张三", "13800000001"), "m1", False, None), ("b.txt", BODY.format("张三", "13800000001"), "m1", False, None), ("c.txt", BODY.format("张三丰", "13800000001"), "m2", False, None),
        ("d.png", None, "m3", True, None), ("e.pdf", None, "m4", False, "no reader"), ("f.txt", "没有联系方式", "m5", False, None), ("g.txt", BODY.format("李四", "13800000009"), "m6", False, None),
    ]
    df = spark.createDataFrame(rows, "file string, text string, md5 string, needs_ocr boolean, error string")
    known = spark.createDataFrame([("13800000009", "m9")], "phone string, md5 string")
    got = intake.resumes(df, known, 5)
    assert {r.file: r.reason for r in got.collect()} == {"a.txt": "accepted", "b.txt": "md5", "c.txt": "phone", "d.png": "needs_ocr", "e.pdf": "failed", "f.txt": "needs_ocr", "g.txt": "phone"}
    table = intake.resume_rows(got)
    assert table.schema.names == RESUME.names and table.first().full_text.startswith("姓名：张三")
    r = intake.report(got).first()
    assert (r.total, r.accepted, r.md5, r.phone, r.needs_ocr, r.failed, r.level) == (7, 1, 1, 2, 2, 1, "WARN")


def test_backfill(spark):
    rows = [("x", {"name": "王五", "phone": "13811112222", "education": "大学本科", "skills": "PLC", "_file": "x", "nope": "1"}), ("y", {"name": "赵六", "phone": "13811112222"})]
    got = {r.file: r for r in intake.backfill(spark.createDataFrame(rows, "file string, cells map<string,string>"), None).collect()}
    assert (got["x"].reason, got["x"].education, got["x"].category, got["x"].unknown, got["x"].stripped) == ("accepted", "本科", "技术类", ["nope"], ["skills"])
    assert got["y"].reason == "phone" and got["y"].expected_location == "不限"


def test_job_intake(spark):
    rows = [("1-制造中心-技术部-工程师.docx", "任职要求：熟悉PLC"), ("2-制造中心-技术部-工程师.docx", "x"), ("制造中心-产品部-经理.docx", "")]
    df = spark.createDataFrame([(f.split("-", 1)[1] if f[0].isdigit() else f, t, f) for f, t in rows], "file string, text string, o string")
    got = intake.jobs(df.withColumn("file", F.concat(F.lit(""), "file"))).collect()
    assert sorted(r.reason for r in got if r.department == "产品部") == ["accepted"]
    known = spark.createDataFrame([(r.job_id,) for r in got if r.department == "产品部"], "job_id string")
    assert {r.reason for r in intake.jobs(df, known).where("department = '产品部'").collect()} == {"exists"}


def test_chain(spark):
    need = spark.createDataFrame([("j", "must", 1, "A"), ("j", "must", 2, "B")], "job_id string, side string, pos int, word string")
    have = spark.createDataFrame([(k, "A") for k in range(20)], "rid int, need string")
    jobs = spark.createDataFrame([("j", 1.0, 0.0, "招聘中", "A、B")], "job_id string, must_weight double, bonus_weight double, status string, must_skills string")
    pairs = spark.createDataFrame([(k, "j") for k in range(20)], "rid int, job_id string")
    pending = chain.prepared(pairs, have, need)
    assert sorted((r.part, r["count"]) for r in pending.groupBy("part").count().collect()) == [(1, 8), (2, 8), (3, 4)]
    assert pending.where("rid = 3").first().must_hits == ["A"]
    rows = [(r.part, 1, r.rid, "j", True) for r in pending.collect()]
    rows += [(rows[0][0], 2, rows[0][2], "j", False), (rows[0][0] % 3 + 1, 9, rows[0][2], "j", True)]
    done = spark.createDataFrame(rows, "part int, position int, rid int, job_id string, keep boolean")
    none = spark.createDataFrame([], "job_id string, rid int, ord int, side string, item string, basis string")
    ok, foreign, again = chain.merged(pending, done, jobs, need, have, none)
    assert {(r.total_score, r.keep) for r in ok.collect()} == {(50, True)} and ok.count() == 20
    assert foreign.count() == 1 and again.count() == 1
    chain.guard(jobs)
    for bad, queue in ((jobs.withColumn("status", F.lit("已关闭")), None), (jobs.withColumn("must_skills", F.lit("")), None), (jobs, pairs)):
        with pytest.raises(ValueError):
            chain.guard(bad, queue)
    chain.guard(jobs, pairs, force=True)


def test_cli(spark, tmp_path):
    at = str(tmp_path / "m")
    spark.createDataFrame([("j", "n", "推荐", 1), ("j", "n", None, 2)], "job_id string, job_name string, recommend string, v int").write.parquet(at)
    assert cli.run(spark, at, ["recommend=推荐"], "v") == {"count": 1, "records": [{"v": 1}]}
    assert json.loads(json.dumps(cli.run(spark, at, show_stats=True)))["records"][0]["total"] == 2
    with pytest.raises(ValueError):
        cli.run(spark, at, ["v"])


def test_unknown_keys(spark):
    df = spark.createDataFrame([({"a": "1", "_x": "2", "b": "3"},)], "m map<string,string>")
    assert df.select(normalize.unknown_keys(F.col("m"), ("a",))).first()[0] == ["b"]

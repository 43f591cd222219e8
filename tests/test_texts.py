import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tarnwork.functions import gates, job, normalize, resume, text
from tarnwork.operators import coverage
from tarnwork.sources import files, sinks
from tarnwork.streaming import drain


def parsed(spark, body, file=""):
    return resume.parsed(spark.createDataFrame([(body, file)], "b string, f string"), "b", "f").first()


def test_resume_fields(spark):
    r = parsed(spark, "姓名：张三\n电话：13812345678\n邮箱：a@b.cn\n学历：本科\n毕业院校：清华大学\n专业：电气工程\n5年工作经验\n期望岗位：电气工程师 应聘企业：某厂\n期望城市：杭州\nPLC")
    assert (r.name, r.phone, r.email, r.education, r.school, r.school_rank) == ("张三", "13812345678", "a@b.cn", "本科", "清华大学", "985")
    assert (r.years_experience, r.major, r.expected_position, r.expected_location, r.category) == (5, "电气工程", "电气工程师", "杭州", "技术类")


@pytest.mark.parametrize("body, want", [("初级会计职称", ["初级会计职称"]), ("持特种作业操作证与电工证", ["特种作业操作证", "电工证"]), ("", [])])
def test_certificates_take_the_longest_word(spark, body, want):
    assert parsed(spark, body).certificates == want


def test_school_suffix_is_not_cut_and_table_rows_give_majors(spark):
    assert parsed(spark, "贵州财经大学商务学院").school == "贵州财经大学商务学院"
    assert parsed(spark, "哈尔滨远东理工学院|机械设计制造及其自动化|本科").major == "机械设计制造及其自动化"


@pytest.mark.parametrize("body, file, want", [("", "【电工_曲靖_8K】李四 3年.pdf", "李四"), ("赵六\n男", "简历.docx", "赵六"), ("姓名：本科", "", None), ("x\n\n王五", "", "王五")])
def test_names(spark, body, file, want):
    assert parsed(spark, body, file).name == want


@pytest.mark.parametrize("body, file, want", [("经验：3年", "", 3), ("", "张三 7年.pdf", 7), ("2018年毕业", "", None), ("工作年限：12 年", "", 12)])
def test_years(spark, body, file, want):
    assert parsed(spark, body, file).years_experience == want


def test_derived_fills_blanks_only(spark):
    df = spark.createDataFrame([("大学本科", "清华大学", "", "市场类", None, "")], "education string, school string, school_rank string, category string, expected_position string, expected_location string")
    row = {c: F.col(c) for c in df.columns} | {"skills": F.array().cast("array<string>")}
    r = df.select(*[c.alias(k) for k, c in resume.derived(row).items()]).first()
    assert (r.education, r.school_rank, r.category, r.expected_location) == ("本科", "985", "市场类", "不限")


JD = "岗位职责：\n负责审核图纸与PLC编程\n任职要求：\n本科及以上学历；熟悉CAD\n有会计经验者优先\n审核：某人"


def test_job_fields(spark):
    df = spark.createDataFrame([(JD, "岗位说明书-制造中心-电池设备部-电气工程师2-杭州.docx")], "b string, f string")
    r = job.parsed(df, "b", "f").first()
    assert (r.department, r.org, r.work_location, r.must_skills) == ("电池制造部-设备部", "制造中心", ["杭州"], ["CAD", "会计"])
    assert r.hard_gates == ["本科及以上学历"] and r.requirements.endswith("优先") and "审核图纸" in r.responsibilities
    want = __import__("hashlib").md5("部|名".encode()).hexdigest()[:10].upper()
    assert spark.range(1).select(job.job_id(F.lit("部"), F.lit("名"))).first()[0] == "J" + want


def test_gate_normalization_is_idempotent(spark):
    df = spark.createDataFrame([("学历:本科;经验：3年",), ("",)], "g string")
    once = df.select(gates.normalized(F.col("g")).alias("r")).select("r.*")
    a, b = once.collect()
    assert a.text == "学历：本科；经验：3年；专业：不作硬性要求；证书：不作硬性要求；年龄：不作硬性要求" and a.kinds == ["punct_fixed", "gate_filled"] and b.text == ""
    again = once.select(gates.normalized(F.col("text")).alias("r")).select("r.*").first()
    assert (again.text, again.kinds) == (a.text, [])


NAMES = ["学历背景", "工作经历", "核心技能"]


@pytest.mark.parametrize("body", ["学历背景｜本科\n工作经历｜5年\n核心技能｜PLC", "学历|x\n\n其他｜y", "a\nb", "核心技能｜z\n学历背景｜q", "工作经历\n工作经历｜1"])
def test_segments_are_idempotent(body):
    once, _ = normalize.repaired_segments(body, NAMES)
    assert normalize.repaired_segments(once, NAMES) == (once, [])
    heads = [x.split("｜")[0] for x in once.split("\n")]
    assert [h for h in dict.fromkeys(heads) if h in NAMES] == NAMES


@pytest.mark.parametrize("raw, good, bad", [
    ('[{"id": "a"}, {"id": "b"}]', 2, []), ('[{"id": "a"},]', 1, []), ('[{"id": "a", "t": "x"y"}, {"id": "b"}]', None, None), ('{"id": "a", "t": "{}"}', 1, []),
    ('[{"id": "a", "t": "}{"} {"id": "b"}', 2, []), ("garbage", 0, [None]), ("[{bad}, {\"id\": \"c\"}]", 1, [None]), (None, 0, [None]),
])
def test_salvage(raw, good, bad):
    rows, errors = normalize.salvaged_objects(raw)
    assert all(isinstance(json.loads(r), dict) for r in rows)
    if good is not None:
        assert (len(rows), [e[0] for e in errors]) == (good, bad)


@pytest.mark.parametrize("cell, n, ms", [("1700000000", 1.7e9, 1700000000000), ("1700000000000", 1.7e12, 1700000000000), ("2024-03-05 10:00", None, 1709596800000), ("x", None, None), ("", None, None)])
def test_lenient_cells(spark, cell, n, ms):
    r = spark.createDataFrame([(cell,)], "c string").select(text.number(F.col("c")), text.date_millis(F.col("c"))).first()
    assert tuple(r) == (n, ms)


def test_odd_words_and_markup(spark):
    df = spark.createDataFrame([(["设备", "一", "热镀铝锌硅钢板", "averyverylongword", "PLC编程"],)], "w array<string>")
    assert df.select(text.odd_words(F.col("w"), 12, (2, 6))).first()[0] == ["一", "热镀铝锌硅钢板", "averyverylongword"]
    assert df.select(text.odd_words(F.col("w"), 12, (2, 6), True)).first()[0] == ["一", "热镀铝锌硅钢板"]
    assert df.select(text.stripped_markup(F.lit("<w:p>a<w:tab/>b</w:p><p>c<br/>d</p>"))).first()[0] == "a\tb\nc\nd\n"


def test_proposals(spark):
    pool = spark.createDataFrame([("总账处理",), ("设备维修",), ("安全管理",), ("EHS",)], "label string")
    needs = [("j", 1, "账务处理"), ("j", 2, "金蝶"), ("j", 3, "危险源辨识"), ("k", 1, "EHS"), ("k", 2, "安全管理"), ("k", 3, "应急管理"), ("k", 4, "事故管理"), ("k", 5, "安全评价")]
    df = spark.createDataFrame(needs, "job_id string, pos int, need string")
    got = {r.job_id: r for r in coverage.proposals(pool, df, 0.5).collect()}
    assert got["j"].must_skills == "总账处理、金蝶、危险源辨识" and got["j"].causes == "①,②,②"
    assert got["k"].must_skills == "EHS、安全管理、应急管理、事故管理、安全评价" and got["k"].collisions == 3


def test_files_are_read_or_say_why(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", "<w:p>甲<w:tab/>乙</w:p><w:p>A&amp;B</w:p>")
    for name, data in (("a.txt", "你好".encode()), ("b.docx", buf.getvalue()), ("c.docx", b"no zip"), ("d.png", b"x"), ("e.pdf", b"%PDF"), ("f.doc", "\x01简历正文一二三四五六".encode("utf-16-le")), ("g.xyz", b"")):
        (tmp_path / name).write_bytes(data)
    got = {r.file: r for r in files.texts(files.listing(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.txt", "b.docx", "c.docx", "d.png", "e.pdf", "f.doc"}
    assert got["a.txt"].text == "你好" and got["b.docx"].text == "甲\t乙\nA&B\n" and got["f.doc"].text == "简历正文一二三四五六"
    assert got["c.docx"].error and got["e.pdf"].error and got["d.png"].needs_ocr and not got["a.txt"].needs_ocr


def test_sinks(spark, tmp_path):
    sinks.write_parts(spark.createDataFrame([(1, "a"), (2, "b")], "part int, v string"), str(tmp_path / "o"))
    assert files.payloads(spark, str(tmp_path / "o" / "part=1")).first().v == "a"
    page = sinks.page({"t": 15, "r": 4, "p": 6, "x": 5}, [{"department": "<a>", "n_open": 1, "n_all": 2}], [{"name": "n", "job_name": "j", "total_score": 95, "evidence": None}], "—")
    assert "&lt;a&gt;" in page and "width:100%" in page


def test_drain_hands_over_each_row_once(spark, tmp_path):
    src, seen = str(tmp_path / "in"), []
    schema = "id int, text string, ai_refined_at long"
    take = lambda df, k: seen.extend(r.id for r in df.collect())
    for rows in ([(1, "a", None), (2, "", None), (3, "b", 5)], [(4, "c", 0)], []):
        if rows:
            spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        drain.drain(drain.arrivals(spark, src, schema), take, str(tmp_path / "check")).awaitTermination()
    assert sorted(seen) == [1, 4]

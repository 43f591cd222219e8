import random

import pytest
from pyspark.sql import functions as F

from tarnwork.functions import gates, text
from tarnwork.functions.values import HYPERNYMS, SYNONYMS
from tarnwork.operators import matching


def py_hit(c, n):
    if n in c or c in n:
        return True
    a = {k for k, g in enumerate(SYNONYMS) if c in g}
    return bool(a) and a == {k for k, g in enumerate(SYNONYMS) if n in g} or c in HYPERNYMS.get(n, ())


def test_hits_equal_pairwise_definition(spark):
    words = ["成本控制", "成本管控", "单晶炉", "光伏设备", "排风系统", "空调系统", "暖通", "PLC", "PLC编程", "司机", "电工证"]
    w = spark.createDataFrame([(x,) for x in words], "word string")
    got = {tuple(r) for r in matching.token_hits(w, w.toDF("need"), *matching.dictionary(spark)).collect()}
    assert got == {(c, n) for c in words for n in words if py_hit(c, n)}


@pytest.mark.parametrize("hit, n, total, label", [(4, 5, 80, "推荐"), (79, 100, 79, "待定"), (3, 5, 60, "待定"), (59, 100, 59, "不推荐"), (1, 200, 0, "不推荐"), (3, 200, 2, "不推荐")])
def test_score_is_half_even(spark, hit, n, total, label):
    df = spark.createDataFrame([(hit, 0, n, 0, 1.0, 0.0)], "n_must_hit int, n_bonus_hit int, n_must int, n_bonus int, must_weight double, bonus_weight double")
    r = matching.scored(df).first()
    assert (r.total_score, r.recommend) == (total, label)


def test_missing_weights_have_defaults_and_zero_counts(spark):
    rows = [(4, 2, 4, 2, None, None), (4, 2, 4, 2, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "n_must_hit int, n_bonus_hit int, n_must int, n_bonus int, must_weight double, bonus_weight double")
    assert [(r.skill_score, r.bonus_score) for r in matching.scored(df).collect()] == [(70, 30), (100, 0)]


GATES = [
    ("", "大专", 0, "", [], ""), ("学历：本科及以上；经验：不作要求", "大专", 0, "", [], "学历"), ("学历：本科及以上", "本科", 0, "", [], ""), ("学历：放宽至大专", "大专", 0, "", [], ""),
    ("学历：本科", "大专", 0, "", [], ""), ("学历：硕士", None, 0, "", [], "学历"), ("经验：5年及以上", "本科", 3, "", [], "经验"), ("经验：3年或5年", "本科", 4, "", [], ""), ("经验：3-5年", "本科", 4, "", [], "经验"), ("经验：应届可，3年", "本科", 0, "", [], ""),
    ("证书：高压电工证", "本科", 0, "", [], "证书"), ("证书：高压电工证", "本科", 0, "", ["高压电工证"], ""), ("证书：PMP优先", "本科", 0, "", [], ""), ("证书：不作硬性要求", "本科", 0, "", [], ""),
]


@pytest.mark.parametrize("gate, edu, years, certs, skills, why", GATES)
def test_gates(spark, gate, edu, years, certs, skills, why):
    df = spark.createDataFrame([(gate, edu, years, certs, skills)], "g string, e string, y int, c string, s array<string>")
    none = F.lit(None).cast("string")
    got = df.select(matching.gate_reasons(none, F.col("e"), F.col("y"), F.col("c"), F.col("s"), none, F.col("g")).alias("w")).first().w
    assert [w[:2] for w in got] == ([why] if why else [])


def test_other_org_is_a_veto_only_if_both_are_named(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("", "b"), (None, "b")], "x string, y string")
    assert [r[0] for r in df.select(gates.other_org(F.col("x"), F.col("y"))).collect()] == [True, False, False, False]


def test_match_equals_nested_loop(spark):
    rnd = random.Random(1)
    vocab = ["PLC", "PLC编程", "CAD", "暖通", "空调系统", "成本控制", "成本管控", "会计", "单晶炉", "光伏设备"]
    cands = [(k, rnd.choice(["x", "y", None]), rnd.choice(["本科", "大专", None]), rnd.randint(0, 6)) for k in range(40)]
    have = {k: set(rnd.sample(vocab, rnd.randint(0, 4))) for k in range(40)}
    jobs = [(f"j{k}", rnd.choice(["x", "y", None]), rnd.choice(["", "学历：本科及以上", "经验：3年以上"]), rnd.choice([None, 1.0, 0.5]), rnd.choice([None, 0.0, 0.5])) for k in range(12)]
    need = [(j[0], s, p + 1, rnd.choice(vocab)) for j in jobs for s in ("must", "bonus") for p in range(rnd.randint(0, 4))]
    got = matching.match(
        spark.createDataFrame(cands, "rid int, org string, education string, years int"), spark.createDataFrame([(k, w) for k, ws in have.items() for w in ws], "rid int, word string"),
        spark.createDataFrame(jobs, "job_id string, org string, hard_gates string, must_weight double, bonus_weight double"), spark.createDataFrame(need, "job_id string, side string, pos int, word string"),
        *matching.dictionary(spark),
    )
    want = set()
    for rid, org, edu, years in cands:
        for j, jorg, g, mw, bw in jobs:
            if org and jorg and org != jorg or "本科及以上" in g and edu != "本科" or "3年" in g and years < 3:
                continue
            score = 0
            for side, w in (("must", 0.7 if mw is None else mw), ("bonus", 0.3 if bw is None else bw)):
                words = [n[3] for n in need if n[0] == j and n[1] == side]
                hits = sum(any(py_hit(c, n) for c in have[rid]) for n in words)
                score += round(100 * w * (hits / len(words))) if words else 0
            if score >= 20:
                want.add((rid, j, score))
    assert {(r.rid, r.job_id, r.total_score) for r in got.collect()} == want


def test_match_vetoes_missing_certificates_and_flags_majors(spark):
    rnd = random.Random(2)
    vocab = ["PLC", "PLC编程", "暖通", "空调系统", "会计", "单晶炉", "高压电工证", "持焊工证"]
    # gate text, its certificates, its major and the words of it
    gate_texts = [
        ("", [], "", []), ("证书：高压电工证", ["高压电工证"], "", []), ("学历：本科；证书：高压电工证、焊工证等；专业：暖通（机械）", ["高压电工证", "焊工证"], "暖通（机械）", ["暖通", "机械"]),
        ("证书：PMP优先", [], "", []), ("专业：光伏设备", [], "光伏设备", ["光伏设备"]), ("证书：不作硬性要求；专业：会计、财务", [], "会计、财务", ["会计", "财务"]), (None, [], "", []),
    ]
    cands = [(k, None, "本科", 3, rnd.choice([None, "", "高压电工证", "高压电工证、焊工证"]), rnd.choice([None, "", "机械", "财务", "物理"])) for k in range(60)]
    have = {k: set(rnd.sample(vocab, rnd.randint(1, 5))) for k in range(60)}
    jobs = [(f"j{k}", None, g[0], 1.0, 0.0) for k, g in enumerate(gate_texts)]
    need = [(j[0], "must", p + 1, w) for j in jobs for p, w in enumerate(("PLC", "暖通", "会计"))]
    tables = [
        spark.createDataFrame(cands, "rid int, org string, education string, years int, certificates string, major string"), spark.createDataFrame([(k, w) for k, ws in have.items() for w in ws], "rid int, word string"),
        spark.createDataFrame(jobs, "job_id string, org string, hard_gates string, must_weight double, bonus_weight double"), spark.createDataFrame(need, "job_id string, side string, pos int, word string"),
    ]

    def want(known):
        out = set()
        for rid, _, _, _, certs, major in cands:
            certs, major = (certs, major) if known else (None, None)
            pool = (certs or "") + "|" + "|".join(have[rid])
            hits = sum(any(py_hit(c, n) for c in have[rid]) for n in ("PLC", "暖通", "会计"))
            for (j, *_), (_, asked, s, words) in zip(jobs, gate_texts):
                auto = any(py_hit(c, w) for c in have[rid] for w in words) or bool(major) and major in s
                if hits and all(c in pool for c in asked):
                    out.add((rid, j, round(100 * hits / 3), bool(s) and not auto))
        return out

    for known in (True, False):
        c = tables[0] if known else tables[0].drop("certificates", "major")
        got = matching.match(c, *tables[1:], *matching.dictionary(spark)).collect()
        assert {(r.rid, r.job_id, r.total_score, r.major_review) for r in got} == want(known) and len(got) == len(want(known))
        assert {x[3] for x in want(known)} == {True, False}
    assert len({(r, j) for r, j, *_ in want(True)}) < len(cands) * len(jobs)
    lost = spark.createDataFrame([([],), (["焊工证"],)], "lost array<string>")
    one = F.lit(1)
    assert [r[0] for r in lost.select(matching.gate(F.lit("a"), one, one, F.lit("a"), one, one, F.col("lost"))).collect()] == [True, False]


def test_evidence_and_grants(spark):
    need = spark.createDataFrame([("j", "must", k + 1, w) for k, w in enumerate(["设备维修", "点检管理", "备件管理", "安全管理"])] + [("j", "bonus", 1, "光伏")], "job_id string, side string, pos int, word string")
    have = spark.createDataFrame([(1, "设备维修"), (1, "点检管理")], "rid int, need string")
    jobs = spark.createDataFrame([("j", 1.0, 0.0)], "job_id string, must_weight double, bonus_weight double")
    grants = [
        ("j", 1, 1, "must", "备件管理", "有依据"), ("j", 1, 2, "must", "备件管理", "再次"), ("j", 1, 3, "must", "设备维修", "已命中"), ("j", 1, 4, "must", "焊接", "不在词表"),
        ("j", 1, 5, "must", "安全管理", "  "), ("j", 1, 6, "other", "安全管理", "x"),
    ]
    g = spark.createDataFrame(grants, "job_id string, rid int, ord int, side string, item string, basis string")
    valid, invalid = matching.valid_grants(g, need, have)
    assert [(r["item"], r.basis) for r in valid.collect()] == [("备件管理", "有依据")]
    assert sorted((r.ord, r.reason) for r in invalid.collect()) == [(4, "item"), (5, "basis"), (6, "side")]
    v = spark.createDataFrame([("j", 1, True), ("j", 2, False)], "job_id string, rid int, keep boolean")
    got = {r.rid: r for r in matching.rescored(v, jobs, need, have, g).collect()}
    assert got[1].total_score == 75 and got[1].recommend == "待定" and got[2].total_score is None
    e = spark.createDataFrame([(["a", "b"], ["c"])], "h array<string>, m array<string>")
    said = e.select(matching.evidence(F.col("h"), F.lit(2), F.lit(3), F.lit(0), F.lit(1), F.col("m"))).first()[0]
    assert said == "语义匹配：必备2/3（a、b）；加分0/1；未命中：c"


def test_tokens(spark):
    df = spark.createDataFrame([("甲、乙,丙，丁;戊；己/庚",), (None,), ("　 、",)], "s string")
    assert [r[0] for r in df.select(text.tokens(F.col("s"))).collect()] == [list("甲乙丙丁戊己庚"), [], []]
    lists = spark.createDataFrame([(["a", None, " "],)], "s array<string>")
    assert lists.select(text.list_tokens(F.col("s"))).first()[0] == ["a", "None"]


def test_words_within_words_equal_the_loop(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("ab电工c ") for _ in range(rnd.randint(0, 7))) for _ in range(120)] + ["x" * 3000 + "abc"]
    s, lo = words[:60] + ["abc", "zz"], words[40:]
    got = sorted(map(tuple, matching.contained(spark.createDataFrame([(w,) for w in s], "w string"), spark.createDataFrame([(w,) for w in lo], "w string")).collect()))
    assert got == sorted({(a, b) for a in s for b in lo if a and b and a in b})


@pytest.mark.parametrize("common", [0.0, 0.25, 2.0])
def test_common_words_form_no_pair_but_count(spark, monkeypatch, common):
    monkeypatch.setattr(matching, "COMMON", common)
    rnd = random.Random(7)
    vocab = [f"w{k}q" for k in range(12)]
    have = {k: {w for n, w in enumerate(vocab) if rnd.random() < (0.8 if n < 4 else 0.15)} for k in range(60)}
    jobs = [(f"j{k}", "", rnd.choice([None, 1.0, 0.4]), rnd.choice([None, 0.0])) for k in range(15)]
    need = [(j, side, p, w) for j, *_ in jobs for side, n in (("must", rnd.randint(1, 6)), ("bonus", rnd.randint(0, 4))) for p, w in enumerate(rnd.choices(vocab, k=n), 1)]
    c = spark.createDataFrame([(k, None, None, 0) for k in have], "rid int, org string, education string, years int")
    ct = spark.createDataFrame([(k, w) for k, ws in have.items() for w in ws], "rid int, word string")
    j = spark.createDataFrame([(i, None, g, m, b) for i, g, m, b in jobs], "job_id string, org string, hard_gates string, must_weight double, bonus_weight double")
    nt = spark.createDataFrame(need, "job_id string, side string, pos int, word string")
    got = {(r.rid, r.job_id): r for r in matching.match(c, ct, j, nt, *matching.dictionary(spark), lists=True).collect()}
    want = {}
    for i, _, m, b in jobs:
        words = {side: [w for x, s, _, w in need if x == i and s == side] for side in ("must", "bonus")}
        for k, ws in have.items():
            hit = {side: [w for w in words[side] if w in ws] for side in words}
            s, t = (round(100 * w * (len(hit[x]) / len(words[x]))) if words[x] else 0 for x, w in (("must", 0.7 if m is None else m), ("bonus", 0.3 if b is None else b)))
            if s + t >= 20:
                want[k, i] = (len(hit["must"]), len(hit["bonus"]), s + t, hit["must"], [w for w in words["must"] if w not in ws], hit["bonus"])
    assert {p: (r.n_must_hit, r.n_bonus_hit, r.total_score, r.must_hits, r.must_miss, r.bonus_hits) for p, r in got.items()} == want

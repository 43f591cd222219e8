"""Queries of the composed plans: files, refinement, corrections, coverage, schema, reports, the queue as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import SQL_NEAR, SQL_POOL, cands, cte, fixture, jobs, must_words, pool, query, t, views
from .catalog_parsing import lines, pick
from .functions import normalize as norm
from .functions import values as V
from .operators import coverage, matching, stats, tables
from .plans import chain, refinement
from .plans.shared import open_at, scratch
from .schema import JOB, PERM
from .sources import files, sinks
from .sources.files import BODY
from .streaming import drain

NOW = 1700000000000

# --- files ---


def _docx(body: str) -> bytes:
    import html
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(BODY, "".join(f"<w:p><w:r>{html.escape(x, quote=False)}</w:r></w:p>" for x in body.split("\n")))
    return out.getvalue()


def _pdf(body: str) -> bytes:
    import zlib

    shown = b" 0 -12 Td ".join(b"<%s> Tj" % x.encode("utf-16-be").hex().encode() for x in body.split("\n"))
    raw = zlib.compress(b"BT /F 12 Tf " + shown + b" ET")
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F 5 0 R >> >> >>",
        b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(raw), raw), b"<< /Type /Font /Subtype /Type0 /Encoding /UniGB-UTF16-H >>",
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


#: Kinds of the files that documents are written as, by their id; the last are damaged.
KINDS = ("txt", "md", "docx", "pdf", "gif", "docx")


def written_files(df: DataFrame, folder: str) -> int:
    """Writes each row of doc_id, text as a file of a kind of KINDS; how many."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k, body in zip(*(c.to_pylist() for c in b.columns)):
                kind, body = KINDS[k % len(KINDS)], body or ""
                data = b"PK damaged" if k % len(KINDS) == 5 else {"docx": _docx, "pdf": _pdf}.get(kind, str.encode)(body)
                with open_at(f"{folder}/{k:012d}.{kind.upper() if k % 7 == 0 else kind}", "wb") as f:
                    f.write(data)
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    df.sparkSession.range(0).write.parquet(f"{folder}")  # makes the folder wherever it is
    return df.select("doc_id", "text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def read_files(spark, sf) -> DataFrame:
    folder = scratch(spark, "files")
    written_files(t(spark, sf, "documents"), folder)
    return files.texts(files.listing(spark, folder))


SQL_FILES = f"""
WITH d AS (SELECT doc_id, doc_id % 6 AS k, lpad(doc_id::VARCHAR, 12, '0') || '.' || CASE WHEN doc_id % 7 = 0 THEN upper([{', '.join(f"'{x}'" for x in KINDS)}][doc_id % 6 + 1]) ELSE [{', '.join(f"'{x}'" for x in KINDS)}][doc_id % 6 + 1] END AS file, coalesce(text, '') AS text FROM documents),
x AS (SELECT *, CASE k WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN text || chr(10) WHEN 3 THEN array_to_string(list_filter(string_split(text, chr(10)), lambda l: l <> ''), chr(10)) || chr(10) END AS body FROM d),
y AS (SELECT *, k = 5 OR k IN (2, 3) AND NOT regexp_matches(body, '[^\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]') AS failed FROM x)"""


@query(SQL_FILES + " SELECT file, md5(CASE WHEN NOT failed THEN body END) AS text_md5, k = 4 AS needs_ocr, failed FROM y")
def file_texts(spark, sf):
    return read_files(spark, sf).select("file", F.md5("text").alias("text_md5"), "needs_ocr", F.col("error").isNotNull().alias("failed"))


@query(SQL_FILES + " SELECT i, split_part(lower(file), '.', 2) AS kind FROM (SELECT row_number() OVER (ORDER BY file) - 1 AS i, file, failed FROM y) WHERE failed")
def file_failures(spark, sf):
    got = files.failures(read_files(spark, sf))
    return got.select(F.col("i").cast("long").alias("i"), F.when(F.col("error").startswith("docx"), "docx").otherwise(F.regexp_extract("error", "^([a-z]+)", 1)).alias("kind"))


@query("SELECT (o_custkey % 6)::INT AS part, o_orderkey, o_orderstatus FROM orders")
def json_parts(spark, sf):
    o = t(spark, sf, "orders").select((F.col("o_custkey") % 6).cast("int").alias("part"), "o_orderkey", "o_orderstatus")
    at = scratch(spark, "parts")
    sinks.write_parts(o, at)
    return files.payloads(spark, at, "o_orderkey long, o_orderstatus string, part int", lines=True).select("part", "o_orderkey", "o_orderstatus")


@query(f"""
WITH d AS (SELECT n_name AS department, count(*) FILTER (s_suppkey % 3 = 0) AS n_open, count(*) AS n_all FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name),
r AS (SELECT string_agg('<tr><td>' || department || '</td><td>' || n_open || '/' || n_all || '</td><td><i style="width:' || round_even(100.0 * n_all / (SELECT max(n_all) FROM d), 0)::INT || '%"></i></td></tr>', '' ORDER BY n_all DESC, department) AS rows FROM d),
b AS (SELECT string_agg('<tr><td>' || replace(c_name, '#', '&amp;') || '</td><td>J</td><td>' || c_custkey || '</td><td></td></tr>', '' ORDER BY c_custkey DESC) AS rows FROM (SELECT * FROM customer ORDER BY c_custkey DESC LIMIT 5))
SELECT '<!DOCTYPE html><html><head><meta charset="utf-8"></head><body><p>2024</p>' || (SELECT '<div><b>' || count(*) || '</b> 匹配</div><div><b>' || count(*) FILTER (s_suppkey % 2 = 0) || '</b> {V.RECOMMEND[0]}</div>' FROM supplier) || '<table>' || r.rows || '</table><table>' || b.rows || '</table></body></html>' AS html FROM r, b""")
def dashboard_page(spark, sf):
    s = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    d = stats.departments(s.select(F.col("n_name").alias("department"), F.when(F.col("s_suppkey") % 3 == 0, V.OPEN_STATUS).alias("status")))
    n = s.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("s_suppkey") % 2 == 0).alias("even")).first()
    best = t(spark, sf, "customer").orderBy(F.desc("c_custkey")).limit(5).select(F.replace("c_name", F.lit("#"), F.lit("&")).alias("name"), F.lit("J").alias("job_name"), F.col("c_custkey").alias("total_score"), F.lit(None).cast("string").alias("evidence"))
    # a page shows aggregates of bounded size
    page = sinks.page({"all": n["all"], "even": n["even"]}, [r.asDict() for r in d.collect()], [r.asDict() for r in best.collect()], "2024")
    return spark.createDataFrame([(page,)], "html string")


# --- refinement ---

SEG = V.RESUME_SEGMENTS
DONE = {
    "ai_structured": lines(f"'{SEG[0]}｜本科 ' || k", f"'{SEG[1]}｜' || k % 9 || '年'", f"'{SEG[2]}｜PLC'", f"'{SEG[3]}｜电气'", f"'{SEG[4]}｜好'"),
    "blank": f"' ' || chr(10) || '{SEG[0]}|本科 ' || k || chr(10) || '{SEG[2]}｜PLC' || chr(10) || '备注｜可出差'",
    "deep": pick("(k * 5)", ["分析", "  分析 ", "", None]),
    "skills": pick("(k * 7 + 1)", ["PLC、CAD", "PLC, CAD", "", None]),
    "years": pick("(k * 3 + 1)", ["3", "约4年", "多年", None, "-2"]),
    "major": pick("(k * 11 + 2)", ["机械", " 电气 ", "", None]),
}
STRUCTURED = f"CASE k % 4 WHEN 0 THEN {DONE['ai_structured']} WHEN 1 THEN {DONE['blank']} WHEN 2 THEN '' END".replace("|| k ||", "|| CAST(k AS STRING) ||").replace("|| k\n", "|| CAST(k AS STRING)\n")


def _done_resumes(spark, sf) -> DataFrame:
    """Rows of readers: one in 13 without a key, one in 11 given twice."""
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    c = c.select("k", F.explode(F.when(F.col("k") % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"))
    return c.select(
        (F.col("k") % 7).cast("int").alias("part"), (F.col("k") * 2 + F.col("again")).alias("position"), F.when(F.col("k") % 13 != 0, F.col("k")).alias("id"), F.expr(STRUCTURED).alias("ai_structured"),
        F.expr(DONE["deep"]).alias("ai_deep"), F.expr(DONE["skills"]).alias("skills"), F.expr(DONE["years"]).alias("years_experience"), F.when(F.col("again") == 1, "x").otherwise(F.expr(DONE["major"])).alias("major"),
    )


def _resume_table(spark, sf) -> DataFrame:
    k, none = F.col("c_custkey"), F.lit(None)
    return t(spark, sf, "customer").where(k % 5 != 4).select(
        k.alias("id"), F.lit("old").alias("ai_extract"), none.cast("string").alias("ai_deep"), F.array(F.lit("旧")).alias("skills"), F.lit(1).cast("long").alias("years_experience"),
        F.lit("旧专业").alias("major"), none.cast("long").alias("ai_refined_at"),
    )


SQL_REFINED = f"""
WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 13 <> 0),
d AS (SELECT k, {STRUCTURED} AS st, {DONE['deep']} AS dp, {DONE['skills']} AS sk, {DONE['years']} AS ye, {DONE['major']} AS mj FROM c),
n AS (SELECT k, CASE k % 4 WHEN 0 THEN st WHEN 1 THEN '{SEG[0]}｜本科 ' || k || chr(10) || '{SEG[1]}｜未提及' || chr(10) || '{SEG[2]}｜PLC' || chr(10) || '备注｜可出差' || chr(10) || '{SEG[3]}｜未提及' || chr(10) || '{SEG[4]}｜未提及' ELSE '' END AS ai_extract,
  trim(coalesce(dp, '')) AS ai_deep, CASE WHEN coalesce(sk, '') = '' THEN '' ELSE 'PLC、CAD' END AS skills, CASE ye WHEN '3' THEN 3 WHEN '约4年' THEN 4 END AS years_experience, nullif(trim(mj), '') AS major,
  CASE WHEN k % 4 = 1 THEN 6 ELSE 0 END + (CASE WHEN dp LIKE ' %' THEN 1 ELSE 0 END) + (CASE WHEN ye IN ('约4年', '多年', '-2') THEN 1 ELSE 0 END) + (CASE WHEN mj IN (' 电气 ', '') THEN 1 ELSE 0 END) + (CASE WHEN sk = 'PLC, CAD' THEN 1 ELSE 0 END) AS n_kinds FROM d),
w AS (SELECT * FROM n WHERE ai_extract <> '' OR ai_deep <> '' OR skills <> '')"""


@query(SQL_REFINED + " SELECT k AS id, ai_extract, ai_deep, skills, years_experience, major, n_kinds FROM w")
def refine_resumes(spark, sf):
    rows, _ = refinement.merged_resumes(_done_resumes(spark, sf))
    return rows.select("id", "ai_extract", "ai_deep", F.array_join("skills", "、").alias("skills"), "years_experience", "major", F.size("kinds").alias("n_kinds"))


@query(SQL_REFINED + """
SELECT k AS id, 'empty' AS reason FROM n WHERE k NOT IN (SELECT k FROM w) UNION ALL SELECT k, 'repeated' FROM c WHERE k % 11 = 0
UNION ALL SELECT NULL, 'no key' FROM customer, range(2) x(i) WHERE c_custkey % 13 = 0 AND (i = 0 OR c_custkey % 11 = 0)""")
def refine_resumes_dropped(spark, sf):
    return refinement.merged_resumes(_done_resumes(spark, sf))[1]


@query(SQL_REFINED + f"""
SELECT c_custkey AS id, coalesce(nullif(ai_extract, ''), 'old') AS ai_extract, nullif(ai_deep, '') AS ai_deep, coalesce(nullif(skills, ''), '旧') AS skills, coalesce(years_experience, 1) AS years_experience, coalesce(major, '旧专业') AS major, CASE WHEN k IS NOT NULL THEN {NOW} END AS ai_refined_at
FROM customer LEFT JOIN w ON k = c_custkey WHERE c_custkey % 5 <> 4""")
def refine_resumes_applied(spark, sf):
    rows, _ = refinement.merged_resumes(_done_resumes(spark, sf))
    out = refinement.applied_resumes(_resume_table(spark, sf), rows, NOW)
    return out.withColumn("skills", F.array_join("skills", "、"))


@query(SQL_REFINED + " SELECT k AS id, CASE WHEN k % 5 = 4 THEN 'gone' ELSE 'empty' END AS kind FROM w WHERE k % 5 = 4 OR k % 6 = 0 AND skills <> ''")
def refine_resumes_verified(spark, sf):
    rows, _ = refinement.merged_resumes(_done_resumes(spark, sf))
    table = refinement.applied_resumes(_resume_table(spark, sf), rows, NOW)
    # one in six has lost its words since
    return refinement.verified(rows, table.withColumn("skills", F.when(F.col("id") % 6 != 0, F.col("skills"))))


@query("""
WITH q AS (SELECT doc_id FROM documents WHERE trim(coalesce(text, '')) <> '' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)),
s AS (SELECT ceil(count(*) / 20.0)::INT AS size FROM q), n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM q)
SELECT doc_id, (k // size + 1)::INT AS part FROM n, s""")
def refine_prepared(spark, sf):
    marks = t(spark, sf, "labels").select(F.col("doc_id").alias("k")).distinct().withColumn("ai_refined_at", F.lit(1))
    d = t(spark, sf, "documents").join(marks, F.col("doc_id") == F.col("k"), "left")
    return refinement.prepared(d.select("doc_id", "text", "ai_refined_at"), F.col("text"), "doc_id").select("doc_id", "part")


JOB_GATE, JOB_MUST, JOB_BONUS = pick("k", ["学历:本科;经验：3年", "", None, "学历：大专"]), pick("(k * 3 + 1)", ["PLC, CAD", "PLC、CAD", "", None]), pick("(k * 7)", ["CAD、SQL", "", "SQL"])
SQL_JOB_DONE = f"""
WITH s AS (SELECT s_suppkey AS k, {JOB_GATE.replace('k %', 's_suppkey %')} AS g, {JOB_MUST.replace('(k', '(s_suppkey')} AS m, {JOB_BONUS.replace('(k', '(s_suppkey')} AS b FROM supplier),
r AS (SELECT k, CASE g WHEN '学历:本科;经验：3年' THEN '学历：本科；经验：3年；专业：不作硬性要求；证书：不作硬性要求；年龄：不作硬性要求' WHEN '学历：大专' THEN '学历：大专；专业：不作硬性要求；经验：不作硬性要求；证书：不作硬性要求；年龄：不作硬性要求' ELSE '' END AS hard_gates,
  CASE WHEN coalesce(m, '') <> '' THEN 'PLC、CAD' ELSE '' END AS must_skills, CASE b WHEN 'CAD、SQL' THEN CASE WHEN coalesce(m, '') <> '' THEN 'SQL' ELSE 'CAD、SQL' END ELSE b END AS bonus_skills FROM s),
w AS (SELECT * FROM r WHERE hard_gates <> '' OR must_skills <> '' OR bonus_skills <> '')"""


def _done_jobs(spark, sf) -> DataFrame:
    s = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    return s.select((F.col("k") % 5).cast("int").alias("part"), F.col("k").alias("position"), F.concat(F.lit("j"), F.col("k").cast("string")).alias("job_id"), F.expr(JOB_GATE).alias("hard_gates"), F.expr(JOB_MUST).alias("must_skills"), F.expr(JOB_BONUS).alias("bonus_skills"))


@query(SQL_JOB_DONE + " SELECT 'j' || k AS job_id, hard_gates, must_skills, bonus_skills FROM w")
def refine_jobs(spark, sf):
    return refinement.merged_jobs(_done_jobs(spark, sf))[0].drop("kinds")


def _job_table(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    return t(spark, sf, "supplier").where(k % 6 != 5).select(
        F.concat(F.lit("j"), k.cast("string")).alias("job_id"), F.concat(F.lit("d"), (k % 3).cast("string")).alias("department"), F.concat(F.lit("n"), k.cast("string")).alias("job_name"),
        F.lit("旧").alias("hard_gates"), F.lit(None).cast("string").alias("must_skills"), F.lit("旧").alias("bonus_skills"), F.lit("旧").alias("org"), F.lit(None).cast("long").alias("ai_refined_at"),
    )


def _job_payload(spark, sf) -> DataFrame:
    """Rows of readers under a job's id, or under its department and name; and one cell that may not be written."""
    k = F.col("position")
    key = F.when(k % 2 == 0, F.col("job_id")).otherwise(F.concat(F.lit("d"), (k % 3).cast("string"), F.lit("|n"), k.cast("string")))
    rows = _done_jobs(spark, sf).where(k % 4 != 3)
    out, _ = refinement.merged_jobs(rows)
    return out.drop("kinds").join(rows.select("job_id", key.alias("key"), F.when(k % 3 == 0, "新").alias("org"), F.lit("x").alias("status_text")), "job_id").drop("job_id")


SQL_SYNCED = SQL_JOB_DONE + """,
p AS (SELECT *, CASE WHEN k % 3 = 0 THEN '新' END AS org FROM w WHERE k % 4 <> 3)"""


@query(SQL_SYNCED + f"""
SELECT 'j' || s_suppkey AS job_id, coalesce(nullif(p.hard_gates, ''), '旧') AS hard_gates, nullif(must_skills, '') AS must_skills, coalesce(nullif(bonus_skills, ''), '旧') AS bonus_skills, coalesce(p.org, '旧') AS org, CASE WHEN p.k IS NOT NULL THEN {NOW} END AS ai_refined_at
FROM supplier LEFT JOIN p ON p.k = s_suppkey WHERE s_suppkey % 6 <> 5""")
def sync_jobs(spark, sf):
    return refinement.synced_jobs(_job_table(spark, sf), _job_payload(spark, sf), NOW)[0].drop("department", "job_name")


@query(SQL_SYNCED + " SELECT CASE WHEN k % 2 = 0 THEN 'j' || k ELSE 'd' || k % 3 || '|n' || k END AS key FROM p WHERE k % 6 = 5")
def sync_jobs_unmatched(spark, sf):
    return refinement.synced_jobs(_job_table(spark, sf), _job_payload(spark, sf), NOW)[1]


def _corrections(spark, sf) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    name, phone = F.concat(F.lit("n"), (k % 400).cast("string")), (k + 13000000000).cast("string")
    c = t(spark, sf, "customer")
    table = c.where(k % 4 != 3).select(k.alias("id"), name.alias("name"), F.when(k % 2 == 0, phone).alias("phone"), F.lit("旧").alias("school"), F.array(F.lit("旧")).alias("skills"), F.lit(None).cast("long").alias("ai_refined_at"))
    payload = c.where(k % 10 == 1).select(F.concat(F.lit("n"), (k % 400).cast("string")).alias("key"), k).unionByName(c.where(k % 10 == 2).select(phone.alias("key"), k))
    payload = payload.groupBy("key").agg(F.max("c_custkey").alias("k"))
    payload = payload.select("key", F.lit(None).cast("string").alias("name"), F.when(F.col("k") % 3 != 0, "新校").otherwise("").alias("school"), F.array(F.lit("PLC")).alias("skills"))
    return table, payload


SQL_CORRECTED = """
WITH tab AS (SELECT c_custkey AS id, 'n' || c_custkey % 400 AS name, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey + 13000000000)::VARCHAR END AS phone FROM customer WHERE c_custkey % 4 <> 3),
pay AS (SELECT key, max(k) AS k FROM (SELECT 'n' || c_custkey % 400 AS key, c_custkey AS k FROM customer WHERE c_custkey % 10 = 1 UNION ALL SELECT (c_custkey + 13000000000)::VARCHAR, c_custkey FROM customer WHERE c_custkey % 10 = 2) GROUP BY key),
met AS (SELECT key, k, coalesce((SELECT max(id) FROM tab WHERE phone = key), (SELECT max(id) FROM tab WHERE name = key)) AS found FROM pay)"""


@query(SQL_CORRECTED + """
SELECT id, name, CASE WHEN regexp_matches(key, '^[0-9]+$') THEN key ELSE phone END AS phone, CASE WHEN k % 3 <> 0 THEN '新校' ELSE '旧' END AS school, CASE WHEN key IS NOT NULL THEN 'PLC' ELSE '旧' END AS skills, NULL::BIGINT AS ai_refined_at FROM tab LEFT JOIN met ON found = id""")
def correct_resumes(spark, sf):
    return refinement.corrected(*_corrections(spark, sf))[0].withColumn("skills", F.array_join("skills", "、"))


@query(SQL_CORRECTED + " SELECT key FROM met WHERE found IS NULL")
def correct_resumes_unmatched(spark, sf):
    return refinement.corrected(*_corrections(spark, sf))[1]


@query("SELECT DISTINCT w AS label FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> '' AND w NOT IN ('almond', 'antique')")
def refine_options(spark, sf):
    rows = t(spark, sf, "part").select(F.replace("p_name", F.lit(" "), F.lit("、")).alias("skills"))
    return refinement.options(rows, spark.createDataFrame([("almond",), ("antique",)], "o string"))


# --- coverage ---

SQL_COVERED = SQL_POOL + """,
cov AS (SELECT job_id, pos, word, word IN (SELECT word FROM hit) AS covered FROM need_token WHERE side = 'must'),
ratio AS (SELECT job_id, count(*) FILTER (covered) / count(*) AS ratio FROM cov GROUP BY job_id)"""


@query(views("," + SQL_COVERED + "," + SQL_NEAR + """,
low AS (SELECT cov.job_id, pos, word, covered, near[1] AS best, list(word) OVER (PARTITION BY cov.job_id) AS must FROM cov JOIN ratio USING (job_id) LEFT JOIN near ON need = word WHERE ratio < 0.8),
walk AS (SELECT job_id, 0::BIGINT AS pos, []::VARCHAR[] AS kept, []::VARCHAR[] AS why FROM low GROUP BY job_id
  UNION ALL SELECT job_id, pos, list_append(kept, CASE WHEN cause = '①' THEN best ELSE word END), list_append(why, cause) FROM (
    SELECT walk.job_id, low.pos, kept, why, word, best, CASE WHEN covered THEN '' WHEN best IS NULL THEN '②' WHEN list_contains(must, best) OR list_contains(kept, best) THEN '①撞车' ELSE '①' END AS cause FROM walk JOIN low ON low.job_id = walk.job_id AND low.pos = walk.pos + 1)),
done AS (SELECT job_id, arg_max(kept, pos) AS kept, arg_max(why, pos) AS why FROM walk GROUP BY job_id)
SELECT job_id, array_to_string(kept, '、') AS must_skills, len(list_filter(why, lambda w: w = '①撞车'))::INT AS collisions, array_to_string(why, ',') AS causes, len(list_filter(why, lambda w: w IN ('', '①'))) / len(why) AS post_ratio,
  len(list_filter(why, lambda w: w IN ('', '①'))) / len(why) < 0.8 AS still_low FROM done""").replace("WITH ", "WITH RECURSIVE ", 1))
def emit_fixes(spark, sf):
    return coverage.proposals(pool(spark, sf), must_words(spark, sf), 0.8)


@query(views("," + SQL_POOL + """,
prop AS (SELECT CASE WHEN s_suppkey % 9 = 0 THEN 'x' || s_suppkey ELSE job_id END AS job_id, s_suppkey % 5 = 0 AS bare, job_id AS of FROM job),
each AS (SELECT prop.job_id, pos, word, word IN (SELECT word FROM hit) AS covered FROM prop JOIN need_token n ON n.job_id = of AND side = 'must' WHERE NOT bare AND NOT starts_with(prop.job_id, 'x'))
SELECT job_id, 'unknown' AS problem, NULL::DOUBLE AS ratio, NULL AS missing FROM prop WHERE starts_with(job_id, 'x')
UNION ALL SELECT job_id, 'low', count(*) FILTER (covered) / count(*), string_agg(word, '、' ORDER BY pos) FILTER (NOT covered) FROM each GROUP BY job_id HAVING count(*) FILTER (covered) / count(*) < 0.8"""))
def coverage_precheck(spark, sf):
    j = jobs(spark, sf).select("job_id", "s_suppkey")
    words = must_words(spark, sf).groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "need"))), lambda x: x["need"]), "、").alias("must_skills"))
    payload = j.join(words, "job_id").select(
        F.when(F.col("s_suppkey") % 9 == 0, F.concat(F.lit("x"), F.col("s_suppkey").cast("string"))).otherwise(F.col("job_id")).alias("job_id"), F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(F.col("must_skills")).alias("must_skills")
    )
    return coverage.precheck(payload, j, pool(spark, sf), 0.8)


# --- gates, guards, the queue ---

@query(views(f"""
, p AS (SELECT c.rid, c.education, have_level, c.years, 18 + (c.rid * 7) % 40 AS age, c.org AS cand_org, g.* EXCLUDE (job_id), job.hard_gates FROM level c JOIN gate g ON g.s_suppkey = c.rid % (SELECT count(*) FROM supplier) + (SELECT min(s_suppkey) FROM supplier) JOIN job USING (job_id))
SELECT rid, array_to_string(list_filter([CASE WHEN cand_org <> job_org THEN '组织不一致' END, CASE WHEN need_level > have_level THEN '学历' || coalesce(education, '未知') || '＜要求' || regexp_extract(hard_gates, '学历：([^；]+)', 1) END,
  CASE WHEN years < need_years THEN '经验' || years || '年＜要求' || need_years || '年' END, CASE WHEN contains(hard_gates, '年龄') AND NOT age BETWEEN 25 AND 40 THEN '年龄' || age || '不在25-40岁区间' END], lambda x: x IS NOT NULL), '|') AS reasons FROM p"""))
def match_gate_reasons(spark, sf):
    """Why a candidate fails the gate of the one opening it is compared with, ages included."""
    j = jobs(spark, sf)
    n = j.agg(F.count(F.lit(1)).alias("n"), F.min("s_suppkey").alias("least")).first()
    c = cands(spark, sf).withColumn("of", F.col("rid") % n["n"] + n["least"])
    p = c.join(j.select(F.col("s_suppkey").alias("of"), F.col("org").alias("job_org"), "hard_gates"), "of")
    age = F.lit(18) + (F.col("rid") * 7) % 40
    why = matching.gate_reasons(F.col("org"), F.col("education"), F.col("years"), F.lit(""), F.array().cast("array<string>"), F.col("job_org"), F.col("hard_gates"), age)
    return p.select("rid", F.array_join(why, "|").alias("reasons"))


@query("""
SELECT n_name, CASE WHEN count(*) FILTER (open) = 0 THEN 'no opening is open' WHEN count(*) FILTER (open AND words) = 0 THEN 'no open opening asks for any word' WHEN bool_or(waiting) THEN 'the refinement queue is not empty' ELSE '' END AS refused
FROM (SELECT n_name, n_regionkey, s_suppkey % 4 <> 1 AND n_regionkey <> 1 AS open, n_regionkey <> 2 AS words, n_regionkey = 3 AS waiting FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY n_name""")
def chain_guard(spark, sf):
    """What the guard of the matching chain says of each nation's openings."""
    k = F.col("s_suppkey")
    s = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select("n_name", F.when((k % 4 != 1) & (F.col("n_regionkey") != 1), F.when(k % 2 == 0, V.OPEN_STATUS)).otherwise("已关闭").alias("status"), F.when(F.col("n_regionkey") != 2, "PLC").otherwise(" ").alias("must_skills"), F.col("n_regionkey"))
    return chain.guarded(s, ["n_name"], F.col("n_regionkey") == 3)


@query("SELECT doc_id, length(text) AS n FROM documents WHERE trim(coalesce(text, '')) <> '' AND doc_id % 3 <> 0")
def drain_queue(spark, sf):
    """The queued documents as the stream hands them over, in two runs on one checkpoint."""
    src, seen, at = scratch(spark, "arrivals"), scratch(spark, "drained"), scratch(spark, "drain-checkpoint")
    k = F.col("doc_id")
    d = t(spark, sf, "documents").select("doc_id", "text", F.when(k % 3 == 0, 1).cast("long").alias("ai_refined_at"))
    take = lambda df, n: df.select("doc_id", F.length("text").cast("long").alias("n"), F.lit(n).alias("batch")).write.mode("overwrite").parquet(f"{seen}/batch={n}")
    for part in (k % 2 == 0, k % 2 == 1):
        d.where(part).write.mode("append").parquet(src)
        drain.drain(drain.arrivals(spark, src, d.schema), take, at).awaitTermination()
    return spark.read.schema("doc_id long, n long").parquet(f"{seen}/batch=*").select("doc_id", "n")


# --- payloads, schema, reports ---


@query(f"""
SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'hobby' END, CASE WHEN c_custkey % 5 = 0 THEN 'zodiac' END], lambda x: x IS NOT NULL), ',') AS unknown, c_mktsegment AS org, CASE WHEN c_custkey % 2 = 0 THEN 'PLC' END AS must_skills FROM customer""")
def payload_keys(spark, sf):
    """Keys of payloads that are no columns, and the cells that may be written."""
    k = F.col("c_custkey")
    pairs = [F.struct(F.lit("org").alias("k"), F.col("c_mktsegment").alias("v")), F.struct(F.lit("_note").alias("k"), F.lit("x").alias("v"))]
    pairs += [F.when(k % n == 0, F.struct(F.lit(name).alias("k"), F.lit(v).alias("v"))) for n, name, v in ((2, "must_skills", "PLC"), (3, "hobby", "x"), (5, "zodiac", "y"))]
    p = t(spark, sf, "customer").select("c_custkey", F.map_from_entries(F.array_compact(F.array(*pairs))).alias("m"))
    return p.select("c_custkey", F.array_join(norm.unknown_keys(F.col("m"), tuple(JOB.names)), ",").alias("unknown"), *[F.try_element_at("m", F.lit(c)).alias(c) for c in V.JOB_KEYS if c in ("org", "must_skills")])


@query("SELECT c_custkey, c_name AS name, NULL::VARCHAR AS \"user\", NULL::VARCHAR AS org FROM customer UNION ALL SELECT NULL, NULL, n_name, 'x' FROM nation")
def schema_evolve(spark, sf):
    """Declared columns added, a column renamed and one dropped; rows appended to a table that was created empty."""
    c = tables.drop(tables.rename(t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_name", "name"), "c_acctbal", ["name"])
    perm = tables.create(spark, PERM).unionByName(t(spark, sf, "nation").select(F.col("n_name").alias("user"), F.lit("x").alias("org")))
    return tables.add_missing(c, PERM).unionByName(perm, allowMissingColumns=True)


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN 'part' END AS tab, CASE WHEN p_size % 4 <> 0 THEN p_brand END AS col, CASE WHEN p_size % 4 = 1 THEN p_type END AS new FROM part""")
def column_specs(spark, sf):
    n = F.col("p_size") % 4
    spec = F.when(n == 0, F.col("p_brand")).when(n == 1, F.concat(F.lit(" part : "), "p_brand", F.lit(" = "), "p_type")).when(n == 2, F.concat(F.lit("part:"), "p_brand")).otherwise(F.concat(F.lit("part:"), "p_brand", F.lit("=")))
    return t(spark, sf, "part").select("p_partkey", tables.specs(spec).alias("s")).select("p_partkey", F.col("s.table").alias("tab"), F.col("s.column").alias("col"), "s.new")


@query("""
WITH r AS (SELECT c_custkey, 'name=' || c_name || CASE WHEN c_custkey % 2 = 0 THEN ';phone=' || c_custkey ELSE '' END AS cells FROM customer ORDER BY c_custkey LIMIT 5)
SELECT cells, NULL::BIGINT AS more FROM r UNION ALL SELECT NULL, count(*) - 5 FROM customer""")
def report_summary(spark, sf):
    k = F.col("c_custkey")
    rows = t(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), F.when(k % 2 == 0, k.cast("string")).otherwise("").alias("phone"), F.lit(None).cast("string").alias("school"))
    said = F.array_join(F.transform(F.array_sort(F.map_entries("cells")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return stats.summary(rows, [k]).select(said.alias("cells"), "more")


@query("SELECT count(*) FILTER (o_orderstatus = 'O') AS created, count(*) AS total, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'F') AS other, '' AS error, 'created,total,failed,other,error' AS shown FROM orders")
def report_order(spark, sf):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    r = t(spark, sf, "orders").agg(F.lit("").alias("error"), n("P").alias("failed"), n("F").alias("other"), F.count(F.lit(1)).alias("total"), n("O").alias("created"))
    out = stats.ordered(r)
    return out.withColumn("shown", F.lit(",".join(out.columns)))


# --- repairs ---

SEG3 = ("学历背景", "工作经历", "核心技能")
SEG_LINES = pick("k", ["学历背景｜本科\n工作经历｜5年\n核心技能｜PLC", "学历|本科\n\n核心技能｜CAD\n备注｜可出差", "", "自由文本", "核心技能｜z\n学历背景｜q", "工作经历\n工作经历｜1", " 学历背景 ｜ x \n证书", "甲｜1\n乙", "工作｜2\n经历｜3\n学历背景|"])
SEGMENT_ROWS = [(-1, "学历背景｜本科\n工作经历｜5年\n核心技能｜PLC"), (-2, "学历|本科\n\n核心技能｜CAD\n备注｜可出差"), (-3, ""), (-4, None), (-5, "自由文本")]


def _sql_segments() -> str:
    """The repair for three names, taken step by step: each name its line, then the lines that are left."""
    taken, steps = [], []
    for p, name in enumerate(SEG3):
        free = "[x.i for x in rows" + (" if " + " AND ".join(f"x.i IS DISTINCT FROM k{q}" for q in range(p)) if p else "") + "]"
        exact = f"list_filter({free}, lambda i: rows[i].head = '{name}')[1]"
        loose = f"list_filter({free}, lambda i: rows[i].head <> '' AND (contains(rows[i].head, '{name}') OR contains('{name}', rows[i].head)))[1]"
        steps.append(f"s{p} AS (SELECT *, coalesce({exact}, {loose}) AS k{p} FROM {'s' + str(p - 1) if p else 'l'})")
        taken.append(f"k{p}")
    last = "greatest(0, list_max(list_filter([{p}], lambda p: [k0, k1, k2][p + 1] < i)))".replace("{p}", "0, 1, 2")
    text = lambda i: f"rows[{i}].head || CASE WHEN rows[{i}].body <> '' THEN '｜' || rows[{i}].body ELSE '' END"
    content = " || chr(10) || ".join(
        f"'{name}｜' || CASE WHEN k{p} IS NULL THEN '{V.SEGMENT_ABSENT}' ELSE coalesce(nullif(rows[k{p}].body, ''), '{V.SEGMENT_ABSENT}') END || coalesce(array_to_string(list_transform(list_filter(extra, lambda i: coalesce({last}, 0) = {p}), lambda i: chr(10) || {text('i')}), ''), '')"
        for p, name in enumerate(SEG3)
    )
    return f"""
WITH {cte('given', 'id body', SEGMENT_ROWS)}, src AS (SELECT c_custkey AS id, {SEG_LINES.replace('CASE k', 'CASE c_custkey')} AS body FROM customer UNION ALL SELECT id, body FROM given),
r0 AS (SELECT id, body, list_transform(string_split(body, chr(10)), lambda x: trim(x)) AS every FROM src),
r1 AS (SELECT *, list_filter(every, lambda x: x <> '') AS filled FROM r0),
l AS (SELECT *, list_transform(filled, lambda x, i: {{'i': i, 'head': trim(split_part(replace(x, '|', '｜'), '｜', 1)), 'body': CASE WHEN contains(replace(x, '|', '｜'), '｜') THEN trim(substr(replace(x, '|', '｜'), strpos(replace(x, '|', '｜'), '｜') + 1)) ELSE '' END}}) AS rows FROM r1),
{', '.join(steps)},
e AS (SELECT *, list_filter(range(1, len(rows) + 1), lambda i: i IS DISTINCT FROM k0 AND i IS DISTINCT FROM k1 AND i IS DISTINCT FROM k2) AS extra FROM s2),
o AS (SELECT *, CASE WHEN trim(coalesce(body, '')) = '' THEN '' ELSE {content} END AS text FROM e)
SELECT id, text, CASE WHEN trim(coalesce(body, '')) = '' OR text = body THEN '' ELSE array_to_string(list_concat(list_concat(CASE WHEN len(filled) < len(every) THEN ['blank_lines'] ELSE [] END, CASE WHEN len(list_filter(filled, lambda x: contains(x, '|'))) > 0 THEN ['pipe_fixed'] ELSE [] END),
  list_concat(list_filter([CASE WHEN k0 IS NULL THEN 'seg_filled' END, CASE WHEN k1 IS NULL THEN 'seg_filled' END, CASE WHEN k2 IS NULL THEN 'seg_filled' END], lambda x: x IS NOT NULL), CASE WHEN len(extra) > 0 THEN ['seg_merged'] ELSE [] END)), ',') END AS kinds FROM o"""


@query(_sql_segments())
def segment_repair(spark, sf):
    made = t(spark, sf, "customer").select(F.col("c_custkey").alias("k")).select(F.col("k").alias("id"), F.expr(SEG_LINES).alias("body"))
    rows = made.unionByName(fixture(spark, "id body", SEGMENT_ROWS))
    return rows.withColumn("r", norm.segments(F.col("body"), SEG3)).select("id", "r.text", F.array_join("r.kinds", ",").alias("kinds"))


@query("""
SELECT user_id, count(*) FILTER (NOT bad)::INT AS n_rows, count(*) FILTER (bad)::INT AS n_errors, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (bad), '') AS ids
FROM (SELECT user_id, event_id, user_id % 5 = 0 AND event_id % 7 = 0 AS bad FROM events) GROUP BY user_id""")
def json_batch_salvage(spark, sf):
    """Batches in which some objects have a cell without a value: only those are lost, and their ids are told."""
    k = F.col("event_id").cast("string")
    bad = (F.col("user_id") % 5 == 0) & (F.col("event_id") % 7 == 0)
    p = F.when(bad, F.concat(F.lit('{"id": "'), k, F.lit('", "t": "}{", "v": }'))).otherwise(F.concat(F.lit('{"id": "'), k, F.lit('", "t": "a\\"}"}')))
    batch = t(spark, sf, "events").select("user_id", p.alias("p")).groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("p")), ",\n"), F.lit("]")).alias("raw"))
    r = batch.withColumn("r", norm.salvaged(F.col("raw")))
    ids = F.array_join(F.transform(F.array_sort(F.transform("r.errors", lambda e: e["id"].cast("long"))), lambda x: x.cast("string")), ",")
    return r.select("user_id", F.size("r.rows").alias("n_rows"), F.size("r.errors").alias("n_errors"), ids.alias("ids"))


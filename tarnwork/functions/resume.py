"""Fields of a résumé from its text and file name, as Columns; no row leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import any_in, blank_to_null, none_if_empty, utrim, words_in
from .values import ANYWHERE, CATEGORIES, CITIES, DEGREE_ALIASES, OTHER_CATEGORY, SCHOOLS_211, SCHOOLS_985, SKILLS

# Patterns of the fields; \s and \d of any script, [\u4e00-\u9fff] is Han.
PHONE = r"(?<!\d)(1[3-9]\d{9})(?!\d)"
PHONE_PARTS = r"(?U)(?<!\d)(1[3-9]\d)[\s\-](\d{4})[\s\-](\d{4})(?!\d)"
EMAIL = r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})"
NAME = r"(?U)(?:姓\s*名|Name)\s*[:：]\s*([\u4e00-\u9fff]{2,4}|[A-Za-z\u4e00-\u9fff·]{2,20})"
YEARS = (
    r"(?U)(?<!\d)(\d{1,2})\s*年(?:以上)?[^\n。，,；;]{0,12}?经[历验]|工作\s*(\d{1,2})\s*年(?![份级])|(?<!\d)(\d{1,2})\s*年\s*(?:以上|\+|工作)|经[历验]\s*[:：]?\s*(\d{1,2})\s*年(?!\s*(?:毕|届))",
    r"(?U)工作年限\s*[:：]?\s*(\d{1,2})\s*年|(\d{1,2})\s*年\s*\+",
)
YEARS_IN_NAME = r"(?U)(?<!\d)(\d{1,2})\s*年(?!\s*(?:毕业|届|底|初|中|份|度|级))"
SALARY = r"(?U)(?:期望薪[资酬]|薪[资酬]|月薪|待遇)\s*[:：]?\s*(\d+(?:\.\d+)?\s*[Kk千万]?\s*[-~～至]\s*\d+(?:\.\d+)?\s*[Kk千万]?\s*[元/月]*|面议|[\d.]+\s*[Kk](?!\s*[-~～至]))|(\d+(?:\.\d+)?\s*[-~～]\s*\d+(?:\.\d+)?\s*[Kk])"
CITY = r"(?:期望|意向|工作|现居|居住|所在地|城市|地点)[^\n]{0,12}?(" + "|".join(sorted(CITIES, key=len, reverse=True)) + ")"
DEGREE = r"(?U)(?:学\s*历|学位|文化程度)\s*[:：|]?\s*(?:是|为)?\s*(博士|硕士研究生|硕士|研究生|大学本科|统招本科|全日制本科|本科|学士|大专|大学专科|专科|高职)"
ANY_DEGREE = r"(博士|硕士|研究生|本科|学士|大专|专科|高职|中专)"
SCHOOL = r"([\u4e00-\u9fff]{2,14}(?:职业技术学院|高等专科学校|技师学院|大学|学院))"
SCHOOL_LABEL = r"(?U)(?:毕业院校|毕业学校|学校名称|就读学校|院校)\s*[:：|]?\s*([^\n；;，,。|：:]{2,30})"
SCHOOL_NOISE = r"毕业于|就读于|毕业自|结业于|就读|入读|考取|参加|升学|本科|大专|硕士|博士|研究生|中专|高职|全日制|统招|成人"
SCHOOL_ENDS = ("大学", "学院", "学校")
NO_SCHOOL = ("主要参加学院", "主要学院", "宁夏", "学院", "大学", "学校")
MAJOR = r"(?U)(?:专\s*业(?:名称)?|所学专业|主修专业|主修)(?:\s*[:：|/｜]\s*|\s*\n\s*|\s+)([\u4e00-\u9fffA-Za-z]{2,20})"
MAJOR_ROW = r"(?U)(?:大学|学院|学校)\s*[|｜/]\s*([\u4e00-\u9fffA-Za-z（）()]{2,20})\s*[|｜/]\s*(?:本科|大专|硕士|博士|研究生|专科)"
NO_MAJOR = ("课程", "基础扎实", "培训", "大专", "本科", "知识", "技能", "技术", "能力", "方向", "相关", "学习", "理论")
NO_NAME = (
    "自我评价 专业技能 技能证书 核心优势 优势亮点 姓名 名字 本科 大专 硕士 博士 研究生 专科 中专 学历 教育背景 工作经历 工作经验 项目经历 项目经验 求职意向 "
    "期望岗位 基本信息 个人信息 联系方式 荣誉证书 获奖情况 培训经历 证书 简介 云南 四川 贵州 广西 湖南 湖北 河南 河北 山东 山西 陕西 甘肃 宁夏 青海 新疆 西藏 "
    "内蒙 辽宁 吉林 广东 江苏 浙江 安徽 福建 江西 海南 北京 上海 天津 重庆 暖通 电工 焊工 会计 出纳 司机 普工 工程师"
).split()
POSITION = r"(?U)(?:期望|意向|应聘|求职|目标)\s*(?:岗位|职位|职务|意向)?\s*[:：]\s*([\u4e00-\u9fffA-Za-z/、（）() ]{2,25})"
POSITION_END = r"(?U)\s+|(?=应聘|期望薪|期望工资|求职类型)"
CERTIFICATE = (
    r"(注册安全工程师|注册电气工程师|注册消防工程师|建造师|高压电工证|低压电工证|电工证|焊工证|特种作业操作证|特种作业证|特种作业|注册会计师|中级会计师|初级会计(?:职称|资格)?|会计从业|教师资格证|"
    r"法律职业资格|PMP|CFA|CPA|软考|系统分析师|六级|四级|CET-?\d?)"
)
LOWER_SCHOOL, HIGHER_SCHOOL = r"职业技术学院|技师学院|高等专科|专科学校", r"大学|学院"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
MOST_SKILLS, POSITION_LENGTH, HEAD_LINES = 15, 40, 6


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, trimmed; null for none."""
    return blank_to_null(F.regexp_extract(text, pattern, group))


def where(text: Column, words, value: Column) -> Column:
    """value where the text holds one of the words, without which its pattern cannot match; a plain search is far cheaper."""
    return F.when(any_in(text, words), value)


def first_group(text: Column, pattern: str, groups: int) -> Column:
    """Whichever group of the first match took part."""
    return F.coalesce(*[none_if_empty(F.regexp_extract(text, pattern, g)) for g in range(1, groups + 1)])


def bare_name(filename: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(F.coalesce(filename, F.lit("")), r"(?s)(?<=.)\.[^.]*$", "")


def phone(text: Column) -> Column:
    parts = F.concat(*[F.regexp_extract(text, PHONE_PARTS, g) for g in (1, 2, 3)])
    return F.coalesce(found(text, PHONE), F.when(text.rlike("1[3-9]"), none_if_empty(parts)))


def email(text: Column) -> Column:
    return where(text, "@", found(text, EMAIL))


def _is_name(c: Column) -> Column:
    return c.rlike(r"^[\u4e00-\u9fff]{2,4}$") & ~c.isin(*NO_NAME)


def name_in_file(filename: Column) -> Column:
    """The first part of a file name that is a name; bracketed blocks and leading titles are left out."""
    base = F.regexp_replace(bare_name(filename), r"[【\[][^】\]]*[】\]]", " ")
    base = F.regexp_replace(F.regexp_replace(base, r"^(个人简历|简历|附件\d*[:：]?)", ""), r"^[-_－ ]+|[-_－ ]+$", "")
    parts = F.transform(F.split(base, r"(?U)[－\-_—\s]+"), lambda p: utrim(F.regexp_replace(p, r"^[\d【】\[\]()（）]+|[\d【】\[\]()（）.].*$", "")))
    return F.get(F.filter(parts, _is_name), F.lit(0))


def name_in_head(text: Column) -> Column:
    """One of the first lines, if it is a name by itself."""
    lines = F.slice(F.split(text, LINE_END, HEAD_LINES + 1), 1, HEAD_LINES)
    return F.get(F.filter(F.transform(lines, lambda x: F.regexp_replace(utrim(x), r"(?U)^\s*[-\d个人简历]+\s*", "")), _is_name), F.lit(0))


def years(text: Column, filename: Column) -> Column:
    strict, loose = where(text, "年", first_group(text, YEARS[0], 4)), where(text, "年", first_group(text, YEARS[1], 2))
    return F.coalesce(strict, loose, found(bare_name(filename), YEARS_IN_NAME)).try_cast("int")


def degree(word: Column) -> Column:
    """The level that a word names, by the first alias that it holds; null for none."""
    out = None
    for level, aliases in DEGREE_ALIASES:
        hit = any_in(word, aliases)
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out


def picked_school(c: Column) -> Column:
    """A candidate without verbs and degrees; null if what is left is no name."""
    c = utrim(F.regexp_replace(c, SCHOOL_NOISE, ""))
    return F.when((c != "") & ~c.isin(*NO_SCHOOL), F.coalesce(found(c, SCHOOL), c))


def school_rank(of_school: Column, degree_: Column) -> Column:
    """The longer list is tried first; a name of both lists counts as the higher one."""
    s = F.coalesce(of_school, F.lit(""))
    first = F.get(F.filter(F.array(*map(F.lit, SCHOOLS_211)), lambda x: F.contains(s, x)), F.lit(0))
    e = F.coalesce(degree_, F.lit(""))
    return (
        F.when(first.isin(*SCHOOLS_985), "985").when(first.isNotNull(), "211").when(any_in(s, SCHOOLS_985), "985").when(e == "大专", "大专").when(e != "", "普通本科").otherwise("")
    )


def certificates(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(CERTIFICATE), F.lit(1))))


def skills(text: Column) -> Column:
    return F.slice(words_in(text, SKILLS), 1, MOST_SKILLS)


def category(of_position: Column, of_skills: Column) -> Column:
    hay = F.concat(F.coalesce(of_position, F.lit("")), F.lit(" "), F.array_join(F.coalesce(of_skills, F.array().cast("array<string>")), " "))
    out = None
    for label, words in CATEGORIES:
        out = F.when(any_in(hay, words), label) if out is None else out.when(any_in(hay, words), label)
    return out.otherwise(OTHER_CATEGORY)


FIELDS = (
    "name", "phone", "email", "education", "school", "school_rank", "years_experience", "major", "certificates", "expected_position", "expected_location",
    "expected_salary", "skills", "category",
)


def parsed(df: DataFrame, text_col: str, file_col: str) -> DataFrame:
    """df with all fields. Each pattern runs once over the text; what builds on a match is a later projection."""
    own = [c for c in df.columns if c not in FIELDS]
    t, f = F.col("__t"), F.col(file_col)
    df = df.withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumns({
        "phone": phone(t), "email": email(t), "__label": where(t, ("姓", "Name"), found(t, NAME)), "years_experience": years(t, f),
        "expected_salary": where(t, ("薪", "待遇", "K", "k"), F.coalesce(found(t, SALARY), found(t, SALARY, 2))),
        "expected_location": F.coalesce(where(t, CITIES, found(t, CITY)), F.lit(ANYWHERE)), "__degree": where(t, ("学", "文化程度"), found(t, DEGREE)), "__any": found(t, ANY_DEGREE),
        "__school": F.coalesce(where(t, ("院校", "学校"), found(t, SCHOOL_LABEL)), where(t, SCHOOL_ENDS, found(t, SCHOOL))),
        "__major": F.coalesce(where(t, ("专", "主修"), found(t, MAJOR)), where(t, SCHOOL_ENDS, found(t, MAJOR_ROW))),
        "certificates": certificates(t), "__position": where(t, ("期望", "意向", "应聘", "求职", "目标"), F.get(F.split(found(t, POSITION), POSITION_END), F.lit(0))), "skills": skills(t),
    })
    df = df.withColumns({
        "name": F.coalesce(F.when(~F.col("__label").isin(*NO_NAME), F.col("__label")), name_in_file(f), name_in_head(t)),
        "__first": picked_school(F.col("__school")),
        "major": F.when(~F.col("__major").rlike("^(?:" + "|".join(NO_MAJOR) + ")"), F.col("__major")),
        "expected_position": none_if_empty(F.substring(F.regexp_replace("__position", "[：:，,。].*$", ""), 1, POSITION_LENGTH)),
    })
    # a candidate that is none is looked for once more in the text without verbs and degrees
    df = df.withColumn("__second", F.when(F.col("__first").isNull() & any_in(t, SCHOOL_ENDS), found(F.regexp_replace(t, SCHOOL_NOISE, " "), SCHOOL)))
    df = df.withColumn("school", F.coalesce("__first", picked_school(F.col("__second"))))
    by_school = F.when(F.col("school").rlike(LOWER_SCHOOL), "大专").when(F.col("school").rlike(HIGHER_SCHOOL), "本科")
    df = df.withColumn("education", F.coalesce(degree(F.col("__degree")), degree(F.col("__any")), by_school))
    df = df.withColumns({"school_rank": school_rank(F.col("school"), F.col("education")), "category": category(F.col("expected_position"), F.col("skills"))})
    return df.select(*own, *FIELDS)


def derived(row: dict[str, Column]) -> dict[str, Column]:
    """The derived fields of a record filled by hand: only those that are blank, but the education by its alias."""
    e = F.coalesce(degree(row["education"]), row["education"])
    return row | {
        "education": e,
        "school_rank": F.coalesce(none_if_empty(row["school_rank"]), none_if_empty(school_rank(row["school"], e))),
        "category": F.coalesce(none_if_empty(row["category"]), category(row["expected_position"], row["skills"])),
        "expected_location": F.coalesce(blank_to_null(row["expected_location"]), F.lit(ANYWHERE)),
    }

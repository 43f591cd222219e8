"""Matching of candidates and openings: token hits, gates, scores, evidence, grants.

Whether a candidate's word satisfies an opening's word depends on the two words alone. So hits are computed once per
pair of distinct words. Candidates with their hits then meet the openings of their organisation in blocks, as bitmaps (blocks.py):
statistics come from counts without any pair being formed, and only pairs that reach the least total become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import gates
from ..functions.text import none_if_empty
from ..functions.values import BONUS_WEIGHT, HYPERNYMS, LEAST_TOTAL, MOST_HITS, MOST_MISSES, MUST_WEIGHT, NOTHING, PENDING_FROM, RECOMMEND, RECOMMEND_FROM, SYNONYMS, SYSTEM_SOURCE
from ..plans.shared import written
from . import blocks


def dictionary(spark, synonyms=SYNONYMS, hypernyms=HYPERNYMS) -> tuple[DataFrame, DataFrame]:
    """(word, group) and (need, word) as tables."""
    syn = [(w, k) for k, group in enumerate(synonyms) for w in group]
    hyp = [(n, w) for n, words in hypernyms.items() for w in words]
    return spark.createDataFrame(syn, "word string, grp int"), spark.createDataFrame(hyp, "need string, word string")


#: Characters of the parts by which words within words are found.
PART = 3


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """Distinct pairs (short, long) of words where the first lies within the second, by equi-joins only.

    Long words are indexed by their parts of up to PART characters, so that the index grows as their length; a short word is looked up
    by the rarest of its own parts only, then compared. Empty words pair with nothing.
    """
    s, lo = short.toDF("short").where("short <> ''").distinct(), long.toDF("long").where("long <> ''").distinct()
    parts = lambda c, n: F.array_distinct(F.expr(f"transform(sequence(1, length({c}) - {n} + 1), p -> substring({c}, p, {n}))"))
    size = f"least(length(short), {PART})"
    own = s.select("short", F.explode(parts("short", size)).alias("part"))
    every = [lo.where(F.length("long") >= n).select("long", F.explode(parts("long", n)).alias("part")) for n in range(1, PART + 1)]
    index = every[0]
    for more in every[1:]:
        index = index.unionByName(more)
    index = index.join(own.select("part").distinct(), "part")
    n = index.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # a part that no long word has says that there is none
    rarest = own.join(n, "part", "left").groupBy("short").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part")).alias("x")).where("x.n > 0")
    return rarest.select("short", F.col("x.part").alias("part")).join(index, "part").where(F.contains("long", F.col("short"))).select("short", "long").distinct()


def token_hits(words: DataFrame, needs: DataFrame, synonyms: DataFrame, hypernyms: DataFrame, few: bool = False) -> DataFrame:
    """Distinct word x need pairs that hit: equal, one in the other, one synonym group, or need above word.

    words: word; needs: need. All four are equi-joins over distinct words; few: words are at most some thousand, which are compared with each need.
    """
    if few:
        w, n = F.broadcast(words.select("word").distinct()), needs.select("need").distinct()
        inside = n.where("need <> ''").crossJoin(w.where("word <> ''")).where(F.contains("word", "need") | F.contains("need", "word"))
    else:
        # vocabularies are read several times, so they are computed once
        w, n = written(words.select("word").distinct(), "words"), written(needs.select("need").distinct(), "needs")
        inside = contained(n, w).toDF("need", "word").select("word", "need").unionByName(contained(w, n).toDF("word", "need"))
    groups = synonyms.groupBy("word").agg(F.array_sort(F.collect_set("grp")).alias("groups"))
    left = w.join(groups, "word")
    right = n.join(groups.withColumnRenamed("word", "need").withColumnRenamed("groups", "of_need"), "need")
    same = left.join(right, F.col("groups") == F.col("of_need"))
    above = n.join(hypernyms, "need").join(w, "word")
    parts = [d.select("word", "need") for d in (inside, same, above)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def need_hits(cand_tokens: DataFrame, need_tokens: DataFrame, synonyms: DataFrame, hypernyms: DataFrame) -> DataFrame:
    """rid, need: the distinct needs that a candidate's words satisfy."""
    own = each_token(cand_tokens)
    hits = token_hits(own, need_tokens.select(F.col("word").alias("need")), synonyms, hypernyms)
    return own.join(hits, "word").select("rid", "need").distinct()


def asked_words(jobs: DataFrame, need_tokens: DataFrame) -> DataFrame:
    """job_id, side, pos, word: the words of both sides, and as a third side those of the major that a gate asks for."""
    majors = jobs.select("job_id", F.lit("major").alias("side"), F.posexplode(gates.needed_majors(F.col("hard_gates"))).alias("pos", "word"))
    own = need_tokens.where(F.col("side").isin("must", "bonus"))
    return own.select("job_id", "side", F.col("pos").cast("long").alias("pos"), "word").unionByName(majors.withColumn("pos", F.col("pos").cast("long")))


def hits(cand_tokens: DataFrame, jobs: DataFrame, need_tokens: DataFrame, synonyms: DataFrame, hypernyms: DataFrame) -> DataFrame:
    """rid, need: need_hits() for all words that openings ask for, computed once and kept for what follows."""
    return written(need_hits(cand_tokens, asked_words(jobs, need_tokens), synonyms, hypernyms), "hits")


def weight(c: Column, default: float) -> Column:
    """A missing weight has its default; 0 is a weight."""
    return F.coalesce(c.try_cast("double"), F.lit(default))


def points(w: Column, hits: Column, n: Column) -> Column:
    """100 x weight x share of the words hit, rounded half to even; 0 without words."""
    return F.when(n > 0, F.bround(F.lit(100.0) * w * (hits / n), 0).cast("int")).otherwise(0)


def label(total: Column) -> Column:
    return F.when(total >= RECOMMEND_FROM, RECOMMEND[0]).when(total >= PENDING_FROM, RECOMMEND[1]).otherwise(RECOMMEND[2])


def scored(df: DataFrame) -> DataFrame:
    """Adds skill_score, bonus_score, total_score, recommend to n_must_hit, n_bonus_hit, n_must, n_bonus and the weights."""
    s = points(weight(F.col("must_weight"), MUST_WEIGHT), F.col("n_must_hit"), F.col("n_must"))
    b = points(weight(F.col("bonus_weight"), BONUS_WEIGHT), F.col("n_bonus_hit"), F.col("n_bonus"))
    df = df.withColumn("skill_score", s).withColumn("bonus_score", b).withColumn("total_score", F.col("skill_score") + F.col("bonus_score"))
    return df.withColumn("recommend", label(F.col("total_score")))


def gated(jobs: DataFrame, gate_col: str = "hard_gates") -> DataFrame:
    """Openings with their gate text read into columns, once per opening."""
    g = F.col(gate_col)
    return jobs.withColumns({"need_level": gates.needed_level(g), "need_years": gates.needed_years(g), "need_certificates": F.array_distinct(gates.needed_certificates(g))})


def gate(cand_org: Column, have_level: Column, years: Column, job_org: Column, need_level: Column, need_years: Column, lost: Column | None = None) -> Column:
    """Whether a candidate passes the mechanical gates; levels are numbers, read from the texts once per row.

    lost: the certificates asked for that the candidate lacks; without it, certificates are not compared.
    """
    lacks_years = (need_years > 0) & (F.coalesce(years, F.lit(0)) < need_years)
    ok = ~gates.other_org(cand_org, job_org) & (have_level >= need_level) & ~lacks_years
    return ok if lost is None else ok & (F.size(lost) == 0)


def gate_reasons(cand_org: Column, education: Column, years: Column, certificates: Column, skills: Column, job_org: Column, gate_text: Column, age: Column | None = None) -> Column:
    """Why a candidate fails, in the order of the gates; empty: passes. An unknown age is not compared."""
    level, asked = gates.needed_level(gate_text), gates.needed_years(gate_text)
    lost = gates.missing_certificates(gate_text, certificates, skills)
    why = [
        F.when(gates.other_org(cand_org, job_org), F.lit("组织不一致")),
        F.when((level > 0) & (gates.level(education) < level), F.concat(F.lit("学历"), F.coalesce(education, F.lit("未知")), F.lit("＜要求"), gates.segment(gate_text, "学历"))),
        F.when((asked > 0) & (F.coalesce(years, F.lit(0)) < asked), F.concat(F.lit("经验"), F.coalesce(years, F.lit(0)).cast("string"), F.lit("年＜要求"), asked.cast("string"), F.lit("年"))),
        F.when(F.size(lost) > 0, F.concat(F.lit("证书缺证据:"), F.array_join(F.slice(lost, 1, 2), "、"))),
    ]
    if age is not None:
        span = gates.age_range(gate_text)
        why.append(F.when((age > 0) & ~age.between(span["least"], span["most"]), F.concat(F.lit("年龄"), age.cast("string"), F.lit("不在"), gates.segment(gate_text, "年龄"), F.lit("区间"))))
    return F.array_compact(F.array(*why))


def major_needs_review(gate_text: Column, major: Column, skill_hits_need: Column) -> Column:
    """A major is asked for, no skill satisfies it, and the candidate's major is not named in it."""
    s = gates.segment(gate_text, "专业")
    named = F.coalesce((major != "") & F.contains(s, major), F.lit(False))
    return (s != "") & ~skill_hits_need & ~named


def with_held(cands: DataFrame, cand_tokens: DataFrame, asked: DataFrame) -> DataFrame:
    """cands with held: the certificates of asked (certificate) that lie within a candidate's certificates or one of the words."""
    none = F.array().cast("array<string>")
    if asked.isEmpty():
        return cands.withColumn("held", none)
    texts = each_token(cand_tokens)
    if "certificates" in cands.columns:
        texts = texts.unionByName(cands.select("rid", F.col("certificates").alias("word")).where("certificates <> ''"))
    inside = contained(asked, texts.select("word")).toDF("certificate", "word")
    held = texts.join(inside, "word").groupBy("rid").agg(F.array_sort(F.collect_set("certificate")).alias("held"))
    return cands.join(held, "rid", "left").withColumn("held", F.coalesce("held", none))


#: Bears on nothing any more: pairs are counted in blocks, whether words are common or not.
COMMON = 0.25


def items(cands: DataFrame, cand_tokens: DataFrame, jobs: DataFrame, need_tokens: DataFrame, synonyms: DataFrame, hypernyms: DataFrame, have: DataFrame | None = None, tag: Column | None = None, carry: tuple = (), alike: bool = False, given: tuple = ()) -> DataFrame:
    """block, cands, chunk, openings, hits, vocabulary: every block of candidates with every chunk of openings that the organisation lets it meet.

    Tables as in match(); where cand_tokens has a mask (bits of the words in its metadata, 64 to a long), it is sent in place of the words. tag: a number per candidate, by which matched_counts() counts; carry, given: columns of candidates and of openings that go along.
    alike: for matched_counts() alone, candidates that nothing here tells apart are one row, which says how many they are.
    """
    named = lambda c: F.concat(F.lit("="), c)
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    share = lambda df, size: df.groupBy("__org").agg(F.ceil(F.count(F.lit(1)) / size).alias("__n"))
    few = cand_tokens.schema["mask"].metadata["words"] if have is None and "mask" in cand_tokens.columns else None
    if few is not None:
        met = token_hits(cands.sparkSession.createDataFrame([(w,) for w in few], "word string"), asked_words(jobs, need_tokens).select(F.col("word").alias("need")), synonyms, hypernyms, few=True)
    elif have is None:
        # which words satisfy which is small and kept; what candidates have of it is seen in the bitmaps of a block
        met = written(token_hits(each_token(cand_tokens), asked_words(jobs, need_tokens).select(F.col("word").alias("need")), synonyms, hypernyms), "hits")
    else:
        cand_tokens = have.select("rid", F.col("need").alias("word"))
        met = asked_words(jobs, need_tokens).select(F.col("word").alias("need")).distinct().withColumn("word", F.col("need"))
    # an opening stands under its own organisation (or none) and under any, a candidate asks for its own and none, or, without one, for any
    n = int(cands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = gated(jobs.repartition(n, "job_id")).withColumn("__org", F.coalesce(named(none_if_empty(F.col("org"))), F.lit("none")))
    words = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("pos", "word")))), lambda x: x["word"]).alias(side)
    asked = need_tokens.groupBy("job_id").agg(words("must"), words("bonus"))
    worth = lambda side, default: F.transform(F.sequence(F.lit(0), F.size(side)), lambda h: points(weight(F.col(f"{side}_weight"), default), h, F.size(side)))
    text = F.coalesce(gates.segment(F.col("hard_gates"), "专业"), F.lit(""))
    opening = F.struct(
        "job_id", "must", "bonus", worth("must", MUST_WEIGHT).alias("skill_points"), worth("bonus", BONUS_WEIGHT).alias("bonus_points"), "need_level", "need_years", "need_certificates",
        text.alias("major_text"), F.coalesce(gates.needed_majors(F.col("hard_gates")), F.array().cast("array<string>")).alias("major_words"),
        *(F.col(c).alias(f"given_{c}") for c in given),
    )
    stand = read.join(asked, "job_id").join(F.broadcast(share(read, blocks.CHUNK)), "__org").withColumns({"chunk": part("job_id", "__n"), "opening": opening})
    stand = stand.groupBy("__org", "chunk").agg(F.sort_array(F.collect_list("opening")).alias("openings"))
    if few is None:
        stand = written(stand, "openings")
    needs = stand.select("__org", "chunk", F.explode("openings").alias("o")).select("__org", "chunk", F.explode(F.array_distinct(F.concat("o.must", "o.bonus", "o.major_words"))).alias("need")).distinct()
    known = needs.join(met.groupBy("need").agg(F.collect_list("word").alias("words")), "need").groupBy("__org", "chunk").agg(F.collect_list(F.struct("need", "words")).alias("hits"))
    none = F.array().cast(known.schema["hits"].dataType)
    if few is not None:
        # each chunk gets all that few words satisfy
        every = met.groupBy("need").agg(F.collect_list("word").alias("words")).agg(F.collect_list(F.struct("need", "words")).alias("hits"))
        stood = stand.crossJoin(F.broadcast(every))
    else:
        stood = stand.join(known, ["__org", "chunk"], "left")
    chunks = stood.select(F.explode(F.array("__org", F.lit("any"))).alias("key"), F.concat_ws("/", "chunk", "__org").alias("chunk"), "openings", F.coalesce("hits", none).alias("hits"))
    who = with_held(cands, cand_tokens, read.select(F.explode("need_certificates").alias("certificate")).distinct())
    major = F.col("major") if "major" in cands.columns else F.lit(None).cast("string")
    org = none_if_empty(F.col("org"))
    given = [F.col(c).alias(f"carry_{c}") for c in carry]
    who = who.select(
        "rid", F.coalesce(named(org), F.lit("any")).alias("__org"), gates.level(F.col("education")).alias("have_level"), F.coalesce("years", F.lit(0)).alias("years"), major.alias("major"), "held",
        (F.lit(0) if tag is None else tag.cast("int")).alias("tag"), *given,
    )
    every_org = who.select("__org")
    # candidates without words reach no positive total
    own = cand_tokens.select("rid", F.col("mask").alias("words")) if few is not None else cand_tokens.select("rid", "words") if "words" in cand_tokens.columns else cand_tokens.groupBy("rid").agg(F.collect_list("word").alias("words"))
    who = who.join(own, "rid").withColumn("n", F.lit(1).cast("long"))
    if alike:
        same = [F.array_sort("words").alias("words") if c == "words" and few is None else c for c in who.columns if c not in ("rid", "n")]
        who = written(who.groupBy(*same).agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("n")), "alike")
    # those without words count as well, which only makes blocks smaller
    number = share(who if alike else every_org, blocks.BLOCK)
    dealt = who.join(F.broadcast(number), "__org").withColumn("block", part("rid", "__n"))
    dealt = dealt.groupBy("__org", "block").agg(F.sort_array(F.collect_list(F.struct("rid", "have_level", "years", "major", "held", "words", "tag", "n", *(f"carry_{c}" for c in carry)))).alias("cands"))
    keys = F.when(F.col("__org") == "any", F.array("__org")).otherwise(F.array("__org", F.lit("none")))
    dealt = dealt.select(F.explode(keys).alias("key"), F.concat_ws("/", "block", "__org").alias("block"), "cands")
    return dealt.join(chunks, "key").repartition(4 * n, "key", "block", "chunk").select("block", "cands", "chunk", "openings", "hits", F.lit(few if few else []).cast("array<string>").alias("vocabulary"))


def each_token(cand_tokens: DataFrame) -> DataFrame:
    """rid, word, from tables with a word or a list of words in a row."""
    return cand_tokens.select("rid", F.explode("words").alias("word")) if "words" in cand_tokens.columns else cand_tokens.select("rid", "word")


def grouped(cands: DataFrame, cand_tokens: DataFrame, jobs: DataFrame, need_tokens: DataFrame, synonyms: DataFrame, hypernyms: DataFrame, least: int = LEAST_TOTAL, have: DataFrame | None = None, lists: bool = False, best: int | None = None, carry: tuple = ()) -> DataFrame:
    """The pairs of match() in few rows: an opening, what its pairs share, total_score, recommend, and cands, the candidates of these pairs.

    What is the same for all pairs of a row can be computed or joined before ungrouped() makes pairs of them. With lists the shared
    are also the words hit and missed. carry: columns of cands (the table) that go along in cands, whose items are structs then, else rids. One opening may have several rows.
    """
    _positive(least)
    work = items(cands, cand_tokens, jobs, need_tokens, synonyms, hypernyms, have, carry=carry)
    who = f"cands array<struct<{', '.join(_kind(cands, c, f'{p}{c}:') for c, p in (('rid', ''), *((c, 'carry_') for c in carry)))}>>" if carry else f"cands array<{_kind(cands, 'rid', '')}>"
    kinds = ["n_must_hit long", "n_bonus_hit long", "n_must long", "n_bonus long", "skill_score int", "bonus_score int", "major_review boolean", who] + ["met array<long>"] * lists
    form = blocks.former(least, lists, tuple(f"carry_{c}" for c in carry)) if best is None else blocks.best(least, best)
    out = work.mapInArrow(form, ", ".join([_kind(jobs, "job_id"), *kinds]))
    out = out.withColumn("total_score", F.col("skill_score") + F.col("bonus_score")).withColumn("recommend", label(F.col("total_score")))
    if not lists:
        return out
    words = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("pos", "word")))), lambda x: x["word"]).alias(f"__{side}")
    out = out.join(need_tokens.groupBy("job_id").agg(words("must"), words("bonus")), "job_id")
    bit = lambda i: f"(shiftright(met[cast(({i}) div {blocks.HELD} as int)], cast(({i}) % {blocks.HELD} as int)) & 1)"
    pick = lambda side, first, hit: F.expr(f"filter(__{side}, (x, i) -> {bit(f'i + {first}')} = {hit})")
    return out.withColumns({f"{side}_{name}": pick(side, first, hit) for side, first in (("must", "0"), ("bonus", "size(__must)")) for name, hit in (("hits", 1), ("miss", 0))}).drop("met", "__must", "__bonus")


def ungrouped(groups: DataFrame) -> DataFrame:
    """A row per pair from rows of grouped()."""
    kind = groups.schema["cands"].dataType.elementType
    if not isinstance(kind, StructType):
        return groups.select(F.explode("cands").alias("rid"), *(c for c in groups.columns if c != "cands"))
    inner = kind.fieldNames()
    out = groups.select(*(c for c in groups.columns if c != "cands"), F.explode("cands").alias("c"))
    return out.select(*(F.col(f"c.{c}").alias(c.removeprefix("carry_")) for c in inner), *(c for c in groups.columns if c != "cands"))


def paired(cands: DataFrame, cand_tokens: DataFrame, jobs: DataFrame, need_tokens: DataFrame, synonyms: DataFrame, hypernyms: DataFrame, least: int = LEAST_TOTAL, carry: tuple = (), given: tuple = (), said: bool = False) -> DataFrame:
    """The pairs of match(): rid, the columns carry of cands, job_id, the columns given of jobs, scores and label; with said their evidence().

    No pair is shuffled, joined or sorted: candidates of a block stand once beside some openings, which say per candidate which of
    their few kinds of pairs it is.
    """
    _positive(least)
    work = items(cands, cand_tokens, jobs, need_tokens, synonyms, hypernyms, carry=carry, given=given)
    lists = [f"{p}{c} array<{_kind(cands, c, '')}>" for p, c in (("", "rid"), *(("carry_", c) for c in carry))]
    inner = [_kind(jobs, "job_id", "job_id:"), *(_kind(jobs, c, f"given_{c}:") for c in given), "skill:array<int>", "bonus:array<int>", *["said:array<string>"] * said, "cell:array<int>"]
    form = blocks.coder(least, tuple(f"carry_{c}" for c in carry), tuple(f"given_{c}" for c in given), said)
    rows = work.mapInArrow(form, ", ".join([*lists, f"openings array<struct<{', '.join(inner)}>>"]))
    who = [c for c in rows.columns if c != "openings"]
    out = rows.select(*who, F.explode("openings").alias("o")).select(*who, "o.*")
    out = out.select(*(c for c in out.columns if c != "cell"), F.posexplode("cell").alias("place", "cell")).where("cell >= 0")
    at = lambda c, n: F.get(F.col(c), F.col(n))
    out = out.select(
        *(at(c, "place").alias(c.removeprefix("carry_")) for c in who), "job_id", *(F.col(f"given_{c}").alias(c) for c in given), at("skill", "cell").alias("skill_score"), at("bonus", "cell").alias("bonus_score"),
        *[at("said", "cell").alias("evidence")] * said,
    )
    return out.withColumn("total_score", F.col("skill_score") + F.col("bonus_score")).withColumn("recommend", label(F.col("total_score")))


def match(*tables: DataFrame, least: int = LEAST_TOTAL, have: DataFrame | None = None, lists: bool = False, best: int | None = None) -> DataFrame:
    """All pairs that pass the gates and reach the least total. tables: cands, cand_tokens, jobs, need_tokens, synonyms, hypernyms.

    cands: rid, org, education, years, and certificates and major where known. cand_tokens: rid, word (or words, a list). jobs:
    job_id, org, hard_gates, must_weight, bonus_weight. need_tokens: job_id, side (must or bonus), pos, word; a word given twice counts
    twice. have: hits() of these tables, if they are there. Returns rid, job_id, the counts, scores, label, and major_review: a
    person must judge whether the major fits; with lists also what hit_lists() says, from the same pass.
    `least` must be positive: candidates without any hit are left out. best: at least the so many pairs that stand first by total
    (highest first), rid and job_id, and few others; for stats.top().
    """
    return ungrouped(grouped(*tables, least=least, have=have, lists=lists, best=best))


def _positive(least: int) -> None:
    if least <= 0:
        raise ValueError("a least total of 0 asks for every pair; this operator forms only pairs with a hit")


def _kind(df: DataFrame, name: str, as_: str | None = None) -> str:
    return f"{name + ' ' if as_ is None else as_}{df.schema[name].dataType.simpleString()}"


def matched_counts(work: DataFrame, job_kind: str = "job_id string", least: int = LEAST_TOTAL) -> DataFrame:
    """job_id, total_score, recommend, tag, n: how many pairs match() has of an opening with that total, without forming them."""
    _positive(least)
    cells = work.mapInArrow(blocks.counter(least), f"{job_kind}, total_score int, tag int, n long")
    n = cells.groupBy("job_id", "total_score", "tag").agg(F.sum("n").alias("n"))
    return n.withColumn("recommend", label(F.col("total_score")))


def matched_cands(work: DataFrame, rid_kind: str = "rid long", least: int = LEAST_TOTAL) -> DataFrame:
    """rid: the candidates that match() has in any pair, without forming the pairs."""
    _positive(least)
    return work.mapInArrow(blocks.finder(least), rid_kind).distinct()


def hit_lists(pairs: DataFrame, have: DataFrame, need_tokens: DataFrame) -> DataFrame:
    """pairs (rid, job_id) with must_hits, must_miss, bonus_hits in the order of the opening's words."""
    words = pairs.select("rid", "job_id").join(need_tokens, "job_id").join(have.select("rid", F.col("need").alias("word"), F.lit(True).alias("hit")), ["rid", "word"], "left")
    # a pair's words are those of one opening
    g = words.groupBy("rid", "job_id").agg(F.array_sort(F.collect_list(F.struct("side", "pos", "word", F.coalesce("hit", F.lit(False)).alias("hit")))).alias("all"))
    pick = lambda side, hit: F.transform(F.filter("all", lambda x: (x["side"] == side) & (x["hit"] == hit)), lambda x: x["word"])
    return g.select("rid", "job_id", pick("must", True).alias("must_hits"), pick("must", False).alias("must_miss"), pick("bonus", True).alias("bonus_hits"), pick("bonus", False).alias("bonus_miss"))


def evidence(shown_hits: Column, n_must_hit: Column, n_must: Column, n_bonus_hit: Column, n_bonus: Column, misses: Column) -> Column:
    """How a score came about, in one line."""
    listed = F.when(F.size(shown_hits) > 0, F.array_join(F.slice(shown_hits, 1, MOST_HITS), "、")).otherwise(NOTHING)
    head = F.format_string("语义匹配：必备%d/%d（%s）；加分%d/%d", n_must_hit, n_must, listed, n_bonus_hit, n_bonus)
    return F.when(F.size(misses) > 0, F.concat(head, F.lit("；未命中："), F.array_join(F.slice(misses, 1, MOST_MISSES), "、"))).otherwise(head)


def match_rows(scored_pairs: DataFrame, cands: DataFrame, jobs: DataFrame, source: str = SYSTEM_SOURCE) -> DataFrame:
    """Rows of the match table: pairs that both tables know, with the columns copied from either.

    Rows of paired() that carry the columns of shown() and are given those of openings join neither.
    """
    if "job_name" in scored_pairs.columns:
        return scored_pairs.withColumns({"recommend": F.coalesce(F.nullif("recommend", F.lit("")), F.lit(RECOMMEND[2])), "evidence": F.coalesce("evidence", F.lit("")), "hard_gates": F.coalesce("hard_gates", F.lit("")), "source": F.lit(source)})
    c = shown(cands)
    j = jobs.select("job_id", "job_name", "org", "must_skills", "bonus_skills", F.coalesce("hard_gates", F.lit("")).alias("hard_gates"))
    s = scored_pairs.select("rid", "job_id", "skill_score", "bonus_score", "total_score", F.coalesce(F.nullif("recommend", F.lit("")), F.lit(RECOMMEND[2])).alias("recommend"), F.coalesce("evidence", F.lit("")).alias("evidence"))
    return s.join(c, "rid").join(j, "job_id").withColumn("source", F.lit(source))


def shown(cands: DataFrame) -> DataFrame:
    """What rows of the match table show of candidates."""
    return cands.select("rid", "name", "phone", "cand_skills", "expected_position", years_shown().alias("years_experience"))


def years_shown() -> Column:
    return F.coalesce(F.nullif("years", F.lit(0)).cast("string"), F.lit(NOTHING))


def valid_grants(grants: DataFrame, need_tokens: DataFrame, have: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid). grants: job_id, rid, ord, side, item, basis.

    Valid: a known side, a word of that side, a basis, not hit already, and the first of its kind by ord. Grants that are
    hit already or repeated are neither.
    """
    words = need_tokens.select("job_id", "side", F.col("word").alias("item"), F.lit(True).alias("known")).distinct()
    g = grants.join(words, ["job_id", "side", "item"], "left").join(have.select("rid", F.col("need").alias("item"), F.lit(True).alias("hit")), ["rid", "item"], "left")
    reason = (
        F.when(F.col("side").isNull() | ~F.col("side").isin("must", "bonus"), F.lit("side"))
        .when(F.col("known").isNull(), F.lit("item"))
        .when(F.trim(F.coalesce("basis", F.lit(""))) == "", F.lit("basis"))
    )
    g = g.withColumn("reason", reason)
    first = g.where("reason is null and hit is null").groupBy("job_id", "rid", "side", "item").agg(F.min_by(F.trim("basis"), "ord").alias("basis"), F.min("ord").alias("ord"))
    return first, g.where("reason is not null").select("job_id", "rid", "ord", "side", "item", "reason")


def rescored(verdicts: DataFrame, jobs: DataFrame, need_tokens: DataFrame, have: DataFrame, grants: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """verdicts: job_id, rid, keep -> the rows with scores counted anew from live words and valid grants; null where not kept.

    live: job_id, rid, n_must, n_bonus, n_must_hit, n_bonus_hit, if they have been counted from the same words already.
    """
    valid, _ = valid_grants(grants, need_tokens, have)
    if live is None:
        words = need_tokens.join(verdicts.select("job_id", "rid"), "job_id").join(have.select("rid", F.col("need").alias("word"), F.lit(1).alias("hit")), ["rid", "word"], "left")
        live = words.groupBy("job_id", "rid").agg(*[F.count_if(c).alias(name) for c, name in (
            (F.col("side") == "must", "n_must"), (F.col("side") == "bonus", "n_bonus"),
            ((F.col("side") == "must") & F.col("hit").isNotNull(), "n_must_hit"), ((F.col("side") == "bonus") & F.col("hit").isNotNull(), "n_bonus_hit"),
        )])
    n = live.select("job_id", "rid", "n_must", "n_bonus", F.col("n_must_hit").alias("h_must"), F.col("n_bonus_hit").alias("h_bonus"))
    more = valid.groupBy("job_id", "rid").agg(F.count_if(F.col("side") == "must").alias("g_must"), F.count_if(F.col("side") == "bonus").alias("g_bonus"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = verdicts.join(n, ["job_id", "rid"], "left").join(more, ["job_id", "rid"], "left").join(jobs.select("job_id", "must_weight", "bonus_weight"), "job_id")
    out = out.withColumns({
        "n_must": zero("n_must"), "n_bonus": zero("n_bonus"), "n_must_hit": zero("h_must") + zero("g_must"), "n_bonus_hit": zero("h_bonus") + zero("g_bonus"),
    }).drop("h_must", "h_bonus", "g_must", "g_bonus")
    out = scored(out)
    return out.withColumns({c: F.when(F.col("keep"), F.col(c)) for c in ("skill_score", "bonus_score", "total_score", "recommend")})


def regranted(cands: DataFrame, cand_tokens: DataFrame, jobs: DataFrame, need_tokens: DataFrame, synonyms: DataFrame, hypernyms: DataFrame, keep: Column, tag: Column, least: int = LEAST_TOTAL) -> DataFrame:
    """rescored() for all pairs of match(), where the valid grants of a candidate are the same for all openings; no pair is written or joined.

    cands has granted: of which words it has a grant with a basis, as side and place, like "must 1"; what an opening lacks or the
    candidate satisfies already counts once. keep: from columns of jobs and tag, a small number per candidate. Rows as of grouped().
    """
    _positive(least)
    work = items(cands, cand_tokens, jobs, need_tokens, synonyms, hypernyms, tag=tag, carry=("granted",))
    kinds = f"{_kind(jobs, 'job_id')}, n_must_hit long, n_bonus_hit long, n_must long, n_bonus long, tag int, cands array<{_kind(cands, 'rid', '')}>"
    out = scored(work.mapInArrow(blocks.granter(least), kinds).join(jobs, "job_id").withColumn("keep", keep))
    return out.withColumns({c: F.when(F.col("keep"), F.col(c)) for c in ("skill_score", "bonus_score", "total_score", "recommend")})

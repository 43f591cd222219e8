"""How well a pool of labels covers the words that openings ask for, and proposals for words it lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .matching import contained

LEAST_SHARED, MOST_NEAR, SEPARATOR = 2, 5, "、"
NO_SUCH, OTHER_WORD, COLLISION = "②", "①", "①撞车"


def covered_words(pool: DataFrame, needs: DataFrame) -> DataFrame:
    """need, covered: a label holds the word, lies within it, or shares a token with it. pool: label, needs: need."""
    n, p = needs.select("need").distinct(), pool.select("label").distinct()
    inside = contained(n, p).select(F.col("short").alias("need")).unionByName(contained(p, n).select(F.col("long").alias("need")))
    own = n.select("need", F.explode(tokens(F.col("need"))).alias("t"))
    shared = own.join(p.select(F.explode(tokens(F.col("label"))).alias("t")).distinct(), "t").select("need")
    hit = inside.unionByName(shared).distinct().withColumn("covered", F.lit(True))
    return n.join(hit, "need", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def ratios(pool: DataFrame, needs: DataFrame) -> DataFrame:
    """job_id, n_words, n_covered, ratio; needs: job_id, pos, need. Openings without words are not in it."""
    j = needs.join(covered_words(pool, needs), "need")
    return j.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_words"), F.count_if("covered").alias("n_covered")).withColumn("ratio", F.col("n_covered") / F.col("n_words"))


def letters(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))


def near_labels(pool: DataFrame, words: DataFrame) -> DataFrame:
    """need, near: up to five labels that share two or more characters; most shared first, then the shortest, then by text.

    Two words that share two characters share one that is not the most common of either: pairs come from the others only.
    """
    p = pool.select("label").distinct().withColumn("l", letters(F.col("label")))
    w = words.select("need").distinct().withColumn("w", letters(F.col("need")))
    n = p.select(F.explode("l").alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    # in one order for both, the most common last and left out; a character that no label has joins nothing
    rarer = lambda df, key, c: df.select(key, F.explode(c).alias("ch")).join(n, "ch").withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "ch"))).where("k > 1").select(key, "ch")
    pairs = rarer(w, "need", "w").join(rarer(p, "label", "l"), "ch").where("need <> label").select("need", "label").distinct()
    shared = pairs.join(w, "need").join(p, "label").select("need", "label", F.size(F.array_intersect("w", "l")).alias("n")).where(F.col("n") >= LEAST_SHARED)
    # a need keeps its best few as they are ranked; its labels are never gathered in one row
    w = Window.partitionBy("need").orderBy(F.desc("n"), F.length("label"), "label")
    best = shared.withColumn("place", F.row_number().over(w)).where(F.col("place") <= MOST_NEAR)
    best = best.groupBy("need").agg(F.array_sort(F.collect_list(F.struct("place", "label"))).alias("x"))
    return best.select("need", F.transform("x", lambda x: x["label"]).alias("near"))


def proposals(pool: DataFrame, needs: DataFrame, least: float) -> DataFrame:
    """For openings below the least ratio: job_id, must_skills with replacements, collisions, what was done per word.

    Words are replaced one after the other: a covered word stays; so does one without a near label; the nearest label replaces it
    unless the opening asks for that already or an earlier word took it.
    """
    low = ratios(pool, needs).where(F.col("ratio") < least).select("job_id")
    j = needs.join(low, "job_id").join(covered_words(pool, needs), "need").join(near_labels(pool, needs), "need", "left")
    per = j.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("pos", "need", "covered", F.get("near", F.lit(0)).alias("best")))).alias("words"))
    must = F.transform("words", lambda x: x["need"])
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("why"))

    def step(s, x):
        taken = F.array_contains(F.concat(must, s["out"]), x["best"])
        why = F.when(x["covered"], "").when(x["best"].isNull(), NO_SUCH).when(taken, COLLISION).otherwise(OTHER_WORD)
        return F.struct(F.concat(s["out"], F.array(F.when(why == OTHER_WORD, x["best"]).otherwise(x["need"]))).alias("out"), F.concat(s["why"], F.array(why)).alias("why"))

    done = per.withColumn("r", F.aggregate("words", start, step))
    # a label of the pool covers itself, so that every replaced word is covered from then on
    n = F.size(F.filter("r.why", lambda w: w.isin("", OTHER_WORD)))
    after = n / F.size("words")
    return done.select(
        "job_id", F.array_join("r.out", "、").alias("must_skills"), F.size(F.filter("r.why", lambda w: w == COLLISION)).alias("collisions"), F.array_join("r.why", ",").alias("causes"),
        after.alias("post_ratio"), (after < least).alias("still_low"),
    )


def precheck(payload: DataFrame, jobs: DataFrame, pool: DataFrame, least: float) -> DataFrame:
    """What is wrong with proposals before they are written: job_id, problem (unknown or low), ratio, missing words.

    payload: job_id, must_skills. A proposal without words changes nothing and is left out.
    """
    known = jobs.select("job_id").distinct()
    unknown = payload.join(known, "job_id", "left_anti").select("job_id", F.lit("unknown").alias("problem"), F.lit(None).cast("double").alias("ratio"), F.lit(None).cast("string").alias("missing"))
    needs = payload.join(known, "job_id", "left_semi").select("job_id", F.posexplode(tokens(F.col("must_skills"))).alias("pos", "need"))
    j = needs.join(covered_words(pool, needs), "need")
    # the words of one proposal
    missing = F.transform(F.array_sort(F.collect_list(F.when(~F.col("covered"), F.struct("pos", "need")))), lambda x: x["need"])
    per = j.groupBy("job_id").agg((F.count_if("covered") / F.count(F.lit(1))).alias("ratio"), F.array_join(missing, "、").alias("missing"))
    return unknown.unionByName(per.where(F.col("ratio") < least).select("job_id", F.lit("low").alias("problem"), "ratio", "missing"))


def pool_signature(pool: DataFrame) -> DataFrame:
    """n, sig: the pool's size and the SHA-1 of its sorted labels.

    A digest of one text is taken in one task; the labels run through it in order, a batch at a time, so that no row holds the pool.
    """

    def run(batches):
        import hashlib

        import pyarrow as pa

        n, sha = 0, hashlib.sha1()
        for b in batches:
            for label in b.column(0).to_pylist():
                sha.update((SEPARATOR + label if n else label).encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n], "sig": [sha.hexdigest()]})

    out = pool.select("label").where("label is not null").distinct().repartition(1).sortWithinPartitions("label").mapInArrow(run, "n long, sig string")
    none = F.sha1(F.lit("").cast("binary"))
    return out.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("sig"), none).alias("sig"))

"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws the exponential key -ln(u) / w from a hash of its id and its quality weight w; the documents with
the smallest keys of a source are a weighted sample without replacement. A source whose target is above its size is
first taken whole, epoch by epoch; what is left of its target is the budget of the sample, up to which the sizes in
key order are summed.

The sum does not order a source in one task: the key's distribution function deals a source into buckets of about
`bucket_rows` documents, whose sums are added up first; only within a bucket are rows sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free, text_of, written

#: Weights of the sources in order of code points, repeating.
WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """source, size -> one row per source: source, source_size, n, mean_weight, sid, target.

    The sources share `share` times all sizes by weight; a target stops at `epochs` times its source's size and the
    excess goes to the others by weight. This is water-filling: with the sources in order of cap / weight, the level is
    the largest of (total - caps before) / (weights from here on).
    """
    per = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("w") > 0, F.col("w")).otherwise(0.0)).alias("sw")
    )
    order = Window.orderBy(F.col("source").asc_nulls_last())
    each = ", ".join(f"{float(w)!r}D" for w in weights)
    per = per.withColumn("sid", F.row_number().over(order) - 1).withColumn("weight", F.expr(f"element_at(array({each}), int(sid % {len(weights)}) + 1)"))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    every = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(every) * F.lit(float(share))
    per = per.withColumn("level", (total - before) / onward).withColumn("level", F.max("level").over(every))
    return per.select(
        "source", "source_size", "n", (F.col("sw") / F.col("n")).alias("mean_weight"), "sid",
        F.least("cap", F.col("weight") * F.greatest("level", F.lit(0.0))).alias("target"),
    )


def sizes_of(docs: DataFrame, weight: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (words of the whole text) and w, the quality weight; a null weight is 1."""
    w = F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(1.0))
    size = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), w.alias("w"))


def mix(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, epochs: float = 2.0, seed: int = 0, bucket_rows: int = 2048) -> DataFrame:
    """One row per row of sizes: doc_id, size, source_size, target, taken, copies.

    sizes: doc_id, source, size, w, as sizes_of() gives them. taken: words that the mix takes, size times copies. Whole
    documents are taken: the one that meets the end of the budget is in if more than half of it fits. Ties of keys are
    in order of id and size; rows equal in all of them are interchangeable. Weights of 0 or less come last. Sources
    without words have target 0; an empty table gives an empty result. The same rows and seed give the same mix. Words of whole texts
    are counted, whatever their length.
    """
    sizes = written(sizes, "mix-sizes")
    per = written(targets(sizes, weights, share, epochs), "mix-targets")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    per = per.withColumn("full", full).withColumn("budget", F.col("target") - F.col("full") * F.col("source_size"))
    per = per.withColumn("buckets", F.ceil(F.col("n") / bucket_rows).cast("long"))

    # 52 bits of an MD5, which other engines can draw, too
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long") + F.lit(0.5)) * F.lit(2.0**-52)
    key = F.when(F.col("w") > 0, -F.ln(u) / F.col("w")).otherwise(F.lit(float("inf")))
    # the table of sources is joined as Spark sees fit: it knows its size, and hot sources are split
    rows = sizes.join(per, sizes["source"].eqNullSafe(per["source"])).select("doc_id", "size", "source_size", "target", "full", "budget", "sid", "mean_weight", "buckets", key.alias("key"))
    rank = F.when(F.col("mean_weight") > 0, 1 - F.exp(-F.col("key") * F.col("mean_weight"))).otherwise(0.0)
    rows = rows.withColumn("bucket", F.least(F.floor(rank * F.col("buckets")).cast("long"), F.col("buckets") - 1))
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("in_bucket"))
    ahead = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(inside)).join(sums, ["sid", "bucket"])
    chosen = F.col("ahead") + F.col("upto") - F.col("size") / 2 < F.col("budget")
    copies = F.col("full") + F.when(chosen & (F.col("size") > 0), 1).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, weight: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs as the mix takes them: a row per copy, none for documents it leaves out; all columns as they came.

    weight: id and w, the quality weights, at most one row per id. Rows that repeat an id and its text are one document and get its
    copies each. Null, empty and blank texts have no words and are left out; null ids are told apart by their texts; a null source is
    one of its own, the last; an empty table gives an empty one.
    """
    label, of, copies, copy = (free(docs, c) for c in ("__name", "__of", "__copies", "__copy"))
    name = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64(text_of(text_col)), F.xxhash64(text_of(text_col), F.lit(1)))
    sizes = sizes_of(docs.withColumn(label, name), id_col=label, text_col=text_col, source_col=source_col).drop("w")
    if weight is None:
        sizes = sizes.withColumn("w", F.lit(1.0))
    else:
        weight = weight.toDF("of", "w").withColumn("of", F.col("of").cast("string"))
        sizes = sizes.join(weight, F.substring_index("doc_id", ":", 1) == F.col("of"), "left").withColumn("w", F.coalesce("w", F.lit(1.0))).drop("of")
    taken = mix(sizes, **options).groupBy(F.col("doc_id").alias(of)).agg(F.max("copies").alias(copies)).where(F.col(copies) > 0)
    out = docs.join(taken, name == F.col(of)).withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(copies))))
    return out.select(*[docs[c] for c in docs.columns])

"""What the operators of this subpackage share: tables, the shared folder, fixed character classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import drop_written, open_at, scratch, written  # noqa: F401  for the operators

#: White space and words, as patterns of Java and of Python.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text"):
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not use."""
    while name in df.columns:
        name += "_"
    return name


#: Words of 64 bits in the bitmap of may_be_in(): its table never has more rows than this, whatever the data.
SLOTS = 1 << 20


def may_be_in(docs: DataFrame, key: Column, some: DataFrame, some_key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows of docs whose key is surely not in some, the others), with the columns of docs.

    The keys of some set bits in a bitmap of SLOTS words, which is broadcast: its size is bounded. Only the others need
    to meet some in a join, so that rows with a clean key are not shuffled. With more keys than bits, all rows are doubtful
    and the join decides: the result is the same.
    """
    bit = lambda h: F.shiftright(h, 20).bitwiseAND(F.lit(63)).cast("int")
    h = F.xxhash64(some_key)
    one = F.lit(1).cast("long")
    bits = some.select(F.pmod(h, F.lit(SLOTS)).alias("slot"), F.call_function("shiftleft", one, bit(h)).alias("w"))
    bits = bits.groupBy("slot").agg(F.bit_or("w").alias("word"))
    h = F.xxhash64(key)
    marked = docs.join(F.broadcast(bits), F.pmod(h, F.lit(SLOTS)) == bits["slot"], "left")
    hit = F.coalesce(bits["word"], F.lit(0)).bitwiseAND(F.call_function("shiftleft", one, bit(h))) != 0
    columns = [docs[c] for c in docs.columns]
    return marked.where(~hit).select(*columns), marked.where(hit).select(*columns)


#: A key is hot with more than 1/HOT of all rows; so there are fewer than HOT hot keys, whatever the data.
HOT = 1000


def salted(many: DataFrame, one: DataFrame, keys, spread: str, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(many, one) with a column salt, to be joined on keys and salt so that no task gets more than about 1/HOT of many.

    The rows of a hot key of many are dealt over salts by a hash of the column `spread`, and its rows of one are repeated for each
    salt. The table of hot keys has fewer than HOT rows and is broadcast. many should be cheap to read more than once; total
    stands for its number of rows where that is known to be about so many. Null keys are not hot: they meet nothing.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    bar = max((many.count() if total is None else total) / HOT, 1.0)
    hot = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bar).dropna(subset=keys)
    hot = hot.select(*keys, F.ceil(F.col("n") / bar).cast("int").alias("salts"))
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(spread), "salts").cast("int"), F.lit(0))).drop("salts")
    each = one.join(F.broadcast(hot), keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return dealt, each

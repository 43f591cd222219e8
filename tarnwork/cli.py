"""Read a table: python -m tarnwork.cli PATH [--filter column=value ...] [--fields a,b] [--stats] [--limit N]; prints JSON."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from .operators import stats, tables
from .session import session


#: Records that are shown unless more are asked for.
SHOWN = 1000


def run(spark, path: str, filters=(), fields: str = "", show_stats: bool = False, limit: int = SHOWN) -> dict:
    """count of what is asked for and its first records, at most limit; with show_stats, matches per opening and label.

    The records are collected for a reader; a whole table is read with Spark, not through this.
    """
    if any("=" not in f for f in filters):
        raise ValueError("a filter is column=value")
    df = tables.scan(spark.read.parquet(path), dict(f.split("=", 1) for f in filters))
    if show_stats:
        if not {"job_id", "job_name", "recommend"} <= set(df.columns):
            raise ValueError("statistics need a table of matches")
        df = stats.label_stats(df, F.monotonically_increasing_id())
    df = tables.scan(df, fields=[f for f in fields.split(",") if f])
    return {"count": df.count(), "records": [json.loads(r) for r in df.limit(limit).toJSON().collect()]}


def main(argv=None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("path")
    p.add_argument("--filter", action="append", default=[])
    p.add_argument("--fields", default="")
    p.add_argument("--stats", action="store_true")
    p.add_argument("--limit", type=int, default=SHOWN)
    a = p.parse_args(argv)
    print(json.dumps(run(session("cli"), a.path, a.filter, a.fields, a.stats, a.limit), ensure_ascii=False))


if __name__ == "__main__":
    main()

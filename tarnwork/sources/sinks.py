"""Results as JSON parts and as a page."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

from ..functions.values import RECOMMEND


def write_parts(df: DataFrame, path: str, part: str = "part") -> None:
    """One folder of JSON lines per part."""
    df.write.partitionBy(part).mode("overwrite").json(path)


def bar_percent(value: float, largest: float) -> int:
    """The width of a bar, rounded half to even."""
    return round(100 * value / largest) if largest else 0


def page(funnel: dict, departments: list[dict], best: list[dict], as_of: str) -> str:
    """A dashboard of aggregates (a row, some departments, a top list), all of bounded size."""
    esc = lambda x: html.escape("" if x is None else str(x))
    cards = "".join(f"<div><b>{esc(v)}</b> {esc(k)}</div>" for k, v in zip(("匹配", *RECOMMEND), funnel.values()))
    most = max((d["n_all"] for d in departments), default=0)
    order = sorted(departments, key=lambda d: (-d["n_all"], d["department"]))
    rows = "".join(f'<tr><td>{esc(d["department"])}</td><td>{d["n_open"]}/{d["n_all"]}</td><td><i style="width:{bar_percent(d["n_all"], most)}%"></i></td></tr>' for d in order)
    top = "".join(f'<tr><td>{esc(r["name"])}</td><td>{esc(r["job_name"])}</td><td>{esc(r["total_score"])}</td><td>{esc(r["evidence"])}</td></tr>' for r in best)
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"></head><body><p>{esc(as_of)}</p>{cards}<table>{rows}</table><table>{top}</table></body></html>'

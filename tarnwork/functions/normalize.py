"""Repairs of externally produced rows: structured texts, job rows, broken JSON. Nothing is rejected that can be repaired.

Two functions scan their input with state and are Arrow-batched pandas UDFs; everything else is Columns.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import gates
from .text import blank_to_null, first_int, join_list, list_tokens, tokens, utrim
from .values import RESUME_SEGMENTS, SEGMENT_ABSENT

BAR, HALF_BAR = "｜", "|"
ID = re.compile(r'"(?:id|job_id|rid)"\s*:\s*"([^"]*)"')


def repaired_segments(text: str | None, names: list[str], absent: str = SEGMENT_ABSENT) -> tuple[str, list[str]]:
    """A text of `name｜content` lines in the order of names, and what had to be repaired.

    Each name takes the line that bears it, else the first free line whose name holds it or is held by it; names without
    a line get `absent`; other lines join the last line before them that is in use. A blank text stays blank. A text
    that is in order comes back unchanged, with no repairs.
    """
    if text is None or not text.strip():
        return "", []
    kinds, lines = [], [x.strip() for x in text.split("\n")]
    filled = [x for x in lines if x]
    if len(filled) < len(lines):
        kinds.append("blank_lines")
    if any(HALF_BAR in x for x in filled):
        kinds.append("pipe_fixed")
    rows = [tuple(y.strip() for y in x.replace(HALF_BAR, BAR).partition(BAR)[::2]) for x in filled]
    owner: dict[int, int] = {}  # line -> place of the name that took it
    for place, name in enumerate(names):
        free = [k for k in range(len(rows)) if k not in owner]
        exact = [k for k in free if rows[k][0] == name]
        loose = [k for k in free if rows[k][0] and (name in rows[k][0] or rows[k][0] in name)]
        for k in (exact or loose)[:1]:
            owner[k] = place
    source = {place: k for k, place in owner.items()}
    content = [rows[source[p]][1] or absent if p in source else absent for p in range(len(names))]
    kinds += ["seg_filled"] * (len(names) - len(source))
    extra = [k for k in range(len(rows)) if k not in owner]
    if not names:
        return "\n".join(f"{rows[k][0]}{BAR}{rows[k][1]}" if rows[k][1] else rows[k][0] for k in extra), kinds
    for k in extra:
        before = [p for p, s in source.items() if s < k]
        content[max(before, default=0)] += "\n" + (f"{rows[k][0]}{BAR}{rows[k][1]}" if rows[k][1] else rows[k][0])
    if extra:
        kinds.append("seg_merged")
    out = "\n".join(f"{n}{BAR}{c}" for n, c in zip(names, content))
    return out, [] if out == text else kinds


def segments(text: Column, names: tuple[str, ...], absent: str = SEGMENT_ABSENT) -> Column:
    """struct<text, kinds> of repaired_segments()."""
    def run(col: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([repaired_segments(x, list(names), absent) for x in col], columns=["text", "kinds"])

    return F.pandas_udf(run, "text string, kinds array<string>")(text)


def salvaged_objects(text: str | None) -> tuple[list[str], list[tuple[str | None, str]]]:
    """(JSON of each sound object, (id, reason) of each broken one): a sound text as a whole, else object by object."""
    if text is None:
        return [], [(None, "unreadable")]
    try:
        whole = json.loads(text)
        return [json.dumps(x, ensure_ascii=False) for x in (whole if isinstance(whole, list) else [whole])], []
    except ValueError:
        pass
    good, bad, depth, begin = [], [], 0, 0
    # strings are skipped as units, so that only braces outside of them count
    for m in re.finditer(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}]', text, re.S):
        mark = m.group()
        if mark == "{":
            begin = m.start() if depth == 0 else begin
            depth += 1
        elif mark == "}" and depth:
            depth -= 1
            if depth == 0:
                part = text[begin : m.end()]
                try:
                    good.append(json.dumps(json.loads(part), ensure_ascii=False))
                except ValueError:
                    named = ID.search(part)
                    bad.append((named.group(1) if named else None, "broken object"))
    return good, bad if good or bad else [(None, "broken batch")]


def salvaged(text: Column) -> Column:
    """struct<rows, errors<id, reason>> of salvaged_objects()."""
    def run(col: pd.Series) -> pd.DataFrame:
        got = [salvaged_objects(x) for x in col]
        return pd.DataFrame({"rows": [g for g, _ in got], "errors": [[{"id": i, "reason": r} for i, r in b] for _, b in got]})

    return F.pandas_udf(run, "rows array<string>, errors array<struct<id:string,reason:string>>")(text)


def canonical_skills(c: Column) -> Column:
    """A text cell's tokens joined again in one form."""
    return F.array_join(tokens(c), "、")


def job_row(hard_gates: Column, must: Column, bonus: Column) -> Column:
    """A refined job row: gates in full, skills in one form, no word of must again in bonus, and the kinds of repair."""
    g = gates.normalized(hard_gates)
    m, b = tokens(must), tokens(bonus)
    kept = F.filter(b, lambda w: ~F.array_contains(m, w))
    changed = lambda c, t: F.coalesce(F.array_join(t, "、") != F.trim(c), F.lit(False))
    kinds = F.array_compact(F.array(
        F.when(changed(must, m), F.lit("skills_joined")), F.when(changed(bonus, b), F.lit("skills_joined")), F.when(F.size(kept) < F.size(b), F.lit("dup_removed"))
    ))
    return F.struct(
        g["text"].alias("hard_gates"), F.array_join(m, "、").alias("must_skills"), F.array_join(kept, "、").alias("bonus_skills"), F.concat(g["kinds"], kinds).alias("kinds")
    )


def resume_row(structured: Column, deep: Column, skills: Column, corrections: dict[str, Column]) -> Column:
    """A refined résumé row: segments in order, texts trimmed, years as a number, skills as tokens, and the kinds of repair.

    corrections: name -> text; null stays null. years_experience becomes the first whole number of its text.
    """
    seg, plain = segments(structured, RESUME_SEGMENTS), F.coalesce(utrim(deep), F.lit(""))
    words = tokens(skills)
    new = {k: first_int(c) if k == "years_experience" else blank_to_null(c) for k, c in corrections.items()}
    # what is said for a cell that was no value before is no repair
    kinds = [F.when(plain != F.coalesce(deep, F.lit("")), F.lit("coerced_str"))]
    for k, c in corrections.items():
        label = "coerced_int" if k == "years_experience" else "coerced_str"
        kinds.append(F.when(~new[k].cast("string").eqNullSafe(c), F.lit(label)))
    kinds.append(F.when(F.array_join(words, "、") != F.coalesce(skills, F.lit("")), F.lit("skills_coerced")))
    return F.struct(
        seg["text"].alias("ai_extract"), plain.alias("ai_deep"), words.alias("skills"), *[c.alias(k) for k, c in new.items()], F.concat(seg["kinds"], F.array_compact(F.array(*kinds))).alias("kinds")
    )


def has_content(*cells: Column) -> Column:
    """Whether a refined row has anything to write back."""
    out = F.lit(False)
    for c in cells:
        out = out | (F.trim(F.coalesce(c, F.lit(""))) != "")
    return out


def unknown_keys(payload: Column, allowed: tuple[str, ...]) -> Column:
    """Keys of a map that are no columns; those that begin with an underscore don't count."""
    return F.array_sort(F.filter(F.array_except(F.map_keys(payload), F.array(*map(F.lit, allowed))), lambda k: ~k.startswith("_")))


__all__ = ["canonical_skills", "has_content", "job_row", "join_list", "list_tokens", "repaired_segments", "resume_row", "salvaged", "salvaged_objects", "segments", "unknown_keys"]

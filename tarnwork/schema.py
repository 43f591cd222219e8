"""The four tables: columns in order, with their types; dates are epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L, _LIST = T.StringType(), T.DoubleType(), T.LongType(), T.ArrayType(T.StringType())
_FILES = T.ArrayType(T.StructType([T.StructField(n, _L if n == "size" else _S) for n in ("filename", "size", "type", "url", "resourceId")]))


def _table(names: str, **kinds) -> T.StructType:
    """Columns in order; those that are not named again are texts."""
    return T.StructType([T.StructField(n, kinds.get(n, _S)) for n in names.split()])


# Columns of the tables.
RESUME = _table(
    "name phone email education school school_rank years_experience major certificates expected_position expected_location expected_salary skills attachment "
    "upload_time category comm_status org full_text attach_md5 source_file ai_extract ai_deep ai_refined_at",
    years_experience=_D, skills=_LIST, attachment=_FILES, upload_time=_L, ai_refined_at=_L,
)
JOB = _table(
    "job_id job_name department org status work_location responsibilities requirements hard_gates must_skills bonus_skills ai_refined_at must_weight "
    "bonus_weight submit_time attachment stat_total stat_recommend stat_pending stat_reject",
    work_location=_LIST, ai_refined_at=_L, must_weight=_D, bonus_weight=_D, submit_time=_L, attachment=_FILES, stat_total=_D, stat_recommend=_D,
    stat_pending=_D, stat_reject=_D,
)
MATCH = _table(
    "name phone job_name job_id org source cand_skills must_skills bonus_skills hard_gates expected_position years_experience skill_score bonus_score "
    "total_score recommend update_time evidence ai_analysis",
    skill_score=_D, bonus_score=_D, total_score=_D, update_time=_L,
)
PERM = _table("user org")
TABLES = {"resume": RESUME, "job": JOB, "match": MATCH, "perm": PERM}

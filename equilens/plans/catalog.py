"""All registered queries: importing the plan modules fills the registry."""

from __future__ import annotations

from . import q_audit, q_metrics, q_mitigate, q_ml, q_models, q_profile, q_raw, q_sources, q_stream  # noqa: F401
from .registry import ORACLE, QUERIES, ROWS


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)


def survey_rows():
    return dict(ROWS)

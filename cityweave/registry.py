"""All registered queries and their SQL oracles."""

from __future__ import annotations

from .plans import base, dialogue_jobs, evaluation_jobs, io_jobs, mcq_jobs, mix_jobs, place_jobs, reasoning_jobs, record_jobs, scalar_jobs, sequence_jobs, topology_jobs  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)

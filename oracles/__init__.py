"""Check queries in plain SQL, one per job, for an independent engine.

``JOBS`` reads the five funnel tables by name. ``with_star`` puts their
derivation from the star schema in front, so that a check runs on the same
files as the job. The SQL counts in another way than the plans do: one scalar
subquery per step, row-level joins, and ride counts looked up by equality.
"""

from oracles.extract import EXTRACT
from oracles.funnels import FUNNELS
from oracles.profile import PROFILE
from oracles.star import STAR

JOBS: dict[str, str] = {**PROFILE, **FUNNELS, **EXTRACT}


def with_star(sql: str) -> str:
    return f"WITH {STAR}, job AS ({sql}) SELECT * FROM job"

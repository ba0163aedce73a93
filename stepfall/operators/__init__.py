from stepfall.operators.activity import (
    payments_per_user,
    reached,
    reviews_per_user,
    ride_reach,
    rides_per_user,
    stack_facts,
)
from stepfall.operators.grain import CELL, attribute, ever_flags, user_cells
from stepfall.operators.metrics import pct_of_previous, pct_of_top, segment_share
from stepfall.operators.skew import hot_keys, split_join
from stepfall.operators.steps import Step, step_rows, step_table

__all__ = [
    "CELL",
    "Step",
    "attribute",
    "ever_flags",
    "hot_keys",
    "payments_per_user",
    "pct_of_previous",
    "pct_of_top",
    "reached",
    "reviews_per_user",
    "ride_reach",
    "rides_per_user",
    "segment_share",
    "split_join",
    "stack_facts",
    "step_rows",
    "step_table",
    "user_cells",
]

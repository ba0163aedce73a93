from stepfall.functions.columns import all_present, day_of, day_start, flag, seconds_between
from stepfall.functions.ratios import quotient, ratio4, remainder4

__all__ = [
    "all_present",
    "day_of",
    "day_start",
    "flag",
    "quotient",
    "ratio4",
    "remainder4",
    "seconds_between",
]

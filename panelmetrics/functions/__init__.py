from .dates import falls_on, month_first_date, sunday_week, weekday_name, year_start
from .numbers import NORMALISED_FLOOR, growth, or_else, ordered_sum, per_panel, ratio
from .text import any_like, blank_padded, first_five, left_padded, number_padded

__all__ = [
    "NORMALISED_FLOOR",
    "any_like",
    "blank_padded",
    "falls_on",
    "first_five",
    "growth",
    "left_padded",
    "month_first_date",
    "number_padded",
    "or_else",
    "ordered_sum",
    "per_panel",
    "ratio",
    "sunday_week",
    "weekday_name",
    "year_start",
]

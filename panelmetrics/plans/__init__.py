from .reports import (
    WeeklySeries,
    cancel_add_by_state,
    contribution_by_county,
    gap_by_county,
    report_set,
    weekly_growth,
    weekly_market_share,
    write_reports,
)

__all__ = [
    "WeeklySeries",
    "cancel_add_by_state",
    "contribution_by_county",
    "gap_by_county",
    "report_set",
    "weekly_growth",
    "weekly_market_share",
    "write_reports",
]

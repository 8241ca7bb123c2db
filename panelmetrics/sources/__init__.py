from .dates import date_bounds, last_order_date, order_dates
from .dimension_csv import read_code_list
from .rejects import Checked, checked_codes, checked_dates, read_checked_code_list
from .star_schema import star_schema_tables
from .tables import PanelTables, panel_tables

__all__ = [
    "Checked",
    "PanelTables",
    "checked_codes",
    "checked_dates",
    "date_bounds",
    "last_order_date",
    "order_dates",
    "panel_tables",
    "read_checked_code_list",
    "read_code_list",
    "star_schema_tables",
]

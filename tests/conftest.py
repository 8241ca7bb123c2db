import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from panelmetrics.session import local_session  # noqa: E402
from panelmetrics.sources import PanelTables  # noqa: E402

SCHEMAS = {
    "items": "mailboxid long, orderid long, orderdate date, merchant string, itemdescription string, "
    "itemquantity decimal(12,2), itemprice decimal(12,2), ordertotal decimal(12,2)",
    "panel": "date date, panel long",
    "quality_merchants": "merchant string",
    "merchant_sector": "merchant string, sector string",
    "mailbox_zip": "mailboxid long, shiptozip string",
    "cohort": "mailboxid long, udate date, cohort string",
    "geo": "zipcode string, fips string, msa string, state_abbrev string",
}


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_tables(spark):
    """PanelTables from rows given per table; tables left out are empty."""

    def make(**rows) -> PanelTables:
        return PanelTables(
            **{name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()}
        )

    return make


@pytest.fixture(scope="session")
def item():
    """One item row with defaults, as a tuple in schema order."""
    from decimal import Decimal

    def build(day, text="red widget", *, mailbox=1, order=1, merchant="Shop", quantity=1, price=10, total=10):
        def money(value):
            return None if value is None else Decimal(str(value))

        if isinstance(day, str):
            day = dt.date.fromisoformat(day)
        return (mailbox, order, day, merchant, text, money(quantity), money(price), money(total))

    return build

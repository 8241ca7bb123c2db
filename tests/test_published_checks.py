"""Every clause of the published rules holds for some text and merchant of its registered query."""

import pytest

from checks.published import EVENT_RULES, GROWTH_RULES, merchants_of, texts_of
from panelmetrics.operators.rules import clause_holds
from panelmetrics.plans import published


@pytest.mark.parametrize("rules", [published.SHARE_RULES, GROWTH_RULES, EVENT_RULES], ids=["share", "growth", "events"])
def test_every_clause_holds_for_some_row(spark, rules):
    rows = [(t, m) for t in texts_of(rules) for m in merchants_of(rules)]
    frame = spark.createDataFrame(rows, "itemdescription string, merchant string").selectExpr("*", "date '2018-01-01' as orderdate")
    clauses = [clause for rule in rules for clause in rule.clauses]
    held = frame.select(*[clause_holds(c).cast("int").alias(f"c{i}") for i, c in enumerate(clauses)])
    totals = held.groupBy().sum().first()
    assert all(totals)

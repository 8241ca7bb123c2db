"""The published rules on texts made from their own patterns, one query per group of rules.

Items of the sales fact get a text and a merchant by their order number, so that every text meets every
merchant; dates are moved so that the published date floor lies inside them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmetrics.operators.rules import BrandRule, Clause, tag_brands, tag_brands_by_text
from panelmetrics.plans import published

from .base import Inputs, check, with_views

SHIFT_DAYS = 6570


def patterns_of(rules: tuple[BrandRule, ...]) -> list[str]:
    """Every pattern of the rules, once."""
    clauses = [clause for rule in rules for clause in rule.clauses]
    return list(dict.fromkeys(p for c in clauses for p in (*c.any_of, *c.and_any_of, *c.none_of)))


def texts_of(rules: tuple[BrandRule, ...]) -> list[str]:
    """A text for each pattern (in its case and in capitals), texts for pairs of clauses, and one that none wants."""
    filled = [p.replace("%", " x ").strip() for p in patterns_of(rules)]
    pairs = [f"{a} {b}" for rule in rules for c in rule.clauses for a in c.any_of[:1] for b in c.and_any_of]
    both = [p.replace("%", " x ").strip() for p in pairs]
    return [*filled, *[t.upper() for t in filled], *both, "plain water"]


def merchants_of(rules: tuple[BrandRule, ...]) -> list[str]:
    """Excluded and named merchants of the rules, and one that no rule names."""
    clauses = [clause for rule in rules for clause in rule.clauses]
    excluded = [m for r in (*rules, *clauses) for m in r.excluded_merchants]
    named = [c.merchant for c in clauses if c.merchant]
    return sorted({"Corner Shop", excluded[0], excluded[-1], *excluded[5:7], *named}) if excluded else ["Corner Shop"]


def listed(values: list[str], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place + 1).cast("int"))


def dressed(t: Inputs, rules: tuple[BrandRule, ...]) -> DataFrame:
    """Item rows with published-like texts, merchants and dates."""
    texts, merchants = texts_of(rules), merchants_of(rules)
    order = F.col("orderid")
    return t.sales.items.select(
        "orderid",
        F.date_add("orderdate", SHIFT_DAYS).alias("orderdate"),
        listed(texts, order % len(texts)).alias("itemdescription"),
        listed(merchants, F.floor(order / len(texts)) % len(merchants)).alias("merchant"),
    )


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def any_like_sql(patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"itemdescription ILIKE {quoted([p])}" for p in patterns) + ")"


def clause_sql(clause: Clause) -> str:
    tests = [any_like_sql(clause.any_of)]
    tests += [any_like_sql(clause.and_any_of)] if clause.and_any_of else []
    tests += [f"merchant = {quoted([clause.merchant])}"] if clause.merchant else []
    tests += [f"merchant NOT IN ({quoted(clause.excluded_merchants)})"] if clause.excluded_merchants else []
    tests += [f"orderdate >= DATE '{clause.since}'"] if isinstance(clause.since, dt.date) else []
    tests += [f"NOT itemdescription ILIKE {quoted([p])}" for p in clause.none_of]
    return "(" + " AND ".join(tests) + ")"


def rules_sql(rules: tuple[BrandRule, ...]) -> str:
    """One branch per rule over the dressed items."""
    texts, merchants = texts_of(rules), merchants_of(rules)
    view = f"""dressed AS (SELECT orderid, orderdate + {SHIFT_DAYS} AS orderdate,
  ([{quoted(texts)}])[orderid % {len(texts)} + 1] AS itemdescription,
  ([{quoted(merchants)}])[(orderid // {len(texts)}) % {len(merchants)} + 1] AS merchant FROM fact_items)"""
    branches = []
    for rule in rules:
        holds = " OR ".join(clause_sql(c) for c in rule.clauses)
        barred = f" AND merchant NOT IN ({quoted(rule.excluded_merchants)})" if rule.excluded_merchants else ""
        branches.append(
            f"SELECT {quoted([rule.brand])} AS brand, orderid, merchant, itemdescription FROM dressed WHERE ({holds}){barred}"
        )
    return with_views(" UNION ALL ".join(branches), view)


def tagged(t: Inputs, rules: tuple[BrandRule, ...]) -> DataFrame:
    return tag_brands(dressed(t, rules), rules).select("brand", "orderid", "merchant", "itemdescription")


def tagged_by_text(t: Inputs, rules: tuple[BrandRule, ...]) -> DataFrame:
    return tag_brands_by_text(dressed(t, rules), rules).select("brand", "orderid", "merchant", "itemdescription")


GROWTH_RULES = (published.TRULY_FOCUS, published.OTHER_GROWTH, published.WHITE_CLAW_GROWTH)
EVENT_RULES = (published.ADDS, published.CANCELS)


@check("p8_published_share_rules", rules_sql(published.SHARE_RULES))
def published_share_rules(t: Inputs) -> DataFrame:
    return tagged(t, published.SHARE_RULES)


@check("p9_published_growth_rules", rules_sql(GROWTH_RULES))
def published_growth_rules(t: Inputs) -> DataFrame:
    return tagged(t, GROWTH_RULES)


@check("p10_published_event_rules", rules_sql(EVENT_RULES))
def published_event_rules(t: Inputs) -> DataFrame:
    return tagged(t, EVENT_RULES)


@check("p8_share_rules_by_text", rules_sql(published.SHARE_RULES))
def share_rules_by_text(t: Inputs) -> DataFrame:
    return tagged_by_text(t, published.SHARE_RULES)


@check("p9_growth_rules_by_text", rules_sql(GROWTH_RULES))
def growth_rules_by_text(t: Inputs) -> DataFrame:
    return tagged_by_text(t, GROWTH_RULES)


@check("p10_event_rules_by_text", rules_sql(EVENT_RULES))
def event_rules_by_text(t: Inputs) -> DataFrame:
    return tagged_by_text(t, EVENT_RULES)

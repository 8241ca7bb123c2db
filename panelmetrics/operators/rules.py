"""Brand rules as data, and one-pass classification of item rows.

A rule is a list of clauses; an item belongs to the brand when any clause holds. A clause
carries its own merchant exclusions and date floor, because published rules differ in them
and some clauses (a named merchant with looser patterns) escape both.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import any_like
from ..session import settle


@dataclass(frozen=True)
class Clause:
    any_of: tuple[str, ...]
    and_any_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    merchant: str | None = None
    excluded_merchants: tuple[str, ...] = ()
    since: dt.date | None = None


@dataclass(frozen=True)
class BrandRule:
    brand: str
    clauses: tuple[Clause, ...]
    excluded_merchants: tuple[str, ...] = ()
    # Patterns that an item sold once in a week must match to be counted; empty = no test.
    singleton_any_of: tuple[str, ...] = ()


def clause_holds(clause: Clause) -> Column:
    text, merchant = F.col("itemdescription"), F.col("merchant")
    # Few items match any text, so the text decides first.
    tests = [any_like(text, clause.any_of)]
    if clause.and_any_of:
        tests.append(any_like(text, clause.and_any_of))
    if clause.merchant is not None:
        tests.append(merchant == clause.merchant)
    if clause.excluded_merchants:
        tests.append(~merchant.isin(*clause.excluded_merchants))
    if clause.since is not None:
        tests.append(F.col("orderdate") >= F.lit(clause.since))
    tests += [~text.ilike(pattern) for pattern in clause.none_of]
    return reduce(and_, tests)


def rule_holds(rule: BrandRule) -> Column:
    holds = reduce(or_, [clause_holds(clause) for clause in rule.clauses])
    if rule.excluded_merchants:
        holds = holds & ~F.col("merchant").isin(*rule.excluded_merchants)
    return holds


def tag_each(rows: DataFrame, conditions: Sequence[tuple[str, Column]], tag: str) -> DataFrame:
    """One output row per (label, condition) that holds, in one pass over the rows.

    Labels may repeat: a row is put out for each of their conditions that holds. The filter
    drops the rows no condition wants before any array is built, and lets Catalyst push
    what the conditions share down to the scan.
    """
    if len(conditions) == 1:
        ((label, holds),) = conditions
        return rows.filter(holds).withColumn(tag, F.lit(label))
    labels = [F.when(holds, F.lit(label)) for label, holds in conditions]
    wanted = rows.filter(reduce(or_, [holds for _, holds in conditions]))
    # Nulls go after the explode: dropping them inside the array would leave generated code.
    return wanted.withColumn(tag, F.explode(F.array(*labels))).filter(F.col(tag).isNotNull())


def tag_brands(items: DataFrame, rules: Sequence[BrandRule]) -> DataFrame:
    """Item rows with their brand; an item of several rules occurs once for each, also if two share a name."""
    return tag_each(items, [(rule.brand, rule_holds(rule)) for rule in rules], "brand")


def text_holds(clause: Clause, excluded_merchants: Sequence[str] = ()) -> Column:
    """What of a clause (and its rule's exclusions) depends on text and merchant only."""
    holds = clause_holds(replace(clause, since=None))
    return holds & ~F.col("merchant").isin(*excluded_merchants) if excluded_merchants else holds


def classified_texts(items: DataFrame, rules: Sequence[BrandRule]) -> DataFrame:
    """Distinct (merchant, itemdescription) that some rule wants: one row per text and rule, with `brand` and `first_day`.

    The rule holds for items of the text from `first_day` on, the earliest date floor of the clauses that hold, or
    at any date where it is null. `rule_no` tells rules of one name apart. Texts no rule wants are left out.
    """
    texts = items.select("merchant", "itemdescription").distinct()

    def first_day(rule: BrandRule) -> Column:
        # Clauses without a floor come first, so that the first match is the earliest date.
        clauses = sorted(rule.clauses, key=lambda c: (c.since is not None, c.since or dt.date.min))
        days = F.lit(None).cast("date")
        for clause in reversed(clauses):
            days = F.when(text_holds(clause, rule.excluded_merchants), F.lit(clause.since).cast("date")).otherwise(days)
        return days

    def holds(rule: BrandRule) -> Column:
        return reduce(or_, [text_holds(clause, rule.excluded_merchants) for clause in rule.clauses])

    found = [
        F.when(holds(rule), F.struct(F.lit(number).alias("rule_no"), F.lit(rule.brand).alias("brand"), first_day(rule).alias("first_day")))
        for number, rule in enumerate(rules)
    ]
    wanted = texts.filter(reduce(or_, [holds(rule) for rule in rules]))
    rows = wanted.withColumn("found", F.explode(F.array(*found))).filter(F.col("found").isNotNull())
    return rows.select("merchant", "itemdescription", "found.*")


def tag_brands_by_text(items: DataFrame, rules: Sequence[BrandRule], texts: DataFrame | None = None) -> DataFrame:
    """The same rows as `tag_brands`, with the rules evaluated once per distinct text and merchant.

    Pays where texts repeat much and patterns are many: items are read twice (first the two columns of the
    rules), and the patterns run on distinct texts only. The classified texts are settled, so Spark knows their
    size when it plans the join: it broadcasts them under its threshold, and else shuffles both sides, where
    adaptive execution splits a text of very many items. `texts` are classified texts kept from an earlier run.
    """
    texts = settle(classified_texts(items, rules)) if texts is None else texts
    known = texts.select(
        F.col("merchant").alias("text_merchant"), F.col("itemdescription").alias("text_item"), "brand", "first_day"
    )
    # Null-safe on both: through a plain equality Spark would carry the patterns over as a filter of the items.
    same = F.col("itemdescription").eqNullSafe(F.col("text_item"))
    joined = items.join(known, same & F.col("merchant").eqNullSafe(F.col("text_merchant")))
    in_time = F.col("first_day").isNull() | (F.col("orderdate") >= F.col("first_day"))
    return joined.filter(in_time).drop("text_merchant", "text_item", "first_day")


def distinct_brands(rules: Sequence[BrandRule]) -> None:
    """Reports tell brands apart by name, so two rules of one name are an error there."""
    names = [rule.brand for rule in rules]
    if len(set(names)) < len(names):
        raise ValueError(f"two rules share a name: {sorted(names)}")


def stack_brands(items: DataFrame, rules: Sequence[BrandRule]) -> DataFrame:
    """The same rows as `tag_brands` by stacking one filtered branch per brand.

    Reads the items once per rule; meant for few rules or for different inputs.
    """
    branches = [items.filter(rule_holds(rule)).withColumn("brand", F.lit(rule.brand)) for rule in rules]
    return reduce(DataFrame.unionByName, branches)

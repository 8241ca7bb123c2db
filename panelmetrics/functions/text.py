"""Text expressions for item patterns and zero-padded codes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_like(text: Column, patterns: Sequence[str]) -> Column:
    """True where the text matches at least one pattern, whatever the case.

    A pattern of several pieces runs as a regular expression, which is dear on every row
    of a large fact. A text that matches it contains all its pieces, so such patterns are
    tried only on texts that contain a piece they share.
    """
    tests = []
    for piece, group in _by_shared_piece(patterns):
        matches = reduce(or_, [text.ilike(pattern) for pattern in group])
        several = any(len(_pieces(pattern)) > 1 for pattern in group)
        tests.append(F.lower(text).contains(piece) & matches if several else matches)
    return reduce(or_, tests)


def _by_shared_piece(patterns: Sequence[str]) -> list[tuple[str | None, list[str]]]:
    """Patterns grouped by a literal piece they have in common, most widely shared first.

    Patterns without a usable piece come under None.
    """
    waiting, groups = list(dict.fromkeys(patterns)), []
    while waiting:
        uses = Counter(piece for pattern in waiting for piece in _pieces(pattern))
        piece = max(uses, key=lambda p: (uses[p], len(p), p)) if uses else None
        group = [p for p in waiting if piece is None or any(piece in other for other in _pieces(p))]
        groups.append((piece, group))
        waiting = [p for p in waiting if p not in group]
    return groups


def _pieces(pattern: str) -> set[str]:
    """Literal parts of a pattern in lower case; none where lower case is not plain."""
    if "\\" in pattern or not pattern.isascii():
        return set()
    return {piece for piece in re.split("[%_]", pattern.lower()) if piece}


def first_five(text: Column) -> Column:
    return F.substring(text, 1, 5)


def blank_padded(code: Column) -> Column:
    """Last five characters after zero-padding; a missing code becomes 00000."""
    return F.right(F.concat(F.lit("00000"), F.coalesce(code, F.lit(""))), F.lit(5))


def left_padded(code: Column) -> Column:
    """First five characters after zero-padding; a missing code stays missing."""
    return F.lpad(code, 5, "0")


def number_padded(number: Column) -> Column:
    """Whole number written with at least five digits."""
    return F.format_string("%05d", number.cast("long"))

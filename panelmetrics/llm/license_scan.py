"""License scans with a positional index of rare words, in Spark expressions only.

A template is a notice with one mandatory key phrase in it. The words of all key phrases are
the licence words. One pass counts in how many documents each of them occurs (its IDF over this corpus).
The index holds, per template, the postings of the two rarest words of its key phrase: word, template and offset.

A second pass looks each file up in the index. Templates whose licence words are not all in the file are out;
the postings of the others are the file's highest-IDF licence words. Every place of such a word gives, by each of its
postings, a place where a template would start; places that both words of a template agree on are left
(one intersection for all templates), and at these the whole key phrase is verified. A key phrase that is
present has all its words in the file and its rarest words at their places, so nothing is lost. The share of the
notice's words that stand at their places around the phrase is the match's coverage.

What is gathered on the driver is one number per licence word.

Defined cases: a null text has no words; documents without a match have empty `matches`; rows
that repeat are scanned each; a null doc_id is carried; other columns are not read. An empty
table gives an empty result (all document frequencies are 0, so any words may be the rarest).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmetrics.llm.common import text_of

PLACES = 1 << 32  # a template and a place in a text as one number
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    phrase: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.phrase.split()

    @property
    def lead(self) -> int:
        """Words of the notice before the key phrase."""
        before = f" {self.notice} ".index(f" {self.phrase} ")
        return len(self.notice[: max(0, before - 1)].split()) if before else 0


# Notices of public licences and their key phrases, lower-cased without punctuation.
TEMPLATES = (
    Template("mit", "released under the mit license", "under the mit license", base=True),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2", base=True),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", base=True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international", "creative commons attribution noncommercial"),
    Template("cc0", "to the extent possible under law waived all copyright cc0 1 0 universal", "cc0 1 0 universal"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
)


def lowered(text: Column) -> Column:
    """A-Z in lower case. Other letters may change too, but none of them becomes or parts a word of
    ASCII letters: the two that would (U+212A, U+0130) take the slower way."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    odd = text.contains("K") | text.contains("İ")
    return F.when(odd, F.translate(text, letters, letters.lower())).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    """Words of a text; pieces that are empty because the text begins or ends with a separator go."""
    return F.array_remove(F.split(lowered(text), SEPARATORS), "")


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def document_frequencies(documents: DataFrame, templates: tuple[Template, ...], text_column: str) -> dict[str, int]:
    """Documents that hold each licence word; one row per licence word reaches the driver."""
    vocabulary = sorted({w for t in templates for w in t.words})
    held = documents.select(
        F.explode(F.array_intersect(words_of(text_of(documents, text_column)), strings(vocabulary))).alias("word")
    )
    counts = {row["word"]: row["n"] for row in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {word: counts.get(word, 0) for word in vocabulary}


def index_words(template: Template, frequencies: dict[str, int]) -> list[tuple[str, int]]:
    """The two rarest words of the key phrase with their offsets in it."""
    places = sorted((frequencies[w], w, i) for i, w in enumerate(template.words))
    return [(w, i) for _, w, i in places[:2]]


def index_of(templates: tuple[Template, ...], frequencies: dict[str, int]) -> tuple[Column, Column]:
    """The index as two literal arrays: templates (number, label, ...) and postings (word, number, offset, second)."""
    cards = [
        F.struct(
            F.lit(number).cast("long").alias("number"),
            F.lit(t.label).alias("label"),
            F.lit(t.base).alias("base"),
            strings(t.words).alias("phrase"),
            strings(t.notice.split()).alias("notice"),
            F.lit(t.lead).alias("lead"),
        )
        for number, t in enumerate(templates)
    ]
    postings = []
    for number, t in enumerate(templates):
        rare = index_words(t, frequencies)
        for second, (word, offset) in enumerate((rare * 2)[:2]):  # a phrase of one word agrees with itself
            postings.append(
                F.struct(
                    F.lit(word).alias("word"),
                    F.lit(number).cast("long").alias("number"),
                    F.lit(offset).alias("offset"),
                    F.lit(bool(second)).alias("second"),
                )
            )
    return F.array(*cards), F.array(*postings)


def bound(value: Column, use) -> Column:
    """use(value) with the value worked out once: inside lambdas, Spark works out any other expression per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches_in(words: Column, vocabulary: list[str], cards: Column, postings: Column) -> Column:
    """Matches of a file from its words and the index, by template and place."""

    def wanted_by(mine: Column) -> Column:
        """Postings of the templates whose licence words are all in the file."""
        inside = F.filter(cards, lambda c: F.size(F.array_except(c["phrase"], mine)) == 0)
        return bound(
            F.transform(inside, lambda c: c["number"]), lambda n: F.filter(postings, lambda p: F.array_contains(n, p["number"]))
        )

    def spots_of(words: Column, rare: Column) -> Column:
        """Places of the file's rare licence words."""
        each = F.transform(words, lambda w, i: F.when(F.array_contains(rare, w), F.struct(w.alias("word"), i.alias("place"))))
        return F.filter(each, lambda spot: spot.isNotNull())

    def starts(spots: Column, wanted: Column, second: bool) -> Column:
        """Template and start as one number, by the first or the second rare word of each template."""

        def of_spot(spot: Column) -> Column:
            mine = F.filter(wanted, lambda p: (p["word"] == spot["word"]) & (p["second"] == second) & (spot["place"] >= p["offset"]))
            return F.transform(mine, lambda p: p["number"] * PLACES + (spot["place"] - p["offset"]))

        return F.flatten(F.transform(spots, of_spot))

    def match(words: Column, found: Column) -> Column:
        start = found % PLACES

        def of_card(card: Column) -> Column:
            there = F.transform(card["notice"], lambda w, j: F.get(words, (start + (j - card["lead"])).cast("int")) == w)
            return F.struct(
                card["label"].alias("label"),
                card["base"].alias("base"),
                start.alias("start"),
                (F.size(F.filter(there, lambda same: same)) / F.size(card["notice"]).cast("double")).alias("coverage"),
            )

        return bound(F.get(cards, F.floor(found / PLACES).cast("int")), of_card)

    def verified(words: Column, found: Column) -> Column:
        phrase = F.get(cards, F.floor(found / PLACES).cast("int"))["phrase"]
        return bound(phrase, lambda p: F.slice(words, (found % PLACES + 1).cast("int"), F.size(p)) == p)

    def of_words(words: Column) -> Column:
        def of_wanted(wanted: Column) -> Column:
            rare = F.array_distinct(F.transform(wanted, lambda p: p["word"]))
            spots = bound(rare, lambda r: spots_of(words, r))
            aligned = bound(spots, lambda s: F.array_sort(F.array_intersect(starts(s, wanted, False), starts(s, wanted, True))))
            return F.transform(F.filter(aligned, lambda f: verified(words, f)), lambda f: match(words, f))

        return bound(bound(F.array_intersect(words, strings(vocabulary)), wanted_by), of_wanted)

    return bound(words, of_words)


def scan_licenses(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    templates: tuple[Template, ...] = TEMPLATES,
) -> DataFrame:
    """One row per document: doc_id, n_words, matches (label, base, start, coverage)."""
    frequencies = document_frequencies(documents, templates, text_column)
    rarest = sorted({index_words(t, frequencies)[0][0] for t in templates})
    cards, postings = index_of(templates, frequencies)
    frame = documents.select(
        documents[id_column].alias("doc_id"), words_of(text_of(documents, text_column)).alias("words")
    )
    words = F.col("words")
    none = F.expr("cast(array() as array<struct<label:string,base:boolean,start:bigint,coverage:double>>)")
    return frame.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.when(F.arrays_overlap("words", strings(rarest)), matches_in(words, sorted(frequencies), cards, postings)).otherwise(none).alias("matches"),
    )


def license_labels(scanned: DataFrame) -> DataFrame:
    """Labels and places of each document from its matches."""
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])

    def joined(matches: Column | str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined("matches").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("score"),
    )


def oracle_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """DuckDB SQL for the labels, by plain comparison at every word."""

    def listed(words: list[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    found = []
    for t in templates:
        notice = t.notice.split()
        hits = " + ".join(
            f"case when i + {j - t.lead} >= 1 and words[i + {j - t.lead}] = '{w}' then 1 else 0 end" for j, w in enumerate(notice)
        )
        found.append(
            f"list_transform(list_filter(range(1, n_words + 1), lambda i: words[i:i + {len(t.words) - 1}] = {listed(t.words)}), "
            f"lambda i: {{'label': '{t.label}', 'base': {str(t.base).lower()}, 'start': i - 1, "
            f"'coverage': ({hits}) / {len(notice)}.0::double}})"
        )
    separators = re.sub(r"^\[", "[^", SEPARATORS)
    return f"""
with split as (
    select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{separators}') as words
    from documents
),
sized as (select doc_id, words, len(words) as n_words from split),
found as (select doc_id, n_words, list_concat({', '.join(found)}) as matches from sized),
parts as (select *, list_filter(matches, lambda m: m.base) as bases from found)
select doc_id, n_words, len(bases)::bigint as n_base,
       list_min(list_transform(bases, lambda m: m.start))::bigint as first_word,
       list_max(list_transform(bases, lambda m: m.start))::bigint as last_word,
       coalesce(array_to_string(list_sort(list_distinct(list_transform(bases, lambda m: m.label))), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_transform(matches, lambda m: m.label))), ','), '') as labels,
       coalesce(list_max(list_transform(matches, lambda m: m.coverage)), 0)::double as score
from parts
"""

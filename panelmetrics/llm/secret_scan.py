"""Secret scans with corpus-wide ownership frequency, in Spark expressions only.

Candidates are the texts that four patterns find: assignments, access keys, long hexadecimal
numbers, and loose tokens (24 or more characters with small and capital letters and digits). The
texts between the matches give their places: a span starts after the lengths of all that comes
before it, summed by a window over the matches of a document, so the work is linear in them.

Every candidate is counted by the SHA-256 of its value, by distinct owners (sources) and repositories (documents):
distinct (hash, owner, repository) first, which spreads a value that a third of the rows hold, then
sums that combine before they move. Values are neither moved nor written. A value that `example_owners` owners or
more hold is a widely copied example; any other is live-looking. Live-looking values that stand in
SPREAD_REPOSITORIES repositories or more are told apart: few owners copy them widely, as boilerplate of their
own (`n_spread` of the digest counts them). Documents of different owners that hold one text count for each owner. Spans
of the first three kinds are always reported; loose tokens only when live-looking. redact() replaces live-looking spans.

Defined cases: a null text is empty; a null owner is an owner of its own, and so is a null
repository; rows that repeat are scanned each (as one repository of the count, having the same
id); columns other than the three named are not read by find_secrets() and carried by
redact(). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmetrics.llm.common import text_of, written

# The patterns, by kind in the order of reports.
ASSIGN = (
    "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    "|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "(AKIA[A-Z0-9]+)"
HEX = "([0-9a-f]+)"
LOOSE = "([A-Za-z0-9+/_=-]+)"
KINDS = (("assign", ASSIGN, 8), ("access", ACCESS, 16), ("hex", HEX, 32), ("loose", LOOSE, 24))
# What a text must hold to be worth the patterns of a kind.
HINTS = {
    "assign": "(?i:password|passwd|secret|token|api_?key)",
    "access": "AKIA[A-Z0-9]",
    "hex": "[0-9a-f]{32}",
    "loose": "[A-Za-z0-9+/_=-]{24}",
}
BASE = ("assign", "access", "hex")
EXAMPLE_OWNERS = 3
SPREAD_REPOSITORIES = 10
MARK = "[SECRET]"


def hinted(text: Column) -> Column:
    """Whether a text can hold a candidate."""
    return text.rlike("|".join(HINTS[kind] for kind, _, _ in KINDS))


def pieces_of(text: Column) -> Column:
    """Matches of all kinds: array of (kind, place, gap, size, chars, mixed, hash); gap is the text before.

    Values stay in the pass that finds them: what is kept of one is its length, whether it mixes small and
    capital letters and digits, and its SHA-256.
    """

    def of_kind(number: int) -> Column:
        kind, pattern, _ = KINDS[number]
        # runs that are too short are left in the gaps; short assignments are dropped later, as they consume text
        if kind in ("hex", "loose"):
            pattern = pattern.replace("+)", f"{{{KINDS[number][2]},}})")
        gaps = F.split(text, pattern)
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        return F.transform(
            F.arrays_zip(whole.alias("whole"), values.alias("value")),
            lambda m, i: F.struct(
                F.lit(number).alias("kind"),
                i.alias("place"),
                F.length(F.get(gaps, i)).alias("gap"),
                F.length(m["whole"]).alias("size"),
                F.length(m["value"]).alias("chars"),
                (m["value"].rlike("[a-z]") & m["value"].rlike("[A-Z]") & m["value"].rlike("[0-9]")).alias("mixed"),
                F.unhex(F.sha2(m["value"], 256)).alias("hash"),
            ),
        )

    fields = "kind:int,place:int,gap:int,size:int,chars:int,mixed:boolean,hash:binary"
    none = F.expr(f"cast(array() as array<struct<{fields}>>)")
    kinds = [F.when(text.rlike(HINTS[k]), of_kind(i)).otherwise(none) for i, (k, _, _) in enumerate(KINDS)]
    return F.when(hinted(text), F.concat(*kinds)).otherwise(none)


def judged_spans(rows: DataFrame, example_owners: int) -> DataFrame:
    """(key, kind, start, end, live) from rows of (key, owner, repository, pieces)."""
    each = rows.select("key", "owner", "repository", F.explode("pieces").alias("p")).select(
        "key", "owner", "repository", "p.*"
    )
    before = Window.partitionBy("key", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).withColumn(
        "start", F.col("end") - F.col("size")
    )
    kind = F.col("kind")
    long_enough = F.when(kind == 0, F.col("chars") >= KINDS[0][2]).when(kind == 1, F.col("size") >= KINDS[1][2])
    spans = placed.where(long_enough.when(kind == 2, F.lit(True)).otherwise(F.col("mixed")))
    owned = (
        spans.select("hash", "owner", "repository")
        .distinct()
        .groupBy("hash", "owner")
        .agg(F.count(F.lit(1)).alias("repositories"))
        .groupBy("hash")
        .agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    )
    judged = spans.join(owned, "hash").withColumn("live", F.col("owners") < example_owners)
    return judged.where("kind < 3 or live").select("key", "kind", "start", "end", "live", "owners", "repositories")


def located(documents: DataFrame, id_column: str, text_column: str, owner_column: str) -> DataFrame:
    """One small row per document, kept in the shared folder: key, doc_id, owner, repository, pieces."""
    frame = documents.select(
        documents[id_column].alias("doc_id"),
        documents[owner_column].cast("string").alias("owner"),
        documents[id_column].cast("string").alias("repository"),
        pieces_of(text_of(documents, text_column)).alias("pieces"),
    )
    return written(frame.withColumn("key", F.monotonically_increasing_id()), "secrets")


def find_secrets(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    owner_column: str = "source",
    example_owners: int = EXAMPLE_OWNERS,
) -> DataFrame:
    """One row per document: doc_id, spans (start, kind, end, live, owners, repositories) by start, then kind."""
    rows = located(documents, id_column, text_column, owner_column)
    spans = judged_spans(rows.where(F.size("pieces") > 0), example_owners)
    span = F.struct("start", "kind", "end", "live", "owners", "repositories")
    listed = spans.groupBy("key").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    none = F.expr(
        "cast(array() as array<struct<start:bigint,kind:int,end:bigint,live:boolean,owners:bigint,repositories:bigint>>)"
    )
    return (
        rows.select("key", "doc_id").join(listed, "key", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
    )


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans of each document."""
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    names = F.array(*[F.lit(k) for k, _, _ in KINDS])

    def joined(spans: Column | str) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
            ",",
        )

    counts = [
        F.size(F.filter("spans", _of_kind(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(BASE)
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: s["live"] & (s["repositories"] >= SPREAD_REPOSITORIES))).cast("long").alias("n_spread"),
    )


def _of_kind(number: int):
    return lambda span: span["kind"] == number


def redact(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    owner_column: str = "source",
    example_owners: int = EXAMPLE_OWNERS,
) -> DataFrame:
    """All documents, with live-looking spans replaced by MARK; other columns stay as they are.

    Documents that hold no hint pass by; the others are kept in the shared folder under a key of
    their own, so that ids may repeat or be null. Spans that overlap are replaced as one.
    """
    text = text_of(documents, text_column)
    held = written(
        documents.where(hinted(text)).select(
            F.struct(*[documents[c] for c in documents.columns]).alias("whole"),
            documents[owner_column].cast("string").alias("owner"),
            documents[id_column].cast("string").alias("repository"),
            pieces_of(text).alias("pieces"),
            F.monotonically_increasing_id().alias("key"),
        ),
        "hinted",
    )
    live = judged_spans(held.select("key", "owner", "repository", "pieces"), example_owners).where("live")
    ordered = Window.partitionBy("key").orderBy("start", "end")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    islands = (
        live.withColumn("reach", F.max("end").over(earlier))
        .withColumn("island", F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(ordered))
        .groupBy("key", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("islands"))
    )
    plain, cuts = F.col("whole")[text_column], F.col("islands")

    def kept_before(cut: Column, place: Column) -> Column:
        from_ = F.coalesce(F.get(cuts, place - 1)["end"], F.lit(0))
        return F.concat(F.substr(plain, (from_ + 1).cast("int"), (cut["start"] - from_).cast("int")), F.lit(MARK))

    tail = F.substr(plain, (F.element_at(cuts, -1)["end"] + 1).cast("int"))
    cleaned = F.when(cuts.isNull(), plain).otherwise(F.concat(F.array_join(F.transform(cuts, kept_before), ""), tail))
    redacted = held.join(islands, "key", "left").select(
        *[(cleaned if c == text_column else F.col("whole")[c]).alias(c) for c in documents.columns]
    )
    free = documents.where(~hinted(text))
    return free.unionByName(redacted)


def oracle_sql(example_owners: int = EXAMPLE_OWNERS) -> str:
    """DuckDB SQL for secret_digest(find_secrets(documents))."""
    branches = []
    for number, (kind, pattern, least) in enumerate(KINDS):
        if kind in ("hex", "loose"):
            pattern = pattern.replace("+)", f"{{{least},}})")
        quoted = pattern.replace("'", "''")
        hint = HINTS[kind].replace("'", "''")
        branches.append(
            f"select doc_id, source, {number} as kind, string_split_regex(text, '{quoted}') as gaps, "
            f"regexp_extract_all(text, '{quoted}', 0) as whole, regexp_extract_all(text, '{quoted}', 1) as vals "
            f"from documents where regexp_matches(text, '{hint}')"
        )
    names = ", ".join(f"'{k}'" for k, _, _ in KINDS)
    return f"""
with found as ({' union all '.join(branches)}),
each as (
    select doc_id, source, kind, unnest(range(1, len(whole) + 1)) as place, gaps, whole, vals from found
),
sized as (
    select doc_id, source, kind, place, length(gaps[place]) as gap, length(whole[place]) as size, vals[place] as val
    from each
),
placed as (
    select *, sum(gap + size) over (partition by doc_id, kind order by place) as stop from sized
),
good as (
    select doc_id, source, kind, cast(stop - size as bigint) as start, cast(stop as bigint) as stop, val from placed
    where case kind when 0 then length(val) >= 8 when 1 then size >= 16 when 2 then true
          else regexp_matches(val, '[a-z]') and regexp_matches(val, '[A-Z]') and regexp_matches(val, '[0-9]') end
),
owned as (
    select val, count(distinct coalesce(source, '')) as owners, count(distinct (coalesce(source, ''), doc_id)) as repositories
    from good group by val
),
judged as (
    select doc_id, kind, start, stop, owners < {example_owners} as live, repositories,
           [{names}][kind + 1] || ':' || start || ':' || stop as span
    from good join owned using (val) where kind < 3 or owners < {example_owners}
),
listed as (
    select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access,
           count(*) filter (kind = 2) as n_hex,
           string_agg(span, ',' order by start, kind) filter (kind < 3) as base,
           string_agg(span, ',' order by start, kind) as spans, count(*) filter (live) as n_live,
           count(*) filter (live and repositories >= {SPREAD_REPOSITORIES}) as n_spread
    from judged group by doc_id
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_spread, 0) as n_spread
from documents left join listed using (doc_id)
"""

"""SQL of the two vector operators: every part compared with every entry, round by round."""

from __future__ import annotations

FLOORED = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"


def squared(left: str, right: str, width: int) -> str:
    """The squared distance of two lists, written out."""
    return " + ".join(f"({left}[{i}] - {right}[{i}]) * ({left}[{i}] - {right}[{i}])" for i in range(1, width + 1))


def finite(vector: str) -> str:
    return f"{vector} is not null and len(list_filter({vector}, lambda x: x is null or not isfinite(x))) = 0"


def whole(vector: str, scale: int) -> str:
    return f"list_transform({vector}, lambda x: cast(floor({scale} * cast(x as double)) as bigint))"


def rounds_sql(count: int, entries: str, points: str, key: str, width: int) -> str:
    """CTEs a1, c1, ..., up to the last assignment, from c0 (part, entry, cen) and a view of points (part, key, q)."""
    steps = []
    for number in range(count + 1):
        steps.append(
            f"a{number} as materialized (select part, {key}, any_value(q) as q, "
            f"min(d * {entries} + entry) % {entries} as entry, min(d * {entries} + entry) // {entries} as d "
            f"from (select p.part, p.{key}, p.q, c.entry, {squared('p.q', 'c.cen', width)} as d "
            f"from {points} p join c{number} c on p.part = c.part) group by part, {key})"
        )
        if number < count:
            steps.append(
                f"m{number} as (select part, entry, dim, {FLOORED} as mean from "
                f"(select part, entry, unnest(q) as x, generate_subscripts(q, 1) as dim from a{number}) group by part, entry, dim)"
            )
            steps.append(
                f"c{number + 1} as materialized (select c.part, c.entry, coalesce(n.cen, c.cen) as cen from c{number} c left join "
                f"(select part, entry, list(cast(mean as bigint) order by dim) as cen from m{number} group by part, entry) n "
                "on n.part = c.part and n.entry = c.entry)"
            )
    return ",\n".join(steps)


def codes_sql(parts: int, scale: int, entries: int, rounds: int, width: int) -> str:
    """Product codes of vectors of parts * width components."""
    return f"""
with v as (select vec_id, label, {whole('embedding', scale)} as q from embeddings where {finite('embedding')}),
p as materialized (
    select part, vec_id, q[part * {width} + 1 : part * {width} + {width}] as q from v, range({parts}) t(part)
),
c0 as materialized (
    select part, entry, q as cen
    from (select *, row_number() over (partition by part order by vec_id) - 1 as entry from p) where entry < {entries}
),
{rounds_sql(rounds, str(entries), 'p', 'vec_id', width)},
coded as (
    select vec_id, string_agg(lower(printf('%02x', cast(entry as integer))), '' order by part) as code,
           cast(sum(d) as bigint) as error
    from a{rounds} group by vec_id
),
books as (
    select sha256(string_agg(cast(x as varchar), ',' order by part, entry, dim)) as codebooks_sha256
    from (select part, entry, unnest(cen) as x, generate_subscripts(cen, 1) as dim from c{rounds})
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from v join coded using (vec_id) cross join books
"""


def clusters_sql(width: int, scale: int, clusters: int, rounds: int) -> str:
    """Clusters of vectors with `width` components."""
    return f"""
with p as materialized (
    select 0 as part, vec_id, {whole('embedding', scale)} as q from embeddings
    where len(embedding) = {width} and {finite('embedding')}
),
c0 as materialized (
    select 0 as part, row_number() over (order by sha256('1:' || vec_id)) - 1 as entry, q as cen
    from p order by sha256('1:' || vec_id) limit {clusters}
),
{rounds_sql(rounds, str(clusters), 'p', 'vec_id', width)},
digests as (
    select entry, sha256(string_agg(cast(x as varchar), ',' order by dim)) as centroid_sha256
    from (select entry, unnest(cen) as x, generate_subscripts(cen, 1) as dim from c{rounds}) group by entry
)
select vec_id, cast(entry as integer) as cluster, cast(d as bigint) as distance,
       cast(sum(d) over (partition by entry) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
       centroid_sha256
from a{rounds} join digests using (entry)
"""

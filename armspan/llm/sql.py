"""SQL of the archive, the clusters and the vector codes; rounds are written out one after another."""

from __future__ import annotations

ARCHIVE = """
    with p as (
        select page_id, encode(coalesce(html, '')) as body from pages
    ),
    r as (
        select page_id, octet_length(body) as n, sha1(body) as digest,
            max(page_id) over (partition by body) as last
        from p
    )
    select page_id, n::bigint as payload_bytes, digest as payload_digest,
        case when n >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
        case when n >= 1000 and page_id <> last then last end as refers_to
    from r
"""


def _whole(scale: int, more: str, columns: str) -> str:
    """Kept vectors as whole numbers in doubles, which hold them exactly, each with a number of its own."""
    return f"""
        select row_number() over () as row_no, {columns},
            list_transform(embedding, lambda x: floor({scale} * x::double)) as v
        from embeddings
        where embedding is not null {more}
          and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
    """


_SQUARED = "list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, c.v) + list_dot_product(c.v, c.v)"


def _assigned(vectors: str, places: str) -> str:
    return f"""
        select x.row_no, x.part, min(struct_pack(d := ({_SQUARED})::bigint, place := c.place)) as best
        from {vectors} x join {places} c on c.part = x.part group by all
    """


def _moved(vectors: str, assigned: str, places: str) -> str:
    return f"""
        select c.part, c.place, coalesce(any_value(m.v), any_value(c.v)) as v
        from {places} c left join (
            select part, place, list(mean order by pos) as v
            from (
                select x.part, a.best.place as place, u.pos, floor(sum(x.v[u.pos]) / count(*)) as mean
                from {assigned} a
                join {vectors} x on x.row_no = a.row_no and x.part = a.part
                join (select unnest(range(1, 1 + (select max(len(v)) from {vectors}))) as pos) u on u.pos <= len(x.v)
                group by all
            )
            group by all
        ) m on m.part = c.part and m.place = c.place
        group by c.part, c.place
    """


def _rounds(rounds: int) -> list[str]:
    """Places p0 to assignments a<rounds> of the vectors in x."""
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} as materialized ({_assigned('x', f'p{i}')})")
        steps.append(f"p{i + 1} as materialized ({_moved('x', f'a{i}', f'p{i}')})")
    return [*steps, f"a{rounds} as materialized ({_assigned('x', f'p{rounds}')})"]


def clusters(centroids: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, label: str = "2:") -> str:
    return f"""
        with x as materialized (
            select *, 0 as part from ({_whole(scale, f"and len(embedding) = {dims}", "vec_id")})
        ),
        p0 as materialized (
            select 0 as part, (row_number() over (order by sha256('{label}' || vec_id), v) - 1)::int as place, v
            from x where vec_id is not null
            qualify place < {centroids}
        ),
        {", ".join(_rounds(rounds))},
        found as (
            select x.vec_id, a.best.place as cluster, a.best.d as distance
            from x join a{rounds} a on a.row_no = x.row_no
        )
        select vec_id, cluster, distance,
            sum(distance) over (partition by cluster)::bigint as cluster_inertia,
            sum(distance) over ()::bigint as inertia,
            sha256(array_to_string(list_transform(c.v, lambda y: y::bigint), ',')) as centroid_sha256
        from found join p{rounds} c on c.place = found.cluster
    """


def codes(entries: int = 256, rounds: int = 4, parts: int = 4, scale: int = 1024) -> str:
    return f"""
        with whole as materialized ({_whole(scale, "", "vec_id, label")}),
        width as (select greatest(1, ceil(max(len(v)) / {parts}))::bigint as n from whole),
        filled as (select * replace (list_concat(v, list_transform(range(n * {parts} - len(v)), lambda i: 0::double)) as v) from whole, width),
        x as materialized (
            select row_no, vec_id, label, part, v[(part * n + 1)::bigint:((part + 1) * n)::bigint] as v
            from filled, (select unnest(range({parts})) as part)
        ),
        firsts as materialized (
            select row_no, row_number() over (order by vec_id nulls last, v) - 1 as place
            from filled qualify place < {entries}
        ),
        p0 as materialized (
            select part, place::int as place, v from x join firsts using (row_no)
        ),
        {", ".join(_rounds(rounds))},
        found as (
            select row_no, sum(best.d)::bigint as error,
                string_agg(lpad(lower(to_hex(best.place)), 2, '0'), '' order by part) as code
            from a{rounds} group by all
        ),
        book as (
            select sha256(string_agg(array_to_string(list_transform(v, lambda y: y::bigint), ','), ',' order by part, place)) as digest
            from p{rounds}
        )
        select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
            digest as codebooks_sha256
        from found join whole using (row_no), book
    """

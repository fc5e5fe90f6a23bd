"""Oracle SQL of the text problems, for whole tables. Queries it can't express or only too slowly have none and are tested otherwise."""

_SETS = """
    s AS (SELECT id, statement FROM facts UNION SELECT id, CASE WHEN json_valid(proposed_fact) THEN proposed_fact::JSON->>'$.statement' END FROM review_queue),
    x AS MATERIALIZED (SELECT DISTINCT id, list_sort(list_distinct(regexp_extract_all(lower(statement), '[\\p{L}\\p{Nd}]+'))) AS w FROM s WHERE id IS NOT NULL AND statement IS NOT NULL),
    d AS MATERIALIZED (SELECT w, row_number() OVER () AS sid FROM (SELECT DISTINCT w FROM x WHERE len(w) > 0)),
    t AS MATERIALIZED (SELECT sid, len(w) AS n, unnest(w) AS word FROM d),
    c AS MATERIALIZED (SELECT a.sid AS a, b.sid AS b FROM t a JOIN t b ON a.word = b.word AND a.sid < b.sid GROUP BY a.sid, b.sid HAVING count(*) * 10 >= 7 * (any_value(a.n) + any_value(b.n) - count(*))),
    m AS MATERIALIZED (SELECT id, sid FROM x JOIN d USING (w)),
    p AS MATERIALIZED (SELECT DISTINCT least(i, j) AS id_a, greatest(i, j) AS id_b FROM (SELECT y.id AS i, z.id AS j FROM c JOIN m y ON y.sid = a JOIN m z ON z.sid = b UNION ALL SELECT y.id, z.id FROM m y JOIN m z USING (sid)) WHERE i <> j)
"""

SQL = {
    "p2_found": f"WITH {_SETS} SELECT id_a, id_b FROM p",
    "p2_groups": f"""WITH RECURSIVE {_SETS}, u AS (SELECT id_a AS a, id_b AS b FROM p UNION SELECT id_b, id_a FROM p),
        r(n, k) AS (SELECT id, id FROM x UNION SELECT u.b, r.k FROM r JOIN u ON u.a = r.n WHERE r.k < u.b),
        g AS (SELECT n AS id, min(k) AS group_key FROM r GROUP BY n),
        l AS (SELECT sid, count(*) AS links FROM (SELECT a AS sid FROM c UNION ALL SELECT b FROM c) GROUP BY sid),
        k AS (SELECT id, sum(coalesce(links, 0))::BIGINT AS links FROM m LEFT JOIN l USING (sid) GROUP BY id)
        SELECT i.id, coalesce(group_key, i.id) AS group_key, coalesce(links, 0)::BIGINT AS links FROM (SELECT DISTINCT id FROM s WHERE id IS NOT NULL) i LEFT JOIN g USING (id) LEFT JOIN k USING (id)""",
    "p6_found": """
        WITH RECURSIVE e AS (
            SELECT DISTINCT a, b FROM (
                SELECT list_filter(list_prepend(canonical, coalesce(members, [])), lambda x: x IS NOT NULL)[1] AS a,
                       unnest(list_filter(list_prepend(canonical, coalesce(members, [])), lambda x: x IS NOT NULL)) AS b FROM merge_proposals)),
        u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r(n, m) AS (SELECT a, a FROM u UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.n WHERE r.m < u.b)
        SELECT n AS entity, min(m) AS group_key FROM (SELECT n, m FROM r) GROUP BY n
        HAVING min(m) <> n OR n IN (SELECT m FROM r WHERE n <> m AND n > m)
    """,
    "p6_facts": """
        WITH RECURSIVE e AS (
            SELECT DISTINCT a, b FROM (
                SELECT list_filter(list_prepend(canonical, coalesce(members, [])), lambda x: x IS NOT NULL)[1] AS a,
                       unnest(list_filter(list_prepend(canonical, coalesce(members, [])), lambda x: x IS NOT NULL)) AS b FROM merge_proposals)),
        u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r(n, m) AS (SELECT a, a FROM u UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.n WHERE r.m < u.b),
        g AS (SELECT n AS entity, min(m) AS group_key FROM r GROUP BY n)
        SELECT coalesce(group_key, f.entity) AS group_key, count(DISTINCT id) AS facts FROM (SELECT id, unnest(entities) AS entity FROM facts) f LEFT JOIN g USING (entity) GROUP BY 1
    """,
}

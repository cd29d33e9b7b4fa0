"""SQL for the queries of this package that SQL can express over whole tables."""

from __future__ import annotations

_RECORDS = """
records AS (SELECT key, max(tags) AS tags, max(entities) AS entities FROM memory WHERE key IS NOT NULL GROUP BY key),
lists AS (SELECT key, 'tags' AS field, unnest(tags) AS x FROM records UNION ALL SELECT key, 'entities', unnest(entities) FROM records),
terms AS (SELECT key, field, lower(trim(x, e' \\t\\r\\n' || chr(12288) || chr(160))) AS term FROM lists
          WHERE x IS NOT NULL AND trim(x, e' \\t\\r\\n' || chr(12288) || chr(160)) <> '')
"""

_COUNTED = f"""
WITH {_RECORDS},
counted AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT key) AS records FROM terms GROUP BY field, term),
marked AS (SELECT field, term, occurrences, records,
                  CASE WHEN records >= 0.05 * (SELECT count(*) FROM records) THEN 'common' WHEN records <= 2 THEN 'rare' END AS mark FROM counted)
"""

_PAIRS = f"""
WITH {_RECORDS},
items AS (SELECT DISTINCT key, term FROM terms WHERE field = 'entities'),
n AS (SELECT count(DISTINCT key) AS n FROM items),
one AS (SELECT term, count(*) AS c FROM items GROUP BY term),
two AS (SELECT a.term AS entity_a, b.term AS entity_b, count(*) AS records FROM items a JOIN items b ON a.key = b.key AND a.term < b.term GROUP BY 1, 2),
pairs AS (SELECT entity_a, entity_b, records, records * n / (a.c::DOUBLE * b.c) AS lift FROM two JOIN one a ON a.term = entity_a JOIN one b ON b.term = entity_b, n)
"""


_SIMILAR = """
WITH usable AS (SELECT key, max(embedding)::DOUBLE[] AS v FROM vectors WHERE model = 'mini-embed-64' AND key IS NOT NULL AND len(embedding) = 64
                AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) GROUP BY key),
cosines AS (SELECT a.key AS key, b.key AS other, round(list_cosine_similarity(a.v, b.v), 12) AS cosine FROM usable a JOIN usable b ON a.key <> b.key),
taken AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cosine DESC, other) AS place FROM cosines) WHERE place <= 5 AND cosine >= 0.9)
"""


# Every two texts that share a substring are compared, by the counts of the substrings they share.
_NEAR = r"""
one AS (SELECT content_hash AS id, max(content) AS content, max(entities) AS entities FROM memory WHERE content_hash IS NOT NULL AND content IS NOT NULL GROUP BY content_hash),
folded AS (SELECT id, trim(regexp_replace(lower(content), '[^\p{L}\p{N}]+', ' ', 'g')) AS f,
           list_distinct(list_filter(list_transform(coalesce(entities, []), lambda e: lower(trim(e, e' \t\r\n' || chr(12288) || chr(160)))), lambda e: e IS NOT NULL AND e <> '')) AS e FROM one),
long_ AS (SELECT * FROM folded WHERE length(f) >= 60),
parts AS (SELECT DISTINCT id, substr(f, i, 5) AS part FROM (SELECT id, f, unnest(range(1, length(f) - 3)) AS i FROM long_)),
sizes AS (SELECT id, count(*) AS n FROM parts GROUP BY id),
shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS n FROM parts a JOIN parts b ON a.part = b.part AND a.id < b.id GROUP BY 1, 2),
near AS (SELECT id_a, id_b FROM shared s JOIN sizes a ON a.id = id_a JOIN sizes b ON b.id = id_b JOIN long_ x ON x.id = id_a JOIN long_ y ON y.id = id_b
         WHERE s.n >= 0.6 * (a.n + b.n - s.n) AND (len(x.e) + len(y.e) = 0 OR len(list_intersect(x.e, y.e)) >= 0.5 * (len(x.e) + len(y.e) - len(list_intersect(x.e, y.e)))))
"""

_GROUPS = f"""
WITH RECURSIVE {_NEAR},
both_ways AS (SELECT id_a AS a, id_b AS b FROM near UNION ALL SELECT id_b, id_a FROM near),
reached AS (SELECT DISTINCT a AS id, a AS other FROM both_ways UNION SELECT r.id, w.b FROM reached r JOIN both_ways w ON r.other = w.a),
least_ AS (SELECT id, min(other) AS group_hash FROM reached GROUP BY id),
linked AS (SELECT a AS id, count(*) AS links FROM both_ways GROUP BY a)
SELECT one.id AS content_hash, coalesce(l.group_hash, one.id) AS group_hash, coalesce(k.links, 0) AS links FROM one LEFT JOIN least_ l USING (id) LEFT JOIN linked k USING (id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _COUNTED + "SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
        "p1_terms": _COUNTED + "SELECT field, term, occurrences, records, mark FROM marked",
        "p4_found": _SIMILAR + "SELECT DISTINCT least(key, other) AS key_a, greatest(key, other) AS key_b FROM taken",
        "p5_found": f"WITH {_NEAR} SELECT id_a AS hash_a, id_b AS hash_b FROM near",
        "p5_groups": _GROUPS,
        "p3_found": _PAIRS + "SELECT entity_a, entity_b FROM pairs WHERE records >= 20 AND lift >= 4",
        "p3_pairs": _PAIRS + "SELECT entity_a, entity_b, records, round(lift, 6) AS lift FROM pairs",
    }

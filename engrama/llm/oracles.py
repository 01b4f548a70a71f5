"""DuckDB SQL for the queries that SQL can express.

The others (extraction, surrogates, trained classifiers, XXH64 fingerprints, greedy
packing) are held against brute-force versions, invariants or held-out rows in tests/llm.
"""

from __future__ import annotations

from . import decontam, fim, line_dedup, ranked_search
from .common import LOWER, UPPER

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def oracle_sql() -> dict[str, str]:
    n, sites, words, wide = decontam.WINDOW, line_dedup.MIN_SITES, line_dedup.MIN_WORDS, line_dedup.MIN_SITES * line_dedup.SHORT_FACTOR
    return {
        "op1_decontamination": f"""
            WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
            win AS (
                SELECT DISTINCT item_id, least(len(w), {n}) AS l, array_to_string(w[i:i + {n} - 1], ' ') AS win
                FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {n - 1}, 1))) AS i FROM b WHERE len(w) > 0)
            ),
            d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
            spot AS (SELECT doc_id, l, w, unnest(generate_series(1, len(w) - l + 1)) AS i FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l),
            hit AS (SELECT a.doc_id, a.i, a.l, a.win FROM (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS win FROM spot) a WHERE a.win IN (SELECT win FROM win)),
            covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + l - 1)) AS p FROM hit) GROUP BY doc_id),
            items AS (
                SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
                FROM (SELECT DISTINCT hit.doc_id, cast(win.item_id AS VARCHAR) AS item FROM hit JOIN win USING (win)) GROUP BY doc_id
            )
            SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
                sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
        "op5_line_dedup": f"""
            WITH l AS (
                SELECT doc_id, source, text, pos, line, trim(line, ' ') AS bare,
                    len(regexp_split_to_array(trim(line, ' '), '[\\x20\\x09-\\x0D]+')) >= {words} AS fit, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS worded
                FROM (
                    SELECT doc_id, source, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line
                    FROM documents
                )
            ),
            known AS (SELECT bare FROM l WHERE worded GROUP BY bare, fit HAVING least(count(DISTINCT coalesce(source, '')), count(DISTINCT text)) >= CASE WHEN fit THEN {sites} ELSE {wide} END),
            marked AS (SELECT *, worded AND bare IN (SELECT bare FROM known) AS gone FROM l)
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
                coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
            FROM marked GROUP BY doc_id""",
        "op11_fill_in_middle": f"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{fim.SEED}:' || doc_id) AS h FROM documents),
            u AS (
                SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y,
                    n = 0 OR regexp_matches(t, '{fim.SENTINEL}') OR ('0x' || h[17:24])::BIGINT % 100 >= {100 - fim.PLAIN_PERCENT} AS plain, ('0x' || h[25:32])::BIGINT % 100 < {fim.SPM_PERCENT} AS spm
                FROM d
            ),
            c AS (SELECT *, t[1:least(x, y)] AS p, t[least(x, y) + 1:greatest(x, y)] AS m, t[greatest(x, y) + 1:n] AS s FROM u)
            SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
                CASE WHEN NOT plain THEN least(x, y) END AS prefix_chars, CASE WHEN NOT plain THEN greatest(x, y) - least(x, y) END AS middle_chars,
                sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
            FROM c""",
        "op12_nearest_vectors": """
            WITH v AS (
                SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS norm
                FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0)
            ),
            s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x) / (q.norm * v.norm) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.x) = len(v.x) WHERE q.vec_id % 50 = 0)
            SELECT query_id, cast(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
        "op13_ranked_search": f"""
            WITH w AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS t FROM documents),
            p AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(t) AS term FROM w) GROUP BY ALL),
            d AS (SELECT k, doc_id, len(t) AS n FROM w WHERE len(t) > 0),
            size AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
            weights AS (SELECT term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, size GROUP BY term),
            i AS (SELECT DISTINCT item_id, text, unnest({_WORDS}) AS term FROM benchmark),
            s AS (
                SELECT item_id, i.text, doc_id, k, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::BIGINT AS score
                FROM i JOIN weights USING (term) JOIN p USING (term) JOIN d USING (k), size GROUP BY ALL
            )
            SELECT item_id, cast(rank AS INT) AS rank, doc_id, score
            FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {ranked_search.K}""",
    }

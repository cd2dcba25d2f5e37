"""SQL for the queries of these operators that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op3_warc_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
        q AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM p)
        SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
                ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - i % 4 * 5)::INT) & 31)::INT + 1]), '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM q""",
    "op4_url_cascade": r"""
        WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        s AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, coalesce(rest, '') AS rest FROM u),
        k AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM s),
        rules(rule, h, p, v) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
            ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
        m AS (SELECT k.*, rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS r
              FROM k LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE r = 1""",
    "op5_ngram_jaccard": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
              FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
                 JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
                 GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id""",
    "op6_rule_ledger": rf"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
        l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup
              FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
              WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + 2]) AS c
              FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
        r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) t(k) WHERE c > 1 GROUP BY doc_id),
        m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                     length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                     coalesce(n_lines, 0) AS n_lines, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
              FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
        f AS (SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 2 * n_words)::INT
                     + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT
                     + 32 * (word_chars > 15 * n_words)::INT)::BIGINT AS failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed,
               CASE failed WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'duplicate_lines'
                           WHEN 16 THEN 'short_words' WHEN 32 THEN 'long_words' END AS only_rule
        FROM f""",
    "op10_suffix_dedup": rf"""
        WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
        g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY ws[i:i + 12]) AS first
              FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g WHERE first < doc_id),
        lost AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE
                   list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ws[i]) END, ' ')) AS kept_sha256
        FROM w LEFT JOIN lost USING (doc_id)""",
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
        w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
        kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
        gn AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
        p AS (SELECT kept.lang, gn.source, kept.term, coalesce(c.c, 0) AS c,
                     1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (gn.n + v.v) AS p
              FROM kept JOIN gn USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = kept.lang AND c.source = gn.source AND c.term = kept.term),
        q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER (PARTITION BY lang) + v) AS q
              FROM (SELECT lang, term, sum(c) AS c FROM c GROUP BY lang, term) JOIN v USING (lang)),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
                  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN (SELECT x.lang, x.source AS a, y.source AS b, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
                             FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source) s
                  ON s.lang = a.lang AND s.a = a.source AND s.b = b.source),
        terms AS (SELECT p.lang, p.source, p.term AS item, ((p.p - q.q) * (p.p - q.q) // q.q)::BIGINT AS value
                  FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.c > 0 AND p.p > q.q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
                   FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms))
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
}


def _rounds(n: int, parts: int = 4, entries: int = 256) -> str:
    """SQL of the vector codes, with one step of assignment and means per round."""
    near = """
        a{i} AS MATERIALIZED (SELECT vec_id, part, w, arg_min(entry, [dist, entry]) AS entry, min(dist) AS dist
              FROM (SELECT vec_id, part, w, entry, list_sum(list_transform(range(1, len(w) + 1), lambda i: (w[i] - c[i]) * (w[i] - c[i])))::BIGINT AS dist
                    FROM x JOIN c{i} USING (part)) GROUP BY vec_id, part, w),"""
    mean = """
        c{j} AS MATERIALIZED (SELECT c{i}.part, c{i}.entry, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN
              (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS c
               FROM (SELECT part, entry, place, sum(y)::BIGINT AS s, count(*) AS n
                     FROM (SELECT part, entry, unnest(w) AS y, unnest(range(1, len(w) + 1)) AS place FROM a{i}) GROUP BY part, entry, place)
               GROUP BY part, entry) m ON m.part = c{i}.part AND m.entry = c{i}.entry),"""
    steps = "".join((near + mean).format(i=i, j=i + 1) for i in range(n)) + near.format(i=n)
    return f"""
        WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x)::BIGINT) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        x AS MATERIALIZED (SELECT vec_id, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS w FROM k, range({parts}) t(part)),
        c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, w AS c
               FROM x QUALIFY entry < {entries}),{steps}
        d AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{n}),
        r AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a{n} GROUP BY vec_id)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
        FROM r JOIN k USING (vec_id), d"""


ORACLES["op11_orchard_codes"] = _rounds(4)

ORACLES["rule_ablation"] = f"""
        SELECT policy, rule, count(*) FILTER (failed & bit <> 0) AS failing, count(*) FILTER (failed & mask = bit) AS alone,
               count(*) FILTER (failed & mask IN (0, bit)) AS kept_without
        FROM ({ORACLES["op6_rule_ledger"]}) l,
             (VALUES ('base-1', 'few_words', 1, 3), ('base-1', 'repeated_words', 2, 3), ('web-1', 'few_words', 1, 63),
                     ('web-1', 'repeated_words', 2, 63), ('web-1', 'symbols', 4, 63), ('web-1', 'duplicate_lines', 8, 63),
                     ('web-1', 'short_words', 16, 63), ('web-1', 'long_words', 32, 63)) r(policy, rule, bit, mask)
        GROUP BY policy, rule"""

"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_BLANK = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_UNSPACED = "".join(rf"\p{{{x}}}" for x in ("Han", "Hiragana", "Katakana", "Bopomofo", "Yi", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"))

OP6 = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '{_BLANK}'), lambda x: x <> '') AS ws,
   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
 wins AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w) x),
 twice AS (SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
 repeats AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM twice) x GROUP BY 1),
 m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
   CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
   CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
   CAST(length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_upper, regexp_matches(t, '[{_UNSPACED}]') AS un,
   CAST(length(regexp_replace(t, '[^{_UNSPACED}]+', '', 'g')) AS BIGINT) AS n_unspaced,
   CASE WHEN un THEN CAST(length(regexp_replace(t, '[^\p{{L}}\p{{M}}]+', '', 'g')) AS BIGINT) ELSE 0 END AS n_letters FROM w LEFT JOIN repeats r USING (rid)),
 long_words AS (SELECT *, word_chars < 2 * n_words OR word_chars > 14 * n_words AS odd FROM m),
 b AS (SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
   + CASE WHEN 20 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 5 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
   + CASE WHEN odd THEN 16 ELSE 0 END + CASE WHEN 100 * n_upper > 50 * word_chars THEN 32 ELSE 0 END
   + CASE WHEN odd AND 2 * n_unspaced <= n_letters THEN 64 ELSE 0 END AS BIGINT) AS fail_bits FROM long_words)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & ~16) = 0 AS kept,
 fail_bits, n_lines, n_upper, n_unspaced, n_letters FROM b"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = rf"""WITH i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
 iwin AS (SELECT DISTINCT item_id, least(len(ws), 13) AS k, array_to_string(ws[p:p + 12], ' ') AS g
   FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS p FROM i WHERE len(ws) > 0) x),
 sizes AS (SELECT DISTINCT k FROM iwin),
 d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
 dwin AS (SELECT rid, p, k, array_to_string(ws[p:p + k - 1], ' ') AS g FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d CROSS JOIN sizes) x),
 hits AS (SELECT rid, p, w.k, item_id FROM dwin w JOIN iwin ON iwin.g = w.g AND iwin.k = w.k),
 covered AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM hits) x GROUP BY 1),
 found AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
 sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN found USING (rid)"""

OP4 = rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_BLANK}'),
   lambda x: x <> '') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS p FROM d WHERE len(ws) > 0) x),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
 ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b),
 root AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d JOIN root ON root.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

OP11 = (OP4.replace("ws[p:p + 2]", "ws[p:p + 4]").replace("len(ws) - 2", "len(ws) - 4").replace(">= 85 *", ">= 80 *")
        .replace(", component_id = d.doc_id AS kept", ""))

ORACLE = {"op11_jaccard_join": OP11, "op2_benchmark_decontamination": OP2, "op4_near_dedup": OP4, "op6_quality_rules": OP6}

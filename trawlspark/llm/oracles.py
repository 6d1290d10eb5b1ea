"""DuckDB SQL for the queries of this subpackage that SQL can express at a bearable cost."""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP4 = f"""WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents),
k AS (SELECT *, trim(line, {_BLANKS}) AS key FROM l),
b AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT coalesce(source, '')) >= 10 AND count(DISTINCT text) >= 10),
d AS (SELECT doc_id, count(*) FILTER (WHERE key <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS kept FROM (SELECT k.*, key IN (SELECT key FROM b) AS gone FROM k) GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(kept) AS text_sha256 FROM (SELECT doc_id FROM documents) LEFT JOIN d USING (doc_id)"""

OP6 = """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS s FROM w WHERE len(ws) >= 35),
g AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY array_to_string(ws[s:s + 34], ' ')) AS n FROM s) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS pos FROM g),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
r AS (SELECT e.doc_id, count(*) AS n_words, count(c.pos) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY e.pos) FILTER (WHERE c.pos IS NULL), '') AS kept FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.pos = e.pos GROUP BY e.doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM (SELECT doc_id FROM documents) LEFT JOIN r USING (doc_id)"""

_GROWN = "(length({0}) - length(replace(replace(replace({0}, '~', ''), '<', ''), chr(10), '')))"
_MARK = "(contains({0}, '<|im_start|>') OR contains({0}, '<|im_start|~|>') OR contains({0}, '<|im_end|>'))"

OP7 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, bool_or({_MARK.format('text')} OR {_MARK.format('role')} OR contains(role, chr(10))) OVER (PARTITION BY conv_id) AND (contains(role || ' ' || text, '<') OR contains(role, chr(10))) AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length(role) + length(text) + CASE WHEN escaped THEN 26 + {_GROWN.format('role')} + {_GROWN.format('text')} ELSE 24 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

_R = {"word_length": ("word_chars", 100, "n_words", 250), "symbols": ("n_symbols", 1000, "word_chars", 50), "shouted": ("n_shouted", 1000, "word_chars", 200), "dup_lines": ("n_dup_lines", 1000, "n_lines", 350), "repeats": ("n_repeat_words", 1000, "n_words", 100)}
_ROUNDED = "CASE WHEN x < 64 THEN x ELSE (x >> (length(bin(x)) - 6)) << (length(bin(x)) - 6) END"


def _fences(keys: str) -> str:
    """Of the groups of keys: rows, and each ratio's fences from the quartiles by rank, rounded down to their cells' least integers."""
    by = f"PARTITION BY {keys + ', ' if keys else ''}ratio"
    rows = f"SELECT {keys + ', ' if keys else ''}ratio, slack, x, row_number() OVER ({by} ORDER BY x) AS k, count(*) OVER ({by}) AS n FROM each_"
    quarters = f"SELECT {keys + ', ' if keys else ''}ratio, any_value(slack) AS slack, any_value(n) AS n, max({_ROUNDED}) FILTER (WHERE k = ceil(n * 0.25)) AS q1, max({_ROUNDED}) FILTER (WHERE k = ceil(n * 0.75)) AS q3 FROM ({rows}) GROUP BY {keys + ', ' if keys else ''}ratio"
    return f"SELECT {keys + ', ' if keys else ''}ratio, n, q1 - ((q3 - q1) * 3.0 + slack) AS low, q3 + ((q3 - q1) * 3.0 + slack) AS high FROM ({quarters})"


_EACH = " UNION ALL ".join(f"SELECT rid, lang, source, '{r}' AS ratio, {slack} AS slack, CASE WHEN {den} = 0 THEN 0 ELSE ({num} * {k}) // {den} END AS x FROM stats WHERE n_words > 0" for r, (num, k, den, slack) in _R.items())

OP5 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: trim(x, {_BLANKS}) <> '') AS lines FROM d),
grams AS (SELECT rid, unnest(range(1, len(ws) - 3)) AS p, unnest(list_transform(range(1, len(ws) - 3), lambda p: array_to_string(ws[p:p + 4], ' '))) AS g FROM w WHERE len(ws) >= 5),
again AS (SELECT rid, p FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest(range(p, p + 5)) AS pos FROM again) GROUP BY rid),
stats AS (SELECT w.rid, doc_id, lang, source, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
 length(regexp_replace(text, '[^A-Z!]', '', 'g')) AS n_shouted, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN covered c ON c.rid = w.rid),
each_ AS ({_EACH}),
own AS ({_fences("lang, source")}), of_lang AS ({_fences("lang")}), whole AS ({_fences("")}),
bad AS (SELECT DISTINCT e.rid FROM each_ e JOIN own o ON o.lang IS NOT DISTINCT FROM e.lang AND o.source IS NOT DISTINCT FROM e.source AND o.ratio = e.ratio JOIN of_lang l ON l.lang IS NOT DISTINCT FROM e.lang AND l.ratio = e.ratio JOIN whole a ON a.ratio = e.ratio
 WHERE e.x > CASE WHEN o.n >= 200 THEN o.high WHEN l.n >= 200 THEN l.high ELSE a.high END OR (e.ratio = 'word_length' AND e.x < CASE WHEN o.n >= 200 THEN o.low WHEN l.n >= 200 THEN l.low ELSE a.low END)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM stats)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept FROM judged"""

OP1 = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda p: array_to_string(ws[p:p + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT both_.b, r.low FROM r JOIN both_ ON both_.a = r.id WHERE both_.b > r.low)
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept FROM (SELECT id, min(low) AS component_id FROM r GROUP BY id) LEFT JOIN n ON n.doc_id = id"""

SQL = {"op1_minhash_dedup": OP1, "op4_line_dedup": OP4, "op5_quality_rules": OP5, "op6_substring_dedup": OP6, "op7_chat_format": OP7}

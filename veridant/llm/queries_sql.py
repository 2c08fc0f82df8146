"""SQL counterparts of the text queries that SQL can express."""

_WORDS = "regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"
_RUNS = "unnest(list_transform(range(1, len(ws) - 10), lambda i: array_to_string(ws[i:i + 11], ' ')))"

ORACLE_SQL: dict[str, str] = {
    "p7_found": """WITH s AS (SELECT DISTINCT id, text FROM mini_10k_spans WHERE length(text) > 2000), p AS (SELECT id, text, unnest(string_split_regex(text, '\\n\\s*\\n')) par FROM s),
    q AS (SELECT id, text, trim(par, ' \t\r\n') par FROM p), t AS (SELECT id, text, par, unnest(string_split(regexp_replace(par, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) sen FROM q),
    m AS (SELECT id, text, max(length(par)) mp, max(length(trim(sen, ' \t\r\n'))) ms FROM t GROUP BY 1, 2)
    SELECT id span_id, CASE WHEN mp <= 1800 THEN 'paragraph' WHEN ms <= 1800 THEN 'sentence' WHEN list_max(list_transform(string_split_regex(text, '\\s+'), lambda w: length(w))) <= 1800 THEN 'word' ELSE 'none' END coarsest_boundary FROM m""",
    "p9_found": f"""WITH i AS (SELECT DISTINCT item_id, {_RUNS} r FROM (SELECT item_id, {_WORDS.format(x="text")} ws FROM eval_items)), d AS (SELECT DISTINCT doc_id, {_RUNS} r FROM (SELECT doc_id, {_WORDS.format(x="text")} ws FROM documents WHERE text IS NOT NULL))
    SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (r)""",
    "p9_checks": f"""WITH i AS (SELECT DISTINCT item_id, {_RUNS} r FROM (SELECT item_id, {_WORDS.format(x="text")} ws FROM eval_items)), d AS (SELECT DISTINCT doc_id, {_RUNS} r FROM (SELECT doc_id, {_WORDS.format(x="text")} ws FROM documents WHERE text IS NOT NULL))
    SELECT DISTINCT doc_id, item_id, true sound FROM d JOIN i USING (r)""",
    "p7_checks": "SELECT DISTINCT id span_id, length(text) AS characters, true within_limit, true overlapping, true AS natural FROM mini_10k_spans WHERE length(text) > 2000",
    "p8_checks": "SELECT count(DISTINCT doc_id) documents, 0 split_needlessly, 0 placed_twice, 0 over_capacity, true well_filled FROM documents WHERE text <> ''",
}

"""DuckDB SQL of the queries that SQL can express. For small tables: links are found by joins on every shingle or of every two vectors."""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = """
WITH c AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations GROUP BY conv_id),
g AS (SELECT t[1] AS first, min(conv_id) AS chosen_id FROM c GROUP BY t[1]),
p AS (
  SELECT c.conv_id, g.chosen_id, b.t AS chosen, c.t AS rejected, least(len(b.t), len(c.t)) AS n
  FROM c JOIN g ON c.t[1] = g.first JOIN c b ON b.conv_id = g.chosen_id),
q AS (SELECT *, coalesce(list_min(list_filter(range(1, n + 1), lambda i: chosen[i] != rejected[i])) - 1, n)::INT AS k FROM p),
r AS (
  SELECT *, chosen[1:k] AS pre, chosen[k + 1:] AS a, rejected[k + 1:] AS b, conv_id = chosen_id AS is_first FROM q)
SELECT conv_id, chosen_id, CASE WHEN is_first THEN 'first' WHEN chosen = rejected THEN 'same' ELSE 'pair' END AS status,
  CASE WHEN NOT is_first THEN k END AS n_prompt_turns,
  CASE WHEN NOT is_first THEN {pre} END AS prompt, CASE WHEN NOT is_first THEN {a} END AS chosen_text, CASE WHEN NOT is_first THEN {b} END AS rejected_text,
  CASE WHEN NOT is_first THEN {spans_a} END AS chosen_spans, CASE WHEN NOT is_first THEN {spans_b} END AS rejected_spans
FROM r"""
_RENDER = "array_to_string(list_transform({x}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10)), '')"
_START = "(coalesce(list_sum(list_transform({x}[1:i - 1], lambda u: length(u.role) + length(u.text) + 6)), 0) + length({x}[i].role) + 5)::BIGINT"
_SPANS = "array_to_string(list_transform(list_filter(range(1, len({x}) + 1), lambda i: {x}[i].role = 'assistant'), lambda i: " + _START + " || '-' || (" + _START + " + length({x}[i].text))), ',')"
OP3 = OP3.format(**{x: _RENDER.format(x=x) for x in ("pre", "a", "b")}, **{f"spans_{x}": _SPANS.format(x=x) for x in ("a", "b")})

_JS = "sqrt(greatest(0, least(1, 0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END))))"
_KEPT = lambda keep: f"length(regexp_replace(t, '[^{keep}]', '', 'g'))"
_CLASS = [_KEPT(x) for x in ("a-z", "A-Z", "0-9", r"\x09-\x0D\x20", r".,;:!?''\x22()\x2D", r"#-&*+/<=>@\x5B-`{-~")]
_ASCII = _KEPT(r"\x00-\x7F")
OP4 = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (
  SELECT doc_id, lang, strlen(t) AS n_bytes, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_KEPT("#*$%&|<>")} AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    [{", ".join(_CLASS)}, {_ASCII} - {" - ".join(_CLASS)}, strlen(t) - {_ASCII}] AS classes
  FROM d),
win AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS x FROM d WHERE len(w) >= 5),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(5) r(k) GROUP BY doc_id),
words AS (SELECT doc_id, lang, x, count(*) AS n FROM (SELECT doc_id, lang, unnest(w) AS x FROM d) GROUP BY ALL),
total AS (SELECT lang, sum(n) AS n FROM words WHERE lang != '' GROUP BY lang),
common AS (SELECT lang, x, sum(words.n) AS c, any_value(total.n) AS n FROM words JOIN total USING (lang) GROUP BY lang, x HAVING sum(words.n) >= greatest(20, any_value(total.n) / 500)),
ref AS (SELECT lang, x, c / n AS q FROM common UNION ALL SELECT lang, NULL, 1 - coalesce(sum(c) / any_value(common.n), 0) FROM total LEFT JOIN common USING (lang) GROUP BY lang),
own AS (SELECT words.doc_id, words.lang, common.x, sum(words.n) AS n FROM words LEFT JOIN common ON words.lang = common.lang AND words.x = common.x GROUP BY ALL),
far_word AS (
  SELECT doc_id, {_JS} AS word_distance
  FROM (SELECT b.doc_id, coalesce(own.n, 0) / greatest(1, b.n_words) AS p, ref.q FROM b JOIN ref ON b.lang = ref.lang LEFT JOIN own ON own.doc_id = b.doc_id AND own.x IS NOT DISTINCT FROM ref.x)
  GROUP BY doc_id),
one AS (SELECT doc_id, lang, n_bytes, unnest(range(8)) AS k, unnest(classes) AS n FROM b),
kinds AS (SELECT lang, k, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM one WHERE lang != '' GROUP BY lang, k),
far_class AS (SELECT doc_id, {_JS} AS class_distance FROM (SELECT doc_id, one.n / greatest(1, n_bytes) AS p, kinds.n / greatest(1, total) AS q FROM one JOIN kinds USING (lang, k)) GROUP BY doc_id),
v AS (
  SELECT b.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed,
    coalesce(class_distance > 0.30 AND n_bytes >= 200, false) OR coalesce(word_distance > 0.55 AND n_words >= 50, false) AS apart
  FROM b LEFT JOIN rep USING (doc_id) LEFT JOIN far_word USING (doc_id) LEFT JOIN far_class USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT apart AS kept FROM v"""

OP8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh, len(w) AS k FROM d),
u AS MATERIALIZED (SELECT doc_id, least(k, 5) AS k, len(sh) AS n, unnest(sh) AS x FROM s),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.k = b.k AND a.doc_id != b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.doc_id)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, min(root) AS component_id, s.doc_id = min(root) AS kept FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id, sh"""

OP10 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
fine AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x != 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id != b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach(vec_id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.vec_id),
low AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id),
deg AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM low LEFT JOIN deg USING (vec_id)"""

SQL = {"op3_preference_formatting": OP3, "op4_quality_rules": OP4, "op8_minhash_near_dedup": OP8, "op10_embedding_near_dedup": OP10}

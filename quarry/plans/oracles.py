"""DuckDB SQL for the registered queries, written from the semantics and not from the Spark plans."""

from __future__ import annotations

from quarry.functions.hashing import GAMMA, MULTIPLIERS, SHIFTS
from quarry.operators.answering import ANSWER_HEAD, INSTRUCTIONS, REFUSAL
from quarry.operators.bm25 import STOP_WORDS

_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}\x{0b}]"
_WS = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{0b}]"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _count(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{_TOKEN}'))"


def _articles(x: str) -> str:
    """Articles as words of their own become spaces; twice, as neighbours share a boundary."""
    one = r"regexp_replace({}, '(^|[^\p{{L}}\p{{N}}_])(?:a|an|the)([^\p{{L}}\p{{N}}_]|$)', '\1 \2', 'g')"
    return one.format(one.format(x))


def _collapse(x: str) -> str:
    return _strip(f"regexp_replace({x}, '{_WS}+', ' ', 'g')")


def _short(x: str) -> str:
    return _collapse(_articles(rf"regexp_replace(lower({x}), '\p{{P}}', '', 'g')"))


def _paper(x: str) -> str:
    return _collapse(_articles(rf"regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g')"))


_EXACT = """
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
scored AS (SELECT query_id, vec_id AS vector_id, round(list_inner_product(q.e, c.embedding::DOUBLE[]), 9) AS s FROM q, embeddings c),
ranked AS (SELECT query_id, vector_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vector_id) AS r FROM scored)
"""
_Q01 = f"WITH {_EXACT} SELECT query_id, r::INTEGER AS rank, vector_id, round(s, 6) AS score FROM ranked WHERE r <= 10"

_POSTINGS = f"""
words AS (SELECT doc_id, [w FOR w IN regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') IF w NOT IN ({_STOP})] AS ws FROM documents),
size AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM words),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM words) GROUP BY doc_id, dl, term),
df AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term)
"""
_HITS = f"""{_POSTINGS},
asked AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest([w FOR w IN regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') IF w NOT IN ({_STOP})]) AS term FROM benchmark) GROUP BY ALL),
sums AS (SELECT item_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS s FROM asked JOIN tf USING (term) JOIN df USING (term), size GROUP BY ALL),
hits AS (SELECT item_id AS query_id, doc_id AS vector_id, s, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id)::INTEGER AS rank FROM sums WHERE s > 0 QUALIFY rank <= 10),
judged AS (SELECT h.*, d.text, d.source, b.text AS question, contains(d.text, b.text) AS relevant FROM hits h JOIN documents d ON d.doc_id = h.vector_id JOIN benchmark b ON b.item_id = h.query_id)
"""

_PAIRS = """
pairs AS (SELECT format('{}_{}', u.conv_id, u.turn) AS query_id, u.text AS gold, a.text AS prediction
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')
"""


def _f1(source: str, extra: str = "") -> str:
    """Token F1 of ``(k, p, g)`` normal forms as ``(k, np, ng, f1)``; no overlap is 0."""
    return f"""
pw AS (SELECT k, t, count(*) AS n FROM (SELECT k, unnest([w FOR w IN string_split(p, ' ') IF w <> '']) AS t FROM {source}) GROUP BY k, t),
gw AS (SELECT k, t, count(*) AS n FROM (SELECT k, unnest([w FOR w IN string_split(g, ' ') IF w <> '']) AS t FROM {source}) GROUP BY k, t),
same AS (SELECT k, sum(least(pw.n, gw.n)) AS c FROM pw JOIN gw USING (k, t) GROUP BY k),
sizes AS (SELECT k, p, g, len([w FOR w IN string_split(p, ' ') IF w <> '']) AS np, len([w FOR w IN string_split(g, ' ') IF w <> '']) AS ng FROM {source}),
f1s AS (SELECT k, p, g, np, ng, CASE WHEN coalesce(c, 0) = 0 THEN 0.0 ELSE 2 * (c / np) * (c / ng) / (c / np + c / ng) END AS f1 FROM sizes LEFT JOIN same USING (k)){extra}
"""


_PAPER_SCORES = f"""{_PAIRS},
refs AS (
  SELECT query_id, 0 AS pos, 'extractive' AS kind, prediction, gold AS answer, gold, [gold] AS evidence FROM pairs UNION ALL
  SELECT query_id, 1, 'abstractive', prediction, array_to_string(string_split(prediction, ' ')[1:2], ' '), gold, [prediction, gold] FROM pairs),
forms AS (SELECT query_id || '#' || pos AS k, query_id, pos, kind, {_paper("prediction")} AS p, {_paper("answer")} AS g,
  CASE WHEN pos = 0 THEN (prediction = gold)::INT ELSE 1 + (gold = 'other')::INT - (gold = prediction)::INT * 0 END AS c, pos + 1 AS n_gold FROM refs),
{_f1("forms")},
scores AS (SELECT query_id, round(max(f1), 6) AS answer_f1, arg_max(kind, (f1, -pos)) AS answer_type,
  round(max(CASE WHEN c = 0 THEN 0 ELSE 2 * (c / 2) * (c / n_gold) / (c / 2 + c / n_gold) END), 6) AS evidence_f1, max(f1) AS raw_f1,
  max(CASE WHEN c = 0 THEN 0 ELSE 2 * (c / 2) * (c / n_gold) / (c / 2 + c / n_gold) END) AS raw_e FROM forms JOIN f1s USING (k) GROUP BY query_id)
"""

_OPEN = f"""{_HITS},
units AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS page, unnest(l) AS evidence FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
asked2 AS (SELECT query_id, vector_id AS paper FROM hits WHERE rank = 1),
covered AS (SELECT DISTINCT h.query_id, u.doc_id, {_strip("translate(u.evidence, chr(13) || chr(10), '  ')")} AS e FROM hits h JOIN units u ON u.doc_id = h.vector_id AND u.page BETWEEN 1 AND h.rank + 2),
pred AS (SELECT * FROM covered WHERE e <> ''),
gold AS (SELECT DISTINCT query_id, paper AS doc_id, {_strip("g")} AS e FROM (SELECT query_id, paper, unnest(string_split(text, chr(10))) AS g FROM asked2 JOIN benchmark ON item_id = query_id) WHERE {_strip("g")} <> ''),
counts AS (SELECT query_id, (SELECT count(*) FROM pred p WHERE p.query_id = a.query_id) AS np, (SELECT count(*) FROM gold g WHERE g.query_id = a.query_id) AS ng,
  (SELECT count(*) FROM pred p JOIN gold g USING (query_id, doc_id, e) WHERE p.query_id = a.query_id) AS c FROM asked2 a),
open AS (SELECT query_id, true AS paper_hit, 1.0::DOUBLE AS paper_rr, coalesce(c > 0 AND ng > 0, false) AS evidence_hit, CASE WHEN ng > 0 THEN c / ng END AS recall,
  greatest(CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 2 * (c / np) * (c / ng) / (c / np + c / ng) END, CASE WHEN np = 0 THEN 1.0 ELSE 0.0 END) AS f1 FROM counts)
"""

_HEADER = "format('[Chunk {} | source={}, pages=1-1]', rank, source)"
_CONTEXT = f"""{_HITS},
parts AS (SELECT query_id, rank, {_HEADER} AS header, text FROM judged WHERE rank <= 5 AND text <> ''),
made AS (SELECT query_id, string_agg(header || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS c, sum({_count("header")} + {_count("text")}) AS n, count(*) AS k FROM parts GROUP BY query_id),
contexts AS (SELECT item_id AS query_id, b.text AS question, coalesce(c, '') AS context, coalesce(n, 0)::BIGINT AS tokens, coalesce(k, 0)::INTEGER AS k FROM benchmark b LEFT JOIN made ON made.query_id = item_id)
"""


def _prompt(version: str) -> str:
    head = "\n".join([*INSTRUCTIONS[version], "", "Question:", ""]).replace("'", "''")
    return f"'{head}' || question || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Answer:'"


_RUN = """
runs AS (SELECT CASE WHEN event_type = 'error' OR user_id % 10 = 0 THEN 'error' ELSE 'success' END AS status, value AS total_ms,
  CASE WHEN event_id % 3 > 0 THEN value / 2 END AS retrieval_ms, CASE WHEN event_id % 5 > 0 THEN user_id END AS tokens FROM events)
"""

_REFS = """
flags AS (SELECT doc_id, (doc_id % 5 <> 0 AND doc_id % 2 = 0 AND trim(string_split(text, chr(10))[1]) <> '' AND doc_id % 7 <> 0 AND doc_id % 3 = 0)::INT AS a, (doc_id % 4 = 0)::INT AS b FROM documents)
"""

_TITLES = "titles AS (SELECT DISTINCT source FROM documents WHERE doc_id % 200 = 0)"

_UNITS33 = f"""
listed AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents),
every AS (
  SELECT doc_id, list_concat([source], [lang], l[:len(l) // 2], [source], l[len(l) // 2 + 1:]) AS plain, 'Figure ' || lang AS caption FROM listed),
clean AS (SELECT doc_id, [x FOR x IN [{_strip("translate(u, chr(13) || chr(10), '  ')")} FOR u IN plain] IF x <> ''] AS us, caption FROM every),
pages33 AS (SELECT doc_id, unnest(range(1, len(us) + 1)) AS page, unnest(us) AS t, false AS f FROM clean UNION ALL SELECT doc_id, len(us) + 1, caption, true FROM clean)
"""

#: Sentences, cut every 300 tokens, and chunks whose bounds follow one after another on the running sum of their tokens.
def _pieces(x: str) -> str:
    """Each token with the gap before it."""
    return f"string_split(regexp_replace({x}, '({_TOKEN})', '\\1' || chr(2), 'g'), chr(2))"


def _first(x: str, n: str) -> str:
    """From the first token to the end of the ``n``-th."""
    return _strip(f"array_to_string({_pieces(x)}[1:{n}], '')")


_CHUNKS = f"""sentences AS (SELECT doc_id, source, unnest(s) AS s, unnest(range(len(s))) AS no FROM (SELECT doc_id, source, [x FOR x IN [{_strip("p")} FOR p IN string_split(regexp_replace({_strip("text")}, '([.!?。！？]){_WS}+', '\\1' || chr(1), 'g'), chr(1))] IF x <> ''] AS s FROM documents)),
units AS (SELECT doc_id, source, no, unnest(range(len(u))) AS part, unnest(u) AS u FROM (SELECT doc_id, source, no, CASE WHEN {_count("s")} <= 300 THEN [s] ELSE [{_strip("f")} FOR f IN [array_to_string({_pieces("s")}[300 * k + 1:least(300 * k + 300, {_count("s")})], '') FOR k IN range(({_count("s")} + 299) // 300)]] END AS u FROM sentences WHERE {_count("s")} > 0)),
listed AS (SELECT doc_id, source, list(u ORDER BY no, part) AS us, list({_count("u")} ORDER BY no, part) AS c FROM units GROUP BY doc_id, source),
sums AS (SELECT doc_id, source, us, len(c) AS n, list_concat([0::BIGINT], [list_sum(c[:i])::BIGINT FOR i IN range(1, len(c) + 1)]) AS t FROM listed),
folded AS (SELECT doc_id, t, n, 0::BIGINT AS a, 0::BIGINT AS seen, 0::BIGINT AS z, 0::BIGINT AS no, 0::BIGINT AS next FROM sums UNION ALL
  SELECT doc_id, t, n, a, z, z, no, greatest(a, len([x FOR x IN t IF x < t[z + 1] - CASE WHEN t[z + 1] - t[a + 1] = 300 OR z = n THEN 50 ELSE least(50, 300 - (t[z + 2] - t[z + 1])) END])) AS next
  FROM (SELECT doc_id, t, n, next AS a, no + 1 AS no, (len([x FOR x IN t IF x <= t[next + 1] + 300]) - 1)::BIGINT AS z FROM folded WHERE seen < n)),
chunks AS (SELECT f.doc_id, source, f.no, array_to_string(us[a + 1:z], ' ') AS text, (f.t[z + 1] - f.t[a + 1])::INTEGER AS tokens FROM folded f JOIN sums USING (doc_id) WHERE f.no > 0)"""

#: Budgets of contexts: the first hit that doesn't fit is cut to what is left and ends the context.
_BUDGET = f"""{_HITS},
sized AS (SELECT query_id, rank, {_HEADER} AS header, text, {_count(_HEADER)} AS hn, {_count("text")} AS tn FROM judged WHERE rank <= 5),
room AS (SELECT *, 600 - coalesce(sum(hn + tn) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - hn AS room FROM sized),
parts AS (SELECT *, room <= 0 OR tn > room AS cut, CASE WHEN room <= 0 THEN '' WHEN tn <= room THEN text ELSE {_first("text", "room")} END AS kept FROM room),
reached AS (SELECT *, coalesce(max((cut OR kept = '')::INT) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS ok FROM parts QUALIFY ok),
made AS (SELECT query_id, string_agg(header || chr(10) || kept, chr(10) || chr(10) ORDER BY rank) FILTER (kept <> '') AS c, sum(hn + least(tn, room)) FILTER (kept <> '') AS n, count(*) FILTER (kept <> '') AS k, bool_or(cut) AS cut FROM reached GROUP BY query_id)"""

#: The three sentences with the most words of over three letters of the question; else the first two of the first hit.
_EXTRACT = f"""{_HITS},
asked3 AS (SELECT item_id AS query_id, list_distinct([lower(w) FOR w IN regexp_extract_all(text, '[A-Za-z0-9_]+') IF length(w) > 3]) AS asked FROM benchmark),
said AS (SELECT query_id, rank, source || ' pp. 1-1' AS cited, unnest(s) AS raw, unnest(range(len(s))) AS pos FROM (SELECT query_id, rank, source, string_split(regexp_replace(text, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM judged WHERE rank <= 5)),
scored AS (SELECT query_id, rank, cited, pos, {_strip("raw")} AS sentence, len(list_intersect(asked, list_distinct([lower(w) FOR w IN regexp_extract_all(raw, '[A-Za-z0-9_]+')]))) AS s FROM said JOIN asked3 USING (query_id)),
best AS (SELECT query_id, sentence, cited, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank, pos) AS n FROM scored WHERE s > 0 QUALIFY n <= 3),
poor AS (SELECT query_id, sentence, cited, row_number() OVER (PARTITION BY query_id ORDER BY rank, pos) AS n FROM (SELECT *, max(s) OVER (PARTITION BY query_id) AS top, min(rank) OVER (PARTITION BY query_id) AS head FROM scored) WHERE top = 0 AND rank = head AND sentence <> '' QUALIFY n <= 2),
lines AS (SELECT query_id, string_agg('- ' || sentence || ' (' || cited || ')', chr(10) ORDER BY n) AS l FROM (SELECT * FROM best UNION ALL SELECT * FROM poor) GROUP BY query_id),
full_answers AS (SELECT item_id AS query_id, CASE WHEN l IS NULL THEN '{REFUSAL.replace("'", "''")}' ELSE '{ANSWER_HEAD}' || chr(10) || l END AS f FROM benchmark LEFT JOIN lines ON lines.query_id = item_id)"""

#: SplitMix64 in wide integers; the state after n draws is the seed and n steps.
_RESERVOIR = f"""ids AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id)::UHUGEINT AS i FROM documents WHERE doc_id % 50 <> 0),
seeded AS (SELECT doc_id, i, (('0x' || substr(sha256('quarry' || chr(0) || 'background'), 1, 16))::UBIGINT::UHUGEINT + (i - 100) * {GAMMA}::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM ids WHERE i > 100),
one AS (SELECT doc_id, i, (xor(z::UBIGINT, (z // {1 << SHIFTS[0]})::UBIGINT)::UHUGEINT * {MULTIPLIERS[0]}::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM seeded),
two AS (SELECT doc_id, i, (xor(z::UBIGINT, (z // {1 << SHIFTS[1]})::UBIGINT)::UHUGEINT * {MULTIPLIERS[1]}::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM one),
drawn AS (SELECT doc_id, i, xor(z::UBIGINT, (z // {1 << SHIFTS[2]})::UBIGINT)::UHUGEINT % i AS slot FROM two),
slots AS (SELECT doc_id, i, slot FROM drawn WHERE slot < 100 UNION ALL SELECT doc_id, i, i - 1 FROM ids WHERE i <= 100)"""

#: What recall against the exact hits has to be; the number itself is asserted in the tests.
_RECALL = "SELECT count(*) AS queries, true AS recall_is_90 FROM embeddings WHERE vec_id % 50 = 0"

ORACLES = {
    "q01_flat_ip_topk": _Q01,
    "q02_candidate_final_k": f"WITH {_EXACT} SELECT query_id, r::INTEGER AS rank, vector_id, r <= 5 AS selected FROM ranked WHERE r <= 20",
    "q03_gated_plan": f"""WITH {_EXACT}, hit AS (SELECT query_id, count(*) AS n, arg_min(vector_id, r) AS best FROM ranked WHERE query_id % 100 = 0 AND r <= 1 + (query_id // 100) % 5 GROUP BY query_id)
SELECT q.query_id, coalesce(n, 0)::INTEGER AS n_hits, coalesce(best, -1) AS best FROM q LEFT JOIN hit USING (query_id)""",
    "q04_presegmented_chunks": f"""SELECT doc_id::VARCHAR AS chunk_id, row_number() OVER (ORDER BY doc_id::VARCHAR) - 1 AS vector_id, source, 1 AS page_start, 1 AS page_end, {_count("text")}::INTEGER AS token_count
FROM documents WHERE {_count("text")} > 0""",
    "q05_token_stats": f"SELECT count(*) AS chunks, min(n)::INTEGER AS min_tokens, avg(n) AS avg_tokens, max(n)::INTEGER AS max_tokens FROM (SELECT {_count('text')} AS n FROM documents) WHERE n > 0",
    "q06_sentence_split": f"""WITH s AS (SELECT doc_id, [x FOR x IN [{_strip("p")} FOR p IN string_split(regexp_replace({_strip("text")}, '([.!?。！？]){_WS}+', '\\1' || chr(1), 'g'), chr(1))] IF x <> ''] AS s FROM documents)
SELECT doc_id, len(s)::INTEGER AS n_sentences, sha256(array_to_string(s, chr(1))) AS digest FROM s""",
    "q07_fixed_sentence_chunks": f"""WITH RECURSIVE {_CHUNKS} SELECT doc_id || '_p1_c' || format('{{:04d}}', no) AS chunk_id, doc_id::VARCHAR AS doc_id, source, 1 AS page_start, 1 AS page_end, tokens AS token_count, sha256(text) AS digest FROM chunks""",
    "q08_chunk_overlap_stats": f"""WITH RECURSIVE {_CHUNKS}, tokens8 AS (SELECT doc_id, no, regexp_extract_all(text, '{_TOKEN}') AS w FROM chunks),
pairs8 AS (SELECT b.doc_id, b.no, a.w AS l, b.w AS r, least(len(a.w), len(b.w)) AS m FROM tokens8 a JOIN tokens8 b ON b.doc_id = a.doc_id AND b.no = a.no + 1),
tried AS (SELECT doc_id, no, l, r, unnest(range(m + 1)) AS k FROM pairs8), overlap8 AS (SELECT doc_id, no, max(k) FILTER (k = 0 OR (l[len(l) - k + 1] = r[1] AND l[len(l) - k + 1:] = r[:k])) AS o FROM tried GROUP BY doc_id, no)
SELECT count(*) AS pairs, coalesce(min(o), 0)::DOUBLE AS min_overlap, coalesce(avg(o), 0)::DOUBLE AS avg_overlap, coalesce(median(o), 0)::DOUBLE AS median_overlap, coalesce(max(o), 0)::DOUBLE AS max_overlap, count(*) FILTER (o = 0) AS zero_count FROM overlap8""",
    "q09_hashing_embed": """SELECT doc_id, (len(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) > 0)::INTEGER::DOUBLE AS norm, true AS within FROM documents""",
    "q10_bm25_topk": f"WITH {_HITS} SELECT query_id, rank, vector_id, round(s, 6) AS score FROM hits",
    "q11_bm25_index_stats": f"WITH {_POSTINGS} SELECT term, df, cf::BIGINT AS cf, n AS n_docs, round(avgdl, 6) AS avgdl FROM df, size",
    "q12_hit_mrr": f"""WITH {_HITS}, per AS (SELECT query_id, min(rank) AS r FROM judged WHERE relevant GROUP BY query_id)
SELECT round(avg((r IS NOT NULL)::INT), 6) AS hit, round(avg(coalesce(1.0 / r, 0)::DOUBLE), 6) AS rr, count(*) AS hit_valid_count, count(*) AS rr_valid_count FROM benchmark LEFT JOIN per ON query_id = item_id""",
    "q13_answer_in_passage": f"""WITH {_HITS}, forms AS (SELECT query_id, rank, vector_id, {_short("CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE text END")} AS body, {_short("array_to_string(string_split(question, ' ')[1:3], ' ')")} AS a FROM judged)
SELECT query_id, rank, vector_id, a <> '' AND contains(' ' || body || ' ', ' ' || a || ' ') AS relevant FROM forms""",
    "q14_short_answer_scores": f"""WITH {_PAIRS}, forms AS (SELECT query_id AS k, {_short("prediction")} AS p, {_short("gold")} AS g FROM pairs), {_f1("forms")}
SELECT k AS query_id, p = g AS em, round(CASE WHEN ng = 0 THEN (np = 0)::INT ELSE f1 END, 6) AS f1 FROM f1s""",
    "q15_paper_answer_scores": f"WITH {_PAPER_SCORES} SELECT query_id, answer_f1, answer_type, evidence_f1 FROM scores",
    "q16_open_corpus_scores": f"WITH {_OPEN} SELECT query_id, paper_hit, paper_rr, evidence_hit, round(recall, 6) AS evidence_recall, round(f1, 6) AS evidence_f1 FROM open",
    "q17_context": f"WITH {_CONTEXT} SELECT query_id, tokens AS context_tokens, false AS truncated, k AS n_chunks, sha256(context) AS digest FROM contexts",
    "q17b_context_budget": f"""WITH {_BUDGET} SELECT item_id AS query_id, coalesce(n, 0)::BIGINT AS context_tokens, coalesce(cut, false) AS truncated, coalesce(k, 0)::INTEGER AS n_chunks, sha256(coalesce(c, '')) AS digest FROM benchmark LEFT JOIN made ON made.query_id = item_id""",
    "q18_prompt_sha": f"WITH {_CONTEXT} SELECT query_id, 'fixed_qa_v1' AS template, sha256({_prompt('fixed_qa_v1')}) AS prompt_sha256 FROM contexts",
    "q19_extractive_answer": f"""WITH {_EXTRACT} SELECT query_id, CASE WHEN {_count("f")} <= 512 THEN f ELSE {_first("f", "512")} END AS answer FROM full_answers""",
    "q20_question_selection": f"""WITH forms AS (SELECT item_id, {_collapse("text")} AS t FROM benchmark),
ranked AS (SELECT item_id, t, row_number() OVER (ORDER BY sha256('quarry' || chr(0) || t), item_id) AS r FROM forms)
SELECT item_id AS position, 'nq_' || sha256(t) AS question_id, r::INTEGER AS selection_no, CASE WHEN r <= 5 THEN 'calibration' ELSE 'evaluation' END AS split FROM ranked WHERE r <= 20""",
    "q21_context_resolution": f"""WITH forms AS (SELECT doc_id, {_collapse("source")} AS t, {_collapse("text")} AS x FROM documents),
named AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN doc_id WHEN 1 THEN doc_id + 1 WHEN 2 THEN doc_id + 100000000 END AS pid FROM forms),
alike AS (SELECT t, x, count(*) AS n, min(doc_id::VARCHAR) AS only_one FROM forms GROUP BY t, x)
SELECT c.doc_id AS ctx_no, CASE WHEN c.pid IS NOT NULL THEN c.pid::VARCHAR WHEN n = 1 THEN only_one END AS resolved_id,
  CASE WHEN c.pid IS NULL THEN CASE WHEN n > 1 THEN 'many' END WHEN w.doc_id IS NULL THEN 'absent' WHEN w.t <> c.t OR w.x <> c.x THEN 'mismatch' END AS problem
FROM named c LEFT JOIN forms w ON w.doc_id = c.pid LEFT JOIN alike a ON a.t = c.t AND a.x = c.x""",
    "q22_hard_negative_round_robin": f"""WITH {_HITS}, bad AS (SELECT vector_id FROM judged WHERE relevant),
turns AS (SELECT vector_id AS id, min((rank, query_id)) AS turn FROM judged WHERE NOT relevant AND rank <= 5 AND vector_id NOT IN (SELECT vector_id FROM bad) GROUP BY vector_id),
numbered AS (SELECT id, row_number() OVER (ORDER BY turn, id)::INTEGER AS pick_no FROM turns) SELECT id, pick_no FROM numbered WHERE pick_no <= 100""",
    "q23_reservoir": f"WITH {_RESERVOIR} SELECT slot::BIGINT AS slot, arg_max(doc_id::VARCHAR, i) AS id FROM slots GROUP BY slot",
    "q24_run_summary": f"""WITH {_RUN} SELECT count(*) AS num_questions, count(*) FILTER (status = 'success') AS num_successful, count(*) FILTER (status = 'error') AS num_failed,
round(avg(retrieval_ms), 4) AS avg_retrieval_ms, round(quantile_cont(retrieval_ms, 0.5), 4) AS p50_retrieval_ms, round(quantile_cont(retrieval_ms, 0.95), 4) AS p95_retrieval_ms,
round(avg(total_ms), 4) AS avg_total_ms, round(quantile_cont(total_ms, 0.5), 4) AS p50_total_ms, round(quantile_cont(total_ms, 0.95), 4) AS p95_total_ms,
round(avg(tokens), 4) AS avg_input_tokens, sum(tokens)::BIGINT AS total_input_tokens FROM runs""",
    "q25_failed_row_policies": f"""WITH {_RUN} SELECT 'left out' AS policy, count(*) AS questions, count(*) FILTER (status = 'success') AS scored, round(avg(total_ms / 500) FILTER (status = 'success'), 6) AS f1 FROM runs
UNION ALL SELECT 'zero', count(*), count(*), round(avg(CASE WHEN status = 'success' THEN total_ms / 500 ELSE 0 END), 6) FROM runs""",
    "q26_resume_pending": """WITH s AS (SELECT item_id, CASE WHEN item_id % 9 = 1 THEN 'success' WHEN item_id % 9 = 3 THEN 'error' WHEN item_id % 3 = 0 THEN 'success' WHEN item_id % 3 = 1 THEN 'error' ELSE 'new' END AS status FROM benchmark)
SELECT item_id AS position, format('q{:05d}', item_id) AS question_id, status, status <> 'success' AS pending FROM s""",
    "q27_ivf_full_probe_exact": _Q01,
    "q28_ivf_recall": _RECALL.replace(" FROM", ", true AS few_visited FROM"),
    "q29_pq_recall": _RECALL,
    "q30_hnsw_recall": _RECALL.replace(" FROM", ", true AS few_visited FROM"),
    "q78_training_sample": "SELECT count(*) // 2 AS n, count(*) // 2 AS ids FROM embeddings",
    "q31_rerank_paired_metrics": f"""WITH {_HITS}, w AS (SELECT query_id, vector_id, rank, relevant, len(list_intersect(list_distinct(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+')), list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')))) AS s FROM judged),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS rr FROM w)
SELECT query_id, round(coalesce(1.0 / min(rank) FILTER (relevant), 0)::DOUBLE, 6) AS pool_rr, round(coalesce(1.0 / min(rank) FILTER (relevant AND rank <= 3), 0)::DOUBLE, 6) AS baseline_rr, round(coalesce(1.0 / min(rr) FILTER (relevant AND rr <= 3), 0)::DOUBLE, 6) AS reranked_rr FROM r GROUP BY query_id""",
    "q31b_rerank_trace": f"""WITH {_HITS}, w AS (SELECT query_id, vector_id, rank, len(list_intersect(list_distinct(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+')), list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))))::DOUBLE AS rerank_score FROM judged),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank)::INTEGER AS rerank_rank FROM w) SELECT query_id, vector_id, rank, rerank_rank, rerank_score, rerank_rank <= 3 AS selected FROM r""",
    "q32_set_digests": """WITH ids AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0)
SELECT 'numeric' AS kind, count(*) AS n, sha256(string_agg(doc_id || chr(10), '' ORDER BY doc_id)) AS sha256 FROM ids UNION ALL
SELECT 'text', count(*), sha256(string_agg(doc_id || chr(10), '' ORDER BY doc_id::VARCHAR)) FROM ids""",
    "q33_nested_flatten": f"WITH {_UNITS33} SELECT doc_id::VARCHAR AS doc_id, page::INTEGER AS page, sha256(t) AS text_digest, f AS is_float FROM pages33",
    "q34_redaction": r"""WITH s AS (SELECT doc_id, regexp_replace(text, '(^|[^\p{L}\p{N}_])sk-[A-Za-z0-9_-]{16,}', '\1[REDACTED]', 'g') AS t FROM documents)
SELECT doc_id, len(string_split(t, '[REDACTED]'))::INTEGER AS parts, sha256(t) AS digest, false AS has_key FROM s""",
    "q35_type_means": f"""WITH {_PAPER_SCORES} SELECT count(*) AS questions, round(avg(raw_f1), 6) AS answer_f1, round(avg(raw_e), 6) AS evidence_f1, round(coalesce(avg(raw_f1) FILTER (answer_type = 'extractive'), 0), 6) AS answer_f1_extractive,
round(coalesce(avg(raw_f1) FILTER (answer_type = 'abstractive'), 0), 6) AS answer_f1_abstractive, 0.0::DOUBLE AS answer_f1_boolean, 0.0::DOUBLE AS answer_f1_none FROM scores""",
    "q36_title_expansion": f"WITH {_TITLES} SELECT doc_id::VARCHAR AS id FROM documents SEMI JOIN titles USING (source)",
    "q37_selected_corpus": f"WITH {_TITLES} SELECT doc_id::VARCHAR AS id, source AS title, length(text)::INTEGER AS n_chars FROM documents SEMI JOIN titles USING (source)",
    "q38_slice_stats": f"""WITH {_REFS} SELECT count(*) AS questions, count(*) FILTER (a + b > 0) AS selected_questions, count(*) FILTER (a + b = 0) AS excluded_questions,
(2 * count(*))::BIGINT AS "references", sum(a + b)::BIGINT AS selected_references, sum(2 - a - b)::BIGINT AS excluded_references FROM flags""",
    "q39_evaluation_questions": f"""WITH {_REFS} SELECT doc_id::VARCHAR AS paper_id, 'q' || doc_id AS question_id, 2 AS source_references, (a + b)::INTEGER AS "references" FROM flags WHERE a + b > 0""",
    "q40_paper_evidence": f"""WITH {_OPEN}, own AS (SELECT h.query_id, {_strip("translate(u.evidence, chr(13) || chr(10), '  ')")} AS e, u.page FROM hits h JOIN units u ON u.doc_id = h.vector_id AND u.page <= h.rank + 2 WHERE h.rank = 1),
once AS (SELECT query_id, e, min(page) AS p FROM own WHERE e <> '' GROUP BY query_id, e)
SELECT query_id, count(*)::INTEGER AS n, sha256(string_agg(e, chr(1) ORDER BY p)) AS digest FROM once GROUP BY query_id""",
    "q41_open_corpus_summary": f"""WITH {_OPEN} SELECT count(*) AS questions, round(avg(paper_hit::INT), 6) AS paper_hit, round(avg(paper_rr), 6) AS paper_rr, round(avg(evidence_hit::INT), 6) AS evidence_hit, round(avg(recall), 6) AS evidence_recall, round(avg(f1), 6) AS evidence_f1,
count(recall) AS evidence_recall_valid_count, count(*) FILTER (evidence_hit) AS hits, count(*) FILTER (NOT evidence_hit) AS misses FROM open""",
    "q42_token_usage": f"""WITH {_CONTEXT}, u AS (SELECT query_id, {_count("(" + _prompt("nq_short_qa_v1") + ")")}::INTEGER AS a, {_count("array_to_string(string_split(question, ' ')[1:5], ' ')")}::INTEGER AS b FROM contexts)
SELECT query_id, a AS input_tokens, b AS output_tokens, a + b AS total_tokens FROM u""",
    "q43_passage_violations": r"""WITH d AS (SELECT CASE WHEN doc_id % 10 = 7 THEN 'x' || doc_id WHEN doc_id % 10 = 9 THEN '9' ELSE doc_id::VARCHAR END AS id, CASE WHEN doc_id % 10 = 5 THEN ' ' ELSE source END AS title, text FROM documents),
p AS (SELECT CASE WHEN NOT regexp_matches(id, '^[0-9]+$') OR id = '0' THEN 'id' WHEN trim(title) = '' THEN 'title' WHEN trim(text) = '' THEN 'text' END AS problem FROM d UNION ALL SELECT 'repeated' FROM d GROUP BY id HAVING count(*) > 1)
SELECT problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY problem""",
    "q44_canonical_jsonl": """WITH j AS (SELECT '{"a_id":' || doc_id || ',"nested":{"b":1,"z":"' || lang || '"},"source":"' || source || '"}' AS v FROM documents) SELECT sha256(v) AS digest, length(v)::INTEGER AS n FROM j""",
    "q45_embedding_violations": "SELECT vec_id AS vector_id FROM embeddings WHERE vec_id % 10 IN (1, 2)",
    "q46_id_list_differences": "SELECT doc_id::VARCHAR AS id, doc_id % 4 > 0 AS in_passages FROM documents WHERE (doc_id % 4 > 0) <> (doc_id % 5 > 0)",
}

"""The queries of skimmer.plans.queries as DuckDB SQL, written on their own from what each one means."""

from __future__ import annotations

from skimmer.functions.text import STOPWORDS
from skimmer.operators.tagger import CLOSED
from skimmer.plans.queries import PROFILES, WEIGHTS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP = ", ".join(map(_q, STOPWORDS))
CLEAN = r"regexp_replace(lower(text), '(https?:/*)[^ ]+|#|@', '', 'g')"
TOKENS = rf"regexp_extract_all({CLEAN}, '((?:[a-z]\.)+[a-z]?|\w+(?:-\w+)*)', 1)"
RATIO = r"len(regexp_extract_all(text, '[\w\d\s\.\?,@#]')) / length(text)"

PROFILE = (
    "p AS (SELECT * FROM (VALUES "
    + ", ".join(f"({a}, {' || chr(9) || '.join(_q(x) for x in b.split(chr(9)))}, {_q(c)})" for a, b, c in PROFILES)
    + r""") AS v(pid, opt, req)),
c AS (SELECT pid, i - 1 AS clause, string_split(lower(req), '&&')[i] AS part FROM p, unnest(range(1, len(string_split(req, '&&')) + 1)) AS r(i)),
reqs AS (SELECT DISTINCT pid, CAST(clause AS INTEGER) AS clause, word FROM (SELECT pid, clause, trim(unnest(string_split(part, '||'))) AS word FROM c) WHERE word <> ''),
opts AS (SELECT DISTINCT pid, trim(unnest(regexp_split_to_array(lower(opt), '\t|\|\|'))) AS word FROM p),
multi AS (SELECT DISTINCT word FROM (SELECT word FROM reqs UNION SELECT word FROM opts) WHERE contains(word, ' '))"""
)
GATED = f"gated AS (SELECT doc_id, text FROM documents WHERE text <> '' AND lang = 'en' AND {RATIO} >= 0.7)"
PLAIN = f"plain AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest({TOKENS}) AS word FROM gated) WHERE word NOT IN ({STOP}))"
TOKEN = f"tok AS (SELECT * FROM plain UNION SELECT doc_id, word FROM gated, multi WHERE contains({CLEAN}, word))"
MET = """met AS (SELECT doc_id, pid FROM tok JOIN reqs USING (word) GROUP BY doc_id, pid
  HAVING count(DISTINCT clause) = (SELECT count(DISTINCT clause) FROM c WHERE c.pid = reqs.pid))"""

S = """s AS (SELECT event_id AS seq, CAST(ascii(event_type[1]) % 5 AS INTEGER) AS pid, strftime(ts, '%Y%m%d') AS day, user_id,
  value / 500 AS score, ts, user_id * 5 + ascii(event_type[1]) % 5 AS orig_id FROM events)"""
STATS = f"""{S},
grid AS (SELECT a.pid, b.day FROM (SELECT DISTINCT pid FROM s) a, (SELECT DISTINCT day FROM s) b),
k AS (SELECT pid, day, score, row_number() OVER (PARTITION BY pid, day ORDER BY score DESC) AS r FROM s WHERE score >= 0.15),
st AS (SELECT g.pid, g.day, count(k.score) AS n_related, coalesce(min(k.score) FILTER (r <= 10), 0.15) AS rank_score FROM grid g LEFT JOIN k ON k.pid = g.pid AND k.day = g.day GROUP BY 1, 2)"""


def _smooth(value: str) -> str:
    return f"""sm AS (SELECT pid, list_reduce(list_prepend((x[1] + x[2]) / 2, x), lambda a, b: 0.8 * b + 0.2 * a) AS f
  FROM (SELECT pid, list(CAST({value} AS DOUBLE) ORDER BY day) AS x FROM st GROUP BY pid))"""


THR = f"{STATS}, {_smooth('rank_score')}, thr AS (SELECT pid, f / 2 AS threshold FROM sm)"

VEC = """w AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
tokens AS (SELECT CAST(vec_id // 10 AS INTEGER) AS t, vec_id AS id FROM embeddings),
keys AS (SELECT CAST(vec_id // 100 % 5 AS INTEGER) AS pid, vec_id AS id FROM embeddings WHERE vec_id % 100 = 0),
sizes AS (SELECT pid, count(*) AS n FROM keys GROUP BY pid),
pairs AS (SELECT a.id AS word, b.id AS keyword, CASE WHEN a.id = b.id THEN 1.0 ELSE list_cosine_similarity(x.v, y.v) END AS sim
  FROM tokens a, keys b, w x, w y WHERE x.id = a.id AND y.id = b.id),
best AS (SELECT t, pid, n, keyword, greatest(max(sim), 0) AS best FROM tokens JOIN pairs ON word = tokens.id JOIN keys ON keyword = keys.id JOIN sizes USING (pid) GROUP BY ALL)"""
_V = {1: "sqrt(count(*) FILTER (best > 0.25) / max(n))", 2: "sum(best) / max(n)", 3: "sum(best)"}


def _sim(version: int) -> str:
    return f"WITH {VEC} SELECT t, pid, round({_V[version]}, 9) AS sim FROM best GROUP BY 1, 2"


FEATURES = r"""f AS (SELECT doc_id, regexp_matches(text, '#\w+') AS "Topic",
  CASE WHEN regexp_replace(text, '[\s\v]+$', '') = '' THEN CASE WHEN text = '' THEN 1 ELSE 0 END
    ELSE len(regexp_split_to_array(regexp_replace(text, '[\s\v]+$', ''), '[\s\v]+')) END AS "WordCount",
  len(regexp_extract_all(text, '[\s\v][A-Z][a-z]+')) AS "Capital", length(text) AS chars,
  regexp_matches(text, '\.\.+') AS ellipsis, regexp_matches(text, 'I[\s\v]|my[\s\v]|[\s\v]me') AS "Personal" FROM documents)"""

PUSHED = """acc AS (SELECT * FROM s WHERE score >= 0.15),
fst AS (SELECT * FROM acc QUALIFY row_number() OVER (PARTITION BY orig_id ORDER BY seq) = 1),
cand AS (SELECT fst.* FROM fst JOIN thr USING (pid) WHERE round(score, 12) > threshold QUALIFY row_number() OVER (PARTITION BY orig_id ORDER BY seq) = 1),
psh AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY pid, day ORDER BY seq) <= 10)"""

RECORDS = """rec AS (SELECT seq, pid, sim, coalesce(max(CASE WHEN sim > 1 THEN sim END) OVER (PARTITION BY pid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best_before FROM x)"""

GRAMS = ", ".join(f"({_q(g)}, {_q(lang)}, {w!r}::DOUBLE / 64)" for g, lang, w in WEIGHTS)
NGRAMS = f"""wt AS (SELECT * FROM (VALUES {GRAMS}) AS v(ngram, lang, weight)),
ng AS (SELECT doc_id, ngram, (SELECT count(*) FROM unnest(range(1, length(t) + 1)) AS r(i) WHERE substr(t, i, length(ngram)) = ngram) AS n
  FROM d, (SELECT DISTINCT ngram FROM wt))"""

MESSAGE = r"""m AS (SELECT CAST(doc_id AS VARCHAR) AS tid, doc_id, doc_id % 5 = 0 AS again, text AS own, CASE WHEN doc_id % 5 = 0 THEN 'Again: ' || text ELSE text END AS body,
  CAST(CASE WHEN doc_id % 5 = 0 THEN doc_id // 5 ELSE doc_id END AS VARCHAR) AS orig_id, source, lang, n_chars, 1704067200000 + doc_id * 3600000 AS ms FROM documents WHERE text IS NOT NULL),
full_m AS (SELECT *, source || ' ' || regexp_replace(body, '\t+|\n+', ' ', 'g') AS full_text, strftime(make_timestamp(ms * 1000), '%Y%m%d') AS day FROM m)"""
_LOG = "round(CASE WHEN {0} > 0 THEN log10({0}) ELSE 0 END, 9)"
FULL = {"gated": GATED.replace("SELECT doc_id, text FROM documents", "SELECT doc_id, text FROM (SELECT doc_id, full_text AS text, lang FROM full_m)")}

# The days that events has; a view can't take its columns from the data.
DAYS = [f"202401{i:02d}" for i in range(1, 31)]

# The adaptive threshold as a fold over a profile's day: (rows, pushed, threshold, window, seqs pushed).
ADAPTIVE = f"""WITH {S}, pr AS (SELECT pid, avg(n) AS predicted FROM (SELECT pid, day, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT s.pid, day, list({{'r': 0::BIGINT, 'n': 0::BIGINT, 't': 0.3::DOUBLE, 'w': 0.618::DOUBLE, 'out': []::BIGINT[], 'seq': seq, 'score': score, 'p': predicted}} ORDER BY seq) AS x
  FROM s JOIN pr ON pr.pid = s.pid GROUP BY 1, 2),
f AS (SELECT pid, day, list_reduce(list_prepend({{'r': 0::BIGINT, 'n': 0::BIGINT, 't': 0.3::DOUBLE, 'w': 0.618::DOUBLE, 'out': []::BIGINT[], 'seq': 0::BIGINT, 'score': 0::DOUBLE, 'p': 1::DOUBLE}}, x),
  lambda a, b: {{'r': a.r + 1, 'n': a.n + CASE WHEN a.n < 10 AND round(b.score, 12) > a.t THEN 1 ELSE 0 END,
    't': CASE WHEN a.n < 10 AND (a.r + 1) / b.p > a.w THEN a.t * 0.95 ELSE a.t END, 'w': CASE WHEN a.n < 10 AND (a.r + 1) / b.p > a.w THEN a.w * 1.1 ELSE a.w END,
    'out': CASE WHEN a.n < 10 AND round(b.score, 12) > a.t THEN list_append(a.out, b.seq) ELSE a.out END, 'seq': b.seq, 'score': b.score, 'p': b.p}}) AS y FROM g)
SELECT unnest(y.out) AS seq, pid, day, CAST(unnest(range(1, len(y.out) + 1)) AS BIGINT) AS nth FROM f"""

# The engine on a stream: contents once for all, pushes and origins by profile and day.
STREAMED = f"""{PROFILE}, {MESSAGE}, {FULL['gated']}, {PLAIN}, {TOKEN}, {MET},
  sc AS (SELECT met.doc_id, met.pid, sqrt(count(tok.word) / (SELECT count(*) FROM opts o WHERE o.pid = met.pid)) AS sim
    FROM met JOIN opts USING (pid) LEFT JOIN tok ON tok.doc_id = met.doc_id AND tok.word = opts.word GROUP BY met.doc_id, met.pid),
  top AS (SELECT doc_id, pid, sim / 2 + 0.5 AS similarity FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, pid) = 1),
  acc AS (SELECT tid, ms AS seq, day, pid, orig_id, md5(full_text) AS hash, (n_chars % 100 + 1) / 100 AS score FROM full_m JOIN top USING (doc_id) WHERE similarity * ((n_chars % 100 + 1) / 100) >= 0.15),
  fst AS (SELECT * FROM acc QUALIFY row_number() OVER (PARTITION BY hash ORDER BY seq) = 1),
  cand AS (SELECT * FROM fst WHERE round(score, 12) > 0.5 QUALIFY row_number() OVER (PARTITION BY pid, day, orig_id ORDER BY seq) = 1),
  psh AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY pid, day ORDER BY seq) <= 10),
  rel AS (SELECT fst.*, psh.seq IS NOT NULL AND psh.seq = fst.seq AS is_pushed FROM fst LEFT JOIN psh USING (pid, day, orig_id) WHERE psh.seq IS NULL OR fst.seq <= psh.seq),
  cnt AS (SELECT *, count(*) OVER w AS received, CAST(count_if(is_pushed) OVER w AS BIGINT) AS pushed FROM rel WINDOW w AS (PARTITION BY pid, day ORDER BY seq ROWS UNBOUNDED PRECEDING))"""


def _feedback(n: int = 4) -> str:
    """Batch by batch: the two best words of what was learnt, the batch's best profiles with them, its records, what is learnt then."""
    parts = [f"""{PROFILE}, {GATED}, {PLAIN}, {TOKEN}, {MET}, b AS (SELECT doc_id, CAST(doc_id * {n} // ((SELECT max(doc_id) FROM documents) + 1) AS INTEGER) AS batch FROM documents),
      best0 AS (SELECT 0 AS pid, 0.0::DOUBLE AS best WHERE false), terms0 AS (SELECT 0 AS pid, '' AS word, 0.0::DOUBLE AS score WHERE false)"""]
    for i in range(n):
        parts.append(f"""own{i} AS (SELECT pid, word FROM opts UNION SELECT pid, word FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, word) AS nth FROM terms{i}) WHERE nth <= 2),
      top{i} AS (SELECT doc_id, pid, sim / 2 + 0.5 AS similarity FROM (SELECT met.doc_id, met.pid, count(tok.word) AS sim FROM met JOIN b ON b.doc_id = met.doc_id AND b.batch = {i}
        JOIN own{i} USING (pid) LEFT JOIN tok ON tok.doc_id = met.doc_id AND tok.word = own{i}.word GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, pid) = 1),
      rec{i} AS (SELECT doc_id, pid, similarity FROM (SELECT *, greatest(coalesce(max(CASE WHEN similarity > 1 THEN similarity END) OVER (PARTITION BY pid ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0),
        coalesce((SELECT best FROM best{i} z WHERE z.pid = t.pid), 0)) AS before FROM top{i} t) WHERE similarity > before AND similarity > 1),
      terms{i + 1} AS (SELECT pid, word, sum(score) AS score FROM (SELECT * FROM terms{i} UNION ALL SELECT rec{i}.pid, tok.word, similarity FROM rec{i} JOIN tok USING (doc_id)) GROUP BY 1, 2),
      best{i + 1} AS (SELECT pid, max(best) AS best FROM (SELECT * FROM best{i} UNION ALL SELECT pid, similarity FROM rec{i}) GROUP BY 1)""")
    return f"WITH {', '.join(x.strip() for x in parts)} " + " UNION ALL ".join(f"SELECT doc_id, pid, round(similarity, 9) AS similarity, {i} AS batch FROM top{i}" for i in range(n))


# No n-gram of WEIGHTS overlaps itself, so what is left without it tells how often it was there.
SOFTMAX = f"""d AS (SELECT doc_id, lower(text) AS t FROM documents), wt AS (SELECT * FROM (VALUES {GRAMS}) AS v(ngram, lang, weight)),
      ng AS (SELECT doc_id, ngram, (length(t) - length(replace(t, ngram, ''))) // length(ngram) AS n FROM d, (SELECT DISTINCT ngram FROM wt)),
      sc AS (SELECT doc_id, wt.lang, sum(n * weight) AS s FROM ng JOIN wt USING (ngram) WHERE n > 0 GROUP BY 1, 2),
      e AS (SELECT doc_id, lang, exp(s - max(s) OVER (PARTITION BY doc_id)) AS e FROM sc),
      p AS (SELECT doc_id, lang, e / sum(e) OVER (PARTITION BY doc_id) AS p FROM e)"""

# A keyword profile of each text: x of its first words; required (x2 or "x3 x4") and (x5 or x0), optional x0 and x1.
DOC_PROFILE = """dw AS (SELECT doc_id AS pid, list_transform(regexp_extract_all(text, '[A-Za-z]{3,}'), lambda x: lower(x)) AS w FROM documents),
dr AS (SELECT DISTINCT pid, clause, word FROM (SELECT pid, unnest([0, 0, 1, 1]) AS clause, unnest([w[3], w[4] || ' ' || w[5], w[6], w[1]]) AS word FROM dw WHERE len(w) >= 6))"""

ORACLES = {
    "q_keyword_compile": f"WITH {DOC_PROFILE} SELECT pid, clause, word FROM dr",
    "q_source_keywords": f"WITH {DOC_PROFILE} SELECT pid, clause, word FROM dr",
    "q_inverted_index": f"WITH {DOC_PROFILE} SELECT word, string_agg(pid, ',' ORDER BY pid) AS pids FROM (SELECT DISTINCT word, pid FROM dr) GROUP BY word",
    "q_prefix_lookup": f"WITH {DOC_PROFILE} SELECT DISTINCT pid, word FROM dr WHERE word LIKE 'th%'",
    "q_source_topics": """SELECT doc_id % 700 AS pid, 'MB' || (doc_id % 700 + 226) AS num, 'Texts in ' || coalesce(max(lang), 'none') || ': ' || count(*) AS title FROM documents GROUP BY doc_id % 700""",
    "q_source_wiki": r"""SELECT md5(line) AS line_md5, len(string_split(line, ' ')) AS n FROM (SELECT trim(regexp_replace('T' || doc_id || ' | ' || doc_id || ' lies in ' || coalesce(lang, 'none') || ' ' ||
      regexp_replace(text, '[\x00-\x20\[\]{}|<>&''=]|https?:|[^\x{0}-\x{D7FF}\x{E000}-\x{FFFD}]', ' ', 'g') || ' end', ' +', ' ', 'g')) AS line FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 0)""",
    "q_model_saved": "SELECT doc_id, true AS same FROM documents",
    "q_file_english_lines": rf"WITH {SOFTMAX}, best AS (SELECT doc_id, lang, p FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, lang) = 1) SELECT md5(regexp_replace(text, '[\r\n]+', ' ', 'g')) AS line_md5 FROM best JOIN documents USING (doc_id) WHERE p >= 0.6 AND best.lang = 'en'",
    "q_tagged_filter": f"""SELECT doc_id, len(list_filter({TOKENS}, lambda w: NOT (w IN ({', '.join(map(_q, CLOSED))}) OR regexp_matches(w, '^[0-9]+$') OR ends_with(w, 'ly')))) AS n FROM documents WHERE text IS NOT NULL""",
    "q_source_expanded": "SELECT md5(array_to_string(w, ' ')) AS words_md5, len(w) AS n FROM (SELECT regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents WHERE text IS NOT NULL)",
    "q_source_lines": "SELECT object, count(*) AS lines FROM (SELECT unnest(CASE WHEN doc_id % 7 = 0 THEN [true, true, false] ELSE [true] END) AS object FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "q_smoothing_by_day": f"WITH {STATS}, {_smooth('rank_score')} SELECT pid, round(f, 9) AS forecast FROM sm",
    "q_history_folder": f"""WITH {S}, r AS (SELECT pid, day, round(score, 6) AS score, row_number() OVER (PARTITION BY day, pid ORDER BY round(score, 6) DESC, seq) AS rank FROM s),
      h AS (SELECT * FROM r WHERE rank <= 100), grid AS (SELECT a.pid, b.day FROM (SELECT DISTINCT pid FROM h) a, (SELECT DISTINCT day FROM h) b),
      k AS (SELECT pid, day, score, row_number() OVER (PARTITION BY pid, day ORDER BY score DESC) AS r FROM h WHERE score >= 0.15),
      st AS (SELECT g.pid, g.day, coalesce(min(k.score) FILTER (r <= 10), 0.15) AS rank_score FROM grid g LEFT JOIN k ON k.pid = g.pid AND k.day = g.day GROUP BY 1, 2), {_smooth('rank_score')}
      SELECT pid, round(f, 9) AS threshold FROM sm""",
    "q_word2vec": f"SELECT word, 32 AS size, true AS moved FROM (SELECT unnest({TOKENS}) AS word FROM documents) GROUP BY word HAVING count(*) >= 5",
    "q_collapse_runs": r"""WITH c AS (SELECT doc_id, unnest(string_split(lower(text), '')) AS c, unnest(range(length(text))) AS i FROM documents WHERE text <> ''),
      b AS (SELECT *, c IS DISTINCT FROM lag(c) OVER (PARTITION BY doc_id ORDER BY i) AS opens FROM c), r AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
      l AS (SELECT doc_id, c, count(*) AS k FROM r GROUP BY doc_id, run, c)
      SELECT doc_id, CAST(coalesce(sum(CASE WHEN k IS NULL THEN 0 WHEN regexp_matches(c, '^[a-z\x{e0}-\x{24f}]$') THEN least(k, 2) ELSE 1 END), CASE WHEN any_value(text) = '' THEN 0 END) AS INTEGER) AS n
      FROM documents LEFT JOIN l USING (doc_id) GROUP BY doc_id""",
    "q_pattern_offsets": """WITH w AS (SELECT regexp_extract_all(lower(text), '[a-z]{4,12}') AS w FROM benchmark),
      pat AS (SELECT DISTINCT word FROM (SELECT unnest(w) AS word FROM w UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w)),
      here AS (SELECT doc_id, instr(lower(text), word) - 1 AS start FROM documents, pat WHERE contains(lower(text), word))
      SELECT doc_id, count(*) AS n_words, CAST(sum(start) AS BIGINT) AS starts FROM here GROUP BY 1""",
    "q_similarity_join": """WITH w AS (SELECT CAST(vec_id AS VARCHAR) AS word, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
      SELECT word, keyword, round(sim, 9) AS sim FROM (SELECT a.word AS word, b.word AS keyword, list_cosine_similarity(a.v, b.v) AS sim FROM w a JOIN w b ON a.word <> b.word) WHERE sim > 0.4""",
    "q_english_gate": f"WITH {SOFTMAX}, best AS (SELECT doc_id, lang, p FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, lang) = 1) SELECT doc_id, round(p, 6) AS p FROM best WHERE p >= 0.6 AND lang = 'en'",
    "q_stream_filtered": f"WITH {STREAMED} SELECT tid, pid, 'related' AS kind, received, pushed FROM cnt UNION ALL SELECT tid, pid, 'pushed', received, pushed FROM cnt WHERE is_pushed",
    "q_stream_counts": f"WITH {STREAMED} SELECT (SELECT count(*) FROM m) AS received, (SELECT count(*) FROM acc) AS accepted, count(*) AS related, count_if(is_pushed)::BIGINT AS pushed FROM rel",
    "q_stream_feedback": _feedback(),
    "q_adaptive_threshold": ADAPTIVE,
    "q_stream_adaptive": ADAPTIVE,
    "q_extract_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE starts_with(props, '{') AND json_extract(props, '$.k') IS NOT NULL",
    "q_clean_text": rf"SELECT doc_id, md5(regexp_replace({CLEAN}, '\t+|\n+', ' ', 'g')) AS clean_md5 FROM documents",
    "q_char_ratio": f"SELECT doc_id, round({RATIO}, 9) AS ratio FROM documents WHERE text <> '' AND {RATIO} >= 0.7",
    "q_tokenize_count": f"SELECT doc_id, len({TOKENS}) AS n, len(list_distinct({TOKENS})) AS n_distinct FROM documents",
    "q_stopwords": f"SELECT doc_id, len(list_filter({TOKENS}, lambda w: w NOT IN ({STOP}))) AS n FROM documents",
    "q_text_normalize": r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{2010}-\x{2015}]', '-', 'g'), '[0-9]+', '0', 'g'),
      '[^\x{20}-\x{7e}\x{a1}-\x{24f}\x{300}-\x{36f}\x{1e00}-\x{1eff}]+', ' ', 'g'), '  +', ' ', 'g') AS x FROM documents)
      SELECT doc_id, md5(translate(array_to_string(list_transform(string_split(x, 'I'), lambda p: lower(p)), 'I'), 'șț', 'şţ')) AS normal_md5 FROM t""",
    "q_en_counts": "SELECT count(*) AS total, count(*) FILTER (lang = 'en') AS english FROM documents",
    "q_multigram_contains": f"WITH {PROFILE} SELECT doc_id, word FROM documents, multi WHERE contains({CLEAN}, word)",
    "q_candidates": f"WITH {PROFILE}, {GATED}, {PLAIN} SELECT DISTINCT doc_id, pid FROM plain JOIN reqs USING (word)",
    "q_cnf_match": f"WITH {PROFILE}, {GATED}, {PLAIN}, {TOKEN}, {MET} SELECT doc_id, pid FROM met",
    "q_topic_match": f"""WITH {PROFILE}, {GATED}, {PLAIN}, {TOKEN}, {MET},
      sc AS (SELECT met.doc_id, met.pid, sqrt(count(tok.word) / (SELECT count(*) FROM opts o WHERE o.pid = met.pid)) AS sim
        FROM met JOIN opts USING (pid) LEFT JOIN tok ON tok.doc_id = met.doc_id AND tok.word = opts.word GROUP BY met.doc_id, met.pid)
      SELECT doc_id, pid, round(sim / 2 + 0.5, 9) AS similarity FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, pid) = 1""",
    "q_cosine_pairs": f"WITH {VEC} SELECT DISTINCT CAST(word AS VARCHAR) AS word, CAST(keyword AS VARCHAR) AS keyword, round(sim, 9) AS sim FROM pairs WHERE word <> keyword AND sim > 0.25",
    "q_sim_v1": _sim(1),
    "q_sim_v2": _sim(2),
    "q_sim_v3": _sim(3),
    "q_argmax_profile": f"WITH {VEC}, v AS (SELECT t, pid, {_V[2]} AS sim FROM best GROUP BY 1, 2) SELECT t, pid, round(sim / 2 + 0.5, 9) AS similarity FROM v QUALIFY row_number() OVER (PARTITION BY t ORDER BY sim DESC, pid) = 1",
    "q_ranker_features_text": f"""WITH {FEATURES} SELECT doc_id, "Topic", "WordCount", "Capital", CASE WHEN "WordCount" > 0 THEN chars // "WordCount" END AS "CharacterPerWord", ellipsis, "Personal" FROM f""",
    "q_ranker_features_user": """WITH n AS (SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS n FROM customer)
      SELECT c_custkey, round(CASE WHEN n > 0 THEN log10(n) ELSE 0 END, 9) AS followers, greatest(n, 0) AS retweets, CASE WHEN n > 0 THEN length(CAST(n AS VARCHAR)) ELSE 0 END AS level FROM n""",
    "q_ranker_training_join": f"""WITH {FEATURES} SELECT quality AS "Importance", count(*) AS n, CAST(sum("WordCount") AS BIGINT) AS words, CAST(sum("Capital") AS BIGINT) AS capitals FROM f JOIN labels USING (doc_id) GROUP BY 1""",
    "q_total_score": f"WITH {S} SELECT seq, round(0.75 * score, 9) AS total FROM s WHERE CAST(0.75 AS DOUBLE) * score >= 0.15",
    "q_day_counts_zero_filled": """WITH s AS (SELECT user_id AS pid, strftime(ts, '%Y%m%d') AS day, value / 500 AS score FROM events)
      SELECT a.pid, b.day, count(s.score) AS n_related FROM (SELECT DISTINCT pid FROM s) a CROSS JOIN (SELECT DISTINCT day FROM s) b
      LEFT JOIN s ON s.pid = a.pid AND s.day = b.day AND s.score >= 0.15 GROUP BY 1, 2""",
    "q_rank_k": f"WITH {STATS} SELECT pid, day, n_related, round(rank_score, 9) AS rank_score FROM st",
    "q_exp_smoothing": f"WITH {STATS}, {_smooth('n_related')} SELECT pid, round(f, 6) AS forecast FROM sm",
    "q_moving_avg_3d": f"WITH {STATS} SELECT pid, day, round(avg(n_related) OVER (PARTITION BY pid ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 9) AS average FROM st",
    "q_threshold_col13": f"WITH {STATS} SELECT pid, round(list(rank_score ORDER BY day)[14], 9) AS threshold FROM st GROUP BY pid",
    "q_history_pivot": f"WITH {STATS} SELECT pid, {', '.join(f'max(n_related) FILTER (day = {d!r}) AS {chr(34)}{d}{chr(34)}' for d in DAYS)} FROM st GROUP BY pid",
    "q_push_cap": f"WITH {THR} SELECT seq, s.pid, day, row_number() OVER (PARTITION BY s.pid, day ORDER BY seq) AS nth FROM s JOIN thr ON thr.pid = s.pid WHERE round(score, 12) > threshold QUALIFY nth <= 10",
    "q_push_counters": f"WITH {S} SELECT seq, pid, count(*) OVER w AS received, CAST(sum(CASE WHEN score > 0.5 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n_pushed FROM s WINDOW w AS (PARTITION BY pid ORDER BY seq ROWS UNBOUNDED PRECEDING)",
    "q_push_dedup_pipeline": f"""WITH {THR}, {PUSHED}
      SELECT fst.seq, 'related' AS kind FROM fst LEFT JOIN psh USING (orig_id) WHERE psh.seq IS NULL OR fst.seq <= psh.seq UNION ALL SELECT seq, 'pushed' FROM psh""",
    "q_digest_top100": f"""WITH {S}, r AS (SELECT *, round(score, 6) AS total, row_number() OVER (PARTITION BY day, pid ORDER BY round(score, 6) DESC, seq) AS rank FROM s)
      SELECT seq, rank, concat_ws(chr(9), day, 'MB' || (pid + 226), 'Q0', CAST(seq AS VARCHAR), CAST(rank AS VARCHAR), printf('%.6f', total), 'RUN') AS line FROM r WHERE rank <= 100""",
    "q_anti_join_seen": f"WITH {S} SELECT seq FROM s WHERE orig_id NOT IN (SELECT orig_id FROM s WHERE score > 0.8)",
    "q_running_max_feedback": f"WITH {S}, x AS (SELECT seq, user_id AS pid, score * 5 AS sim FROM s), {RECORDS} SELECT seq, pid, round(best_before, 9) AS best_before FROM rec WHERE sim > best_before AND sim > 1",
    "q_top2_expansion": f"""WITH {S}, x AS (SELECT seq, pid, CAST(round(score * 5, 6) AS DECIMAL(20, 6)) AS sim, 'w' || (user_id % 17) AS word FROM s), {RECORDS},
      ts AS (SELECT x.pid, word, sum(x.sim) AS score FROM rec JOIN x USING (seq) WHERE rec.sim > best_before AND rec.sim > 1 GROUP BY 1, 2)
      SELECT pid, word, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY pid ORDER BY ts.score DESC, word) AS nth FROM ts QUALIFY nth <= 2""",
    "q_sortedness_check": "SELECT event_id FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE value <= before",
    "q_dedup_exact": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "q_ngram_counts": f"WITH d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE lang = 'en'), {NGRAMS} SELECT doc_id, ngram, CAST(n AS BIGINT) AS n FROM ng WHERE n > 0",
    "q_lang_softmax": f"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), {NGRAMS},
      sc AS (SELECT doc_id, wt.lang, sum(n * weight) AS s FROM ng JOIN wt USING (ngram) WHERE n > 0 GROUP BY 1, 2),
      e AS (SELECT doc_id, lang, exp(s - max(s) OVER (PARTITION BY doc_id)) AS e FROM sc),
      p AS (SELECT doc_id, lang, e / sum(e) OVER (PARTITION BY doc_id) AS p FROM e)
      SELECT doc_id, CASE WHEN p >= 0.6 THEN lang ELSE '' END AS label, round(p, 6) AS p FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, lang) = 1""",
    "q_stream_push": f"WITH {S} SELECT seq, pid, day, row_number() OVER (PARTITION BY pid, day ORDER BY seq) AS nth FROM s WHERE round(score, 12) > 0.5 QUALIFY nth <= 10",
    "q_stream_daily": f"WITH {S} SELECT day, pid, count(*) AS n, round(max(score), 9) AS best FROM s GROUP BY 1, 2",
    "q_source_messages": f"""WITH {MESSAGE} SELECT tid, orig_id, md5(full_text) AS text_md5, day, doc_id % 3 = 0 AS "Url", doc_id % 4 = 0 AS "Mention",
      {_LOG.format('(CASE WHEN again THEN doc_id * 3 ELSE n_chars END)')} AS followers, {_LOG.format('(CASE WHEN again THEN doc_id * 7 ELSE doc_id END)')} AS statuses,
      CASE WHEN again THEN doc_id % 1000 ELSE 0 END AS retweets, CASE WHEN again AND doc_id % 1000 > 0 THEN length(CAST(doc_id % 1000 AS VARCHAR)) ELSE 0 END AS level FROM full_m""",
    "q_source_language_lines": rf"""WITH {MESSAGE} SELECT tid, md5(regexp_replace(regexp_replace(own, '\t+|\n+', ' ', 'g'), '(https?:/*)[^ ]+|#|@', '', 'g')) AS text_md5 FROM m WHERE lang = 'en'""",
    "q_enriched_json": f"WITH {MESSAGE} SELECT tid, n_chars % 100 / 100 AS score, lang FROM m",
    "q_source_vectors": "SELECT CAST(vec_id AS VARCHAR) AS word, len(embedding) AS size, round(list_reduce(list_prepend(0.0::DOUBLE, CAST(embedding AS DOUBLE[])), lambda a, b: a + b), 6) AS total FROM embeddings",
    "q_source_training": rf"""WITH {MESSAGE}, {FEATURES.replace('FROM documents', 'FROM (SELECT doc_id, body AS text FROM m)')} SELECT quality AS "Importance", count(*) AS n, count(*) FILTER (m.doc_id % 3 = 0) AS url, count(*) FILTER (m.doc_id % 4 = 0) AS mention,
      CAST(sum("WordCount") AS BIGINT) AS words, round(sum({_LOG.format('(CASE WHEN again THEN m.doc_id * 7 ELSE m.doc_id END)').replace('round(', '(').replace(', 9)', ')')}), 6) AS statuses
      FROM labels JOIN m USING (doc_id) JOIN f USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1""",
    "q_source_corpus": r"SELECT lang, count(*) AS n, CAST(sum(length(regexp_replace(translate(text, chr(9), ' '), '[\r\n]+', ' ', 'g'))) AS BIGINT) AS chars FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY 1",
    "q_source_feature_counts": "SELECT coalesce(lang, 'none') AS ngram, count(*) AS n FROM documents GROUP BY 1",
    "q_label_lists": "SELECT lang, md5(string_agg(doc_id, ',' ORDER BY doc_id)) AS ids_md5, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1",
    "q_file_digest": f"""WITH {S}, r AS (SELECT *, round(score, 6) AS total, row_number() OVER (PARTITION BY day, pid ORDER BY round(score, 6) DESC, seq) AS rank FROM s)
      SELECT concat_ws(chr(9), day, 'MB' || (pid + 226), 'Q0', CAST(seq AS VARCHAR), CAST(rank AS VARCHAR), printf('%.6f', total), 'RUN') AS line FROM r WHERE rank <= 100""",
    "q_file_push_log": f"""WITH {THR}, p AS (SELECT s.*, concat_ws(chr(9), 'MB' || (s.pid + 226), CAST(seq AS VARCHAR), CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR), 'RUN') AS line FROM s JOIN thr ON thr.pid = s.pid
      WHERE round(score, 12) > threshold QUALIFY row_number() OVER (PARTITION BY s.pid, day ORDER BY seq) <= 10)
      SELECT line FROM p UNION ALL SELECT concat_ws(chr(9), line, '0.75', '0.5', day) FROM p""",
    "q_file_history_matrix": f"WITH {STATS} SELECT row_number() OVER (ORDER BY pid) - 1 AS at, CAST(sum(n_related) AS DOUBLE) AS total, count(*) AS days FROM st GROUP BY pid",
    "q_file_profiles": f"WITH {S} SELECT day, pid, count(*) AS n, round(sum(round(score, 6)), 6) AS total, count(*) AS n_lines FROM s WHERE score > 0.6 GROUP BY 1, 2",
    "q_filtered": f"""WITH {PROFILE}, {MESSAGE}, {FULL['gated']}, {PLAIN}, {TOKEN}, {MET},
      sc AS (SELECT met.doc_id, met.pid, sqrt(count(tok.word) / (SELECT count(*) FROM opts o WHERE o.pid = met.pid)) AS sim
        FROM met JOIN opts USING (pid) LEFT JOIN tok ON tok.doc_id = met.doc_id AND tok.word = opts.word GROUP BY met.doc_id, met.pid),
      top AS (SELECT doc_id, pid, sim / 2 + 0.5 AS similarity FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, pid) = 1),
      acc AS (SELECT tid, ms AS seq, day, pid, orig_id, md5(full_text) AS hash, (n_chars % 100 + 1) / 100 AS score, similarity * ((n_chars % 100 + 1) / 100) AS total FROM full_m JOIN top USING (doc_id) WHERE similarity * ((n_chars % 100 + 1) / 100) >= 0.15),
      fst AS (SELECT * FROM acc QUALIFY row_number() OVER (PARTITION BY hash ORDER BY seq) = 1),
      cand AS (SELECT * FROM fst WHERE round(score, 12) > 0.5 QUALIFY row_number() OVER (PARTITION BY orig_id ORDER BY seq) = 1),
      psh AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY pid, day ORDER BY seq) <= 10),
      rel AS (SELECT fst.* FROM fst LEFT JOIN psh USING (orig_id) WHERE psh.seq IS NULL OR fst.seq <= psh.seq)
      SELECT tid, pid, 'digest' AS kind, row_number() OVER (PARTITION BY day, pid ORDER BY total DESC, seq) AS rank FROM rel QUALIFY rank <= 100 UNION ALL SELECT tid, pid, 'push', 0 FROM psh""",
    "q_stream_engine": f"""WITH {S}, acc AS (SELECT *, orig_id || '-' || (seq % 3) AS hash FROM s WHERE score >= 0.15),
      fst AS (SELECT * FROM acc QUALIFY row_number() OVER (PARTITION BY day, hash ORDER BY seq) = 1),
      cand AS (SELECT * FROM fst WHERE round(score, 12) > 0.5 QUALIFY row_number() OVER (PARTITION BY day, orig_id ORDER BY seq) = 1),
      psh AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY pid, day ORDER BY seq) <= 10)
      SELECT fst.seq, 'related' AS kind FROM fst LEFT JOIN psh ON psh.orig_id = fst.orig_id AND psh.day = fst.day WHERE psh.seq IS NULL OR fst.seq <= psh.seq UNION ALL SELECT seq, 'pushed' FROM psh""",
}

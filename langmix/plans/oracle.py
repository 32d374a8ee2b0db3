"""DuckDB oracle SQL for the registered queries.

Each oracle re-derives its result from the raw driver views with plain SQL
(CTE fragments below are shared text, not a planner).  Rules and thresholds are
written out here, not imported from the operators that they check.
"""

from __future__ import annotations


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PUNCT = _q("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
# fixed values: the characters that Python's str.split() and str.strip() take as white space
SPACES = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
STRIP = " || ".join(f"chr({c})" for c in SPACES)
SPACE_RE = "'[" + "".join(f"\\x{{{c:04X}}}" for c in SPACES) + "]+'"
WORD_RE = "'[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]+'"
NL = "chr(10)"


def norm_sql(col: str) -> str:
    """T1 in DuckDB."""
    t = f"split_part({col}, {NL} || 'Q:', 1)"
    t = f"trim({t}, {STRIP})"
    t = f"translate({t}, {PUNCT}, '')"
    t = f"replace({t}, chr(8212), ' ')"
    return f"replace({t}, chr(1548), '')"


def trigram_text_sql(col: str) -> str:
    return f"' ' || trim(regexp_replace(lower({col}), '[^\\p{{L}}]+', ' ', 'g')) || ' '"


COMPLETIONS = f"""
comp AS (
  SELECT doc_id AS id, 'm' || CAST(doc_id % 4 AS VARCHAR) AS model,
         CASE WHEN doc_id % 2 = 0 THEN 'monolingual' ELSE 'crosslingual' END AS task,
         source, lang AS language, text AS completion
  FROM documents)"""

MODEL = f"""
tr_txt AS (SELECT lang, {trigram_text_sql('text')} AS t FROM documents WHERE lang IS NOT NULL),
tr_grams AS (SELECT lang, substring(t, i, 3) AS gram
             FROM (SELECT lang, t, unnest(generate_series(1, length(t) - 2)) AS i FROM tr_txt)),
tr_counts AS (SELECT lang, gram, count(*) AS cnt FROM tr_grams GROUP BY lang, gram),
profile AS (SELECT lang, gram, cnt, round(ln(1.0 + 1000000.0 * cnt / sum(cnt) OVER (PARTITION BY lang)), 6) AS weight
            FROM tr_counts),
n_langs AS (SELECT count(DISTINCT lang) AS nl FROM profile),
tr_words AS (SELECT lang, word, count(*) AS n
             FROM (SELECT lang, unnest(string_split(t, ' ')) AS word FROM tr_txt) WHERE word <> '' GROUP BY ALL),
votes AS (SELECT word, lang FROM (
            SELECT word, lang, row_number() OVER (PARTITION BY word ORDER BY share DESC, lang) AS rk
            FROM (SELECT lang, word, n / sum(n) OVER (PARTITION BY lang) AS share FROM tr_words)) WHERE rk = 1),
n_words AS (SELECT lang, unnest(regexp_extract_all(lower(text), {WORD_RE})) AS word
            FROM documents WHERE lang IS NOT NULL),
stopwords AS (
  SELECT lang, word FROM (
    SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS rk
    FROM n_words WHERE regexp_full_match(word, '\\p{{L}}+') GROUP BY lang, word)
  WHERE rk <= 30)"""


def detect_sql(units: str, name: str, mode: str = "cascade", threshold: float = 0.3,
               others: bool = False) -> str:
    """CTEs labelling the distinct ``unit`` column of CTE ``units`` into CTE ``name``."""
    p = f"{name}_"
    s = f"""
{p}u AS (SELECT DISTINCT unit FROM {units}),
{p}ut AS (SELECT unit, {trigram_text_sql('unit')} AS t FROM {p}u),
{p}ug AS (SELECT unit, gram, count(*) AS n
          FROM (SELECT unit, substring(t, i, 3) AS gram
                FROM (SELECT unit, t, unnest(generate_series(1, length(t) - 2)) AS i FROM {p}ut)) GROUP BY ALL),
{p}ps AS (SELECT unit, lang, round(sum(n * weight), 6) AS score
          FROM {p}ug JOIN profile USING (gram) GROUP BY unit, lang),
{p}ps2 AS (SELECT *, max(score) OVER (PARTITION BY unit) AS smax, count(*) OVER (PARTITION BY unit) AS k,
                  row_number() OVER (PARTITION BY unit ORDER BY score DESC, lang) AS rn FROM {p}ps),
{p}pb AS (SELECT unit, max(CASE WHEN rn = 1 THEN lang END) AS p_lang,
                 1.0 / (sum(exp(score - smax)) + ((SELECT nl FROM n_langs) - max(k)) * exp(-max(smax))) AS p_conf
          FROM {p}ps2 GROUP BY unit)"""
    if mode == "single":
        return s + f""",
{name} AS (SELECT u.unit, CASE WHEN pb.p_conf > {threshold} THEN pb.p_lang ELSE 'unknown' END AS pred_lang
           FROM {p}u u LEFT JOIN {p}pb pb USING (unit))"""
    sec = "(CASE WHEN sb.s_lang IN ('de', 'en') THEN sb.s_lang ELSE 'others' END)" if others else "sb.s_lang"
    return s + f""",
{p}uw AS (SELECT unit, word, count(*) AS n FROM (SELECT unit, unnest(string_split(t, ' ')) AS word FROM {p}ut)
          WHERE word <> '' GROUP BY ALL),
{p}sv AS (SELECT unit, lang, sum(n) AS v FROM {p}uw JOIN votes USING (word) GROUP BY unit, lang),
{p}sb AS (SELECT unit, max(CASE WHEN rn = 1 THEN lang END) AS s_lang,
                 max(CASE WHEN rn = 1 THEN v END) * 1.0 / sum(v) AS s_conf
          FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY v DESC, lang) AS rn FROM {p}sv)
          GROUP BY unit),
{name} AS (SELECT u.unit,
                  CASE WHEN pb.p_conf >= {threshold} THEN pb.p_lang
                       WHEN sb.s_conf >= {threshold} THEN {sec}
                       ELSE 'unknown' END AS pred_lang
           FROM {p}u u LEFT JOIN {p}pb pb USING (unit) LEFT JOIN {p}sb sb USING (unit))"""


DIST_LINES = f"""
ncomp AS (SELECT *, {norm_sql('completion')} AS norm FROM comp),
kl AS (SELECT *, list_filter(string_split(norm, {NL}), lambda x: length(x) > 5) AS kept FROM ncomp),
lines AS (SELECT id, model, task, source, language,
                 unnest(kept) AS line, unnest(generate_series(0, len(kept) - 1)) AS indice FROM kl),
line_units AS (SELECT line AS unit FROM lines)"""

LABELLED_LINES = DIST_LINES + "," + detect_sql("line_units", "line_lab") + """,
llines AS (SELECT l.*, coalesce(b.pred_lang, 'unknown') AS pred_lang
           FROM lines l LEFT JOIN line_lab b ON l.line = b.unit)"""

LABELLED_TOKENS = """
toks AS (SELECT id, model, task, source, language, indice, pred_lang,
                unnest(regexp_extract_all(line, """ + WORD_RE + """)) AS token FROM llines),
tok_units AS (SELECT token AS unit FROM toks)""" + "," + detect_sql("tok_units", "tok_lab") + """,
ltoks AS (SELECT t.*, coalesce(b.pred_lang, 'unknown') AS token_lang
          FROM toks t LEFT JOIN tok_lab b ON t.token = b.unit)"""

LINE_DIST = f"""
line_cnt AS (SELECT id, model, task, source, language, pred_lang AS lang, count(*) AS n
             FROM llines GROUP BY ALL),
line_dist AS (SELECT id, model, task, source, language, lang,
                     round(n / sum(n) OVER (PARTITION BY id, model, task, source, language), 2) AS p
              FROM line_cnt QUALIFY p > 0)"""

WORD_DIST = f"""
word_cnt AS (SELECT id, model, task, source, language, token_lang AS lang, count(*) AS n
             FROM ltoks WHERE pred_lang <> 'unknown' AND token_lang <> 'unknown' GROUP BY ALL),
word_dist AS (SELECT id, model, task, source, language, lang,
                     round(n / sum(n) OVER (PARTITION BY id, model, task, source, language), 2) AS p
              FROM word_cnt QUALIFY p > 0)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)


ORACLES: dict[str, str] = {}

ORACLES["lid_profile"] = with_(MODEL) + "\nSELECT lang, gram, CAST(cnt AS BIGINT) AS cnt, weight FROM profile"

ORACLES["lid_stopwords"] = with_(MODEL) + "\nSELECT lang, word FROM stopwords"

ORACLES["line_language"] = with_(COMPLETIONS, MODEL, LABELLED_LINES) + \
    "\nSELECT id, CAST(indice AS BIGINT) AS indice, pred_lang FROM llines"

ORACLES["line_language_strict"] = with_(
    COMPLETIONS, MODEL, DIST_LINES, detect_sql("line_units", "line_lab", threshold=0.6, others=True)) + """
SELECT l.id, CAST(l.indice AS BIGINT) AS indice, coalesce(b.pred_lang, 'unknown') AS pred_lang
FROM lines l LEFT JOIN line_lab b ON l.line = b.unit"""

PASS_LINES = f"""
pcomp AS (SELECT *, {norm_sql('completion')} AS norm FROM comp),
all_lines AS (SELECT id, model, task, source, language, unnest(ls) AS line,
                     unnest(generate_series(0, len(ls) - 1)) AS line_no
              FROM (SELECT *, string_split(norm, {NL}) AS ls FROM pcomp)),
plines AS (SELECT *, list_filter(regexp_split_to_array(trim(line, {STRIP}), {SPACE_RE}),
                                 lambda x: x <> '') AS tokens
           FROM all_lines),
pass_lines AS (SELECT * FROM plines WHERE len(tokens) >= 5),
pl_units AS (SELECT line AS unit FROM pass_lines)"""

ORACLES["line_language_single"] = with_(
    COMPLETIONS, MODEL, PASS_LINES, detect_sql("pl_units", "pl_lab", mode="single", threshold=0.3)) + """
SELECT l.id, CAST(l.line_no AS BIGINT) AS line_no, coalesce(b.pred_lang, 'unknown') AS pred_lang
FROM pass_lines l LEFT JOIN pl_lab b ON l.line = b.unit"""

ORACLES["tokens_by_language"] = with_(COMPLETIONS, MODEL, LABELLED_LINES, LABELLED_TOKENS) + """
SELECT id, token_lang AS lang, count(*) AS n_tokens FROM ltoks GROUP BY ALL"""

ORACLES["line_distribution"] = with_(COMPLETIONS, MODEL, LABELLED_LINES, LINE_DIST) + \
    "\nSELECT id, lang, p FROM line_dist"

ORACLES["word_distribution"] = with_(COMPLETIONS, MODEL, LABELLED_LINES, LABELLED_TOKENS, WORD_DIST) + \
    "\nSELECT id, lang, p FROM word_dist"

BOTH_DISTS = """
both_dist AS (SELECT 'line' AS level, * FROM line_dist UNION ALL SELECT 'word' AS level, * FROM word_dist)"""

ORACLES["entropy_by_group"] = with_(COMPLETIONS, MODEL, LABELLED_LINES, LABELLED_TOKENS, LINE_DIST, WORD_DIST,
                                    BOTH_DISTS) + """,
ent AS (SELECT level, id, model, task, source, language,
               sum(-(CASE WHEN lang = language THEN 1 - p ELSE p END) * ln(p)) AS h
        FROM both_dist GROUP BY ALL)
SELECT model, source, language, task,
       round(avg(CASE WHEN level = 'line' THEN h END), 6) AS line_reweighted_entropy,
       round(avg(CASE WHEN level = 'word' THEN h END), 6) AS word_reweighted_entropy
FROM ent GROUP BY ALL"""

# ------------------------------------------------- distributions, entropy --

_LD = with_(COMPLETIONS, MODEL, LABELLED_LINES, LINE_DIST)
_WD = with_(COMPLETIONS, MODEL, LABELLED_LINES, LABELLED_TOKENS, WORD_DIST)
_BD = with_(COMPLETIONS, MODEL, LABELLED_LINES, LABELLED_TOKENS, LINE_DIST, WORD_DIST, BOTH_DISTS)
def train_list(id_: str = "id") -> str:
    """Training languages of a completion's model."""
    return f"(CASE {id_} % 4 WHEN 0 THEN ['en'] WHEN 1 THEN ['de', 'en'] WHEN 2 THEN ['fr'] ELSE ['de', 'es', 'fr'] END)"


INSIDE = f"(lang = language OR list_contains({train_list()}, lang))"

ORACLES["pruned_distribution"] = _LD + f"""
SELECT id, lang, p FROM line_dist WHERE lang NOT IN ('unknown', 'others') AND p > 0.05"""

ORACLES["unknown_mass"] = _LD + f""",
pr AS (SELECT id, lang, p FROM line_dist WHERE lang NOT IN ('unknown', 'others') AND p > 0.05)
SELECT id, lang, p FROM pr
UNION ALL
SELECT doc_id AS id, 'unk' AS lang, round(1.0 - coalesce(sum(p), 0.0), 2) AS p FROM documents LEFT JOIN pr ON pr.id = doc_id
GROUP BY doc_id HAVING round(1.0 - coalesce(sum(p), 0.0), 2) > 0"""

ORACLES["widened_distribution"] = _LD + """,
w AS (SELECT id, coalesce(max(CASE WHEN lang = 'de' THEN p END), 0.0) AS de,
             coalesce(max(CASE WHEN lang = 'en' THEN p END), 0.0) AS en,
             coalesce(max(CASE WHEN lang = 'es' THEN p END), 0.0) AS es,
             coalesce(max(CASE WHEN lang = 'fr' THEN p END), 0.0) AS fr
      FROM (SELECT doc_id AS id, lang, p FROM documents d(doc_id, a, b, c, e) LEFT JOIN line_dist ON id = doc_id) GROUP BY id)
SELECT id, de, en, es, fr, round(1.0 - (((de + en) + es) + fr), 6) AS other FROM w"""

ORACLES["langset_frequency"] = _LD + """,
s AS (SELECT id, array_to_string(list_sort(list(DISTINCT lang)), '_') || '_' || language AS lang_set
      FROM line_dist GROUP BY id, model, task, source, language)
SELECT lang_set, count(*) AS n_units FROM s GROUP BY lang_set"""

ORACLES["multi_language_units"] = _LD + """
SELECT id, count(*) AS n_langs FROM line_dist GROUP BY id HAVING count(*) > 1"""

ORACLES["extra_languages"] = _WD + f""",
s AS (SELECT id, list_sort(list_filter(list(DISTINCT lang),
                                       lambda x: x <> any_value(language) AND NOT list_contains({train_list()}, x))) AS extra
      FROM word_dist GROUP BY id)
SELECT id, array_to_string(extra, '_') AS extra FROM s WHERE len(extra) > 0 AND NOT list_contains(extra, 'en')"""

ORACLES["lang_unit_ranking"] = _WD + """
SELECT lang, count(*) AS n_units FROM word_dist GROUP BY lang"""

ORACLES["off_target_by_task"] = _LD + f""",
off AS (SELECT lang, task, avg(p) AS mean_p FROM line_dist
        WHERE lang <> language AND NOT list_contains({train_list()}, lang) GROUP BY lang, task),
keep AS (SELECT lang FROM off GROUP BY lang HAVING min(mean_p) > 0.01 AND count(*) = 2)
SELECT lang, task, round(mean_p, 6) AS mean_p FROM off WHERE lang IN (SELECT lang FROM keep)"""

ORACLES["probability_pool"] = _WD + f"""
SELECT lang, count(*) AS n, round(avg(p), 6) AS mean_p, round(max(p), 6) AS max_p
FROM word_dist WHERE p >= 0.01 GROUP BY lang"""


def _shannon_sql(mask: str | None) -> str:
    p = "p" if mask is None else f"(CASE WHEN {mask} THEN p END)"
    return f"(CASE WHEN sum({p}) > 0 THEN ln(sum({p})) - sum({p} * ln({p})) / sum({p}) ELSE 0.0 END)"


ENTROPY_SQL = {
    "entropy_all": _shannon_sql(None),
    "entropy_out": _shannon_sql(f"NOT {INSIDE}"),
    "entropy_out_expected": _shannon_sql("lang <> language"),
    "reweighted_entropy": f"sum(-(CASE WHEN {INSIDE} THEN 1 - p ELSE p END) * ln(p))",
    "reweighted_entropy_expected": "sum(-(CASE WHEN lang = language THEN 1 - p ELSE p END) * ln(p))",
    "weighted_entropy": (f"(-(1.0 - coalesce(sum(CASE WHEN {INSIDE} THEN p END), 0.0))"
                         f" * coalesce(sum(CASE WHEN NOT {INSIDE} THEN ln(p) END), 0.0) + 0.0)"),
}


def ent_raw(*names: str) -> str:
    return ", ".join(f"{ENTROPY_SQL[n]} AS {n}" for n in names)


def ent_cols(*names: str) -> str:
    # "+ 0.0" turns DuckDB's -0.0 into 0.0 (Spark's decimal rounding never yields -0.0)
    return ", ".join(f"round({ENTROPY_SQL[n]}, 6) + 0.0 AS {n}" for n in names)


ORACLES["entropy_variants"] = _BD + f"""
SELECT level, id, {ent_cols(*ENTROPY_SQL)} FROM both_dist GROUP BY level, id"""

ORACLES["entropy_by_language_task"] = _LD + f""",
ent AS (SELECT id, task, language AS expected, {ent_raw('reweighted_entropy')} FROM line_dist GROUP BY ALL)
SELECT expected, task, round(avg(reweighted_entropy), 6) AS mean_reweighted_entropy FROM ent GROUP BY ALL"""

ORACLES["entropy_by_training_language"] = _WD + f""",
ent AS (SELECT id, {ent_raw('weighted_entropy')} FROM word_dist GROUP BY id)
SELECT 'set' AS kind, array_to_string(list_sort({train_list()}), '_') AS key,
       round(avg(weighted_entropy), 6) AS mean_weighted_entropy FROM ent GROUP BY 2
UNION ALL
SELECT 'single' AS kind, key, round(avg(weighted_entropy), 6) AS mean_weighted_entropy
FROM (SELECT weighted_entropy, unnest({train_list()}) AS key FROM ent) GROUP BY key"""

ORACLES["token_norm_entropy"] = with_(COMPLETIONS, MODEL, LABELLED_LINES, LABELLED_TOKENS) + """,
c AS (SELECT id, token_lang, count(*) AS v FROM ltoks GROUP BY ALL)
SELECT id, round(CASE WHEN sum(v) > 0 THEN log2(sum(v)) - sum(v * log2(v)) / sum(v) END, 6) AS norm_entropy
FROM c GROUP BY id"""

ORACLES["complete_levels"] = _BD + f""",
ent AS (SELECT level, id, any_value(language) AS language, {ent_cols('reweighted_entropy')}
        FROM both_dist GROUP BY level, id)
SELECT level, id, reweighted_entropy FROM ent
WHERE NOT list_contains({train_list()}, language) AND id IN (SELECT id FROM ent GROUP BY id HAVING count(*) = 2)"""

# --------------------------------------------------- pass rates, overlap ---

WS_RE = "'[ \\t\\n\\r\\f\\x0B]+'"


def ws_tokens_sql(col: str) -> str:
    return f"list_filter(regexp_split_to_array(trim({col}, {STRIP}), {WS_RE}), lambda x: x <> '')"


DICT = f"""
dict AS (SELECT DISTINCT word FROM (SELECT unnest({ws_tokens_sql(norm_sql('text'))}) AS word FROM benchmark)
         WHERE word = lower(word) AND regexp_full_match(word, '[a-z]+') AND length(word) > 3)"""

ORACLES["english_dictionary"] = with_(DICT) + "\nSELECT word FROM dict"

CHECKS = PASS_LINES + "," + detect_sql("pl_units", "pl_lab", mode="single", threshold=0.3) + "," + DICT + """,
llab AS (SELECT l.*, coalesce(b.pred_lang, 'unknown') AS pred_lang FROM pass_lines l LEFT JOIN pl_lab b ON l.line = b.unit),
stats AS (SELECT id, model, task, source, language, count(*) AS n_lines, count_if(pred_lang <> language) AS n_err
          FROM llab GROUP BY ALL),
hits AS (SELECT DISTINCT id FROM (SELECT id, unnest(tokens) AS word FROM llab) WHERE word IN (SELECT word FROM dict)),
checks AS (
  SELECT c.id, c.model, c.task, c.source, c.language,
         CAST(coalesce(s.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(s.n_err, 0) AS BIGINT) AS n_err,
         coalesce(s.n_err, 0) > 0 AS line_error,
         (coalesce(s.n_err, 0) = 0 AND coalesce(s.n_lines, 0) > 0 AND h.id IS NOT NULL) AS word_error
  FROM comp c LEFT JOIN stats s USING (id, model, task, source, language) LEFT JOIN hits h USING (id))"""

ORACLES["completion_checks"] = with_(COMPLETIONS, MODEL, CHECKS) + "\nSELECT * FROM checks"

RATES = """
rates AS (
  SELECT task, model, source, language,
         coalesce(avg(CASE WHEN n_lines > 0 THEN 1.0 - n_err / n_lines END), 1.0) AS acc,
         1.0 - count_if(line_error) / greatest(1, count_if(n_lines > 0)) AS lpr,
         CASE WHEN language IN ('de', 'es', 'fr')
              THEN 1.0 - count_if(word_error) / greatest(1, count_if(n_lines > 0) - count_if(line_error)) END AS wpr
  FROM checks GROUP BY task, model, source, language),
per_lang AS (SELECT task, model, language, avg(acc) AS acc, avg(lpr) AS lpr, avg(wpr) AS wpr FROM rates GROUP BY ALL),
rolled AS (
  SELECT task, model, source, language, round(acc, 6) AS acc, round(lpr, 6) AS lpr, round(wpr, 6) AS wpr FROM rates
  UNION ALL
  SELECT task, model, source, 'all', round(avg(acc), 6), round(avg(lpr), 6), round(avg(wpr), 6) FROM rates GROUP BY ALL
  UNION ALL
  SELECT task, model, 'all', language, round(acc, 6), round(lpr, 6), round(wpr, 6) FROM per_lang
  UNION ALL
  SELECT task, model, 'all', 'all', round(avg(acc), 6), round(avg(lpr), 6), round(avg(wpr), 6) FROM per_lang GROUP BY ALL)"""

ORACLES["line_pass_rate"] = with_(COMPLETIONS, MODEL, CHECKS, RATES) + "\nSELECT * FROM rolled"

ORACLES["pass_rate_report"] = with_(COMPLETIONS, MODEL, CHECKS, RATES) + """
SELECT model, language, round(avg(lpr) * 100, 6) AS lpr_pct FROM rolled
WHERE source = 'all' AND language <> 'all' AND lpr IS NOT NULL GROUP BY ALL"""

PAIRS = """
lu AS (SELECT conv_id, turn, role, text,
              last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)
                OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS input_text
       FROM conversations),
pairs AS (SELECT conv_id, turn, input_text, text AS output_text FROM lu
          WHERE role = 'assistant' AND input_text IS NOT NULL)"""

ORACLES["reply_pairs"] = with_(PAIRS) + "\nSELECT * FROM pairs"


def prompt_sql(src: str) -> str:
    return f"""
SELECT conv_id,
       trim(string_agg(CASE WHEN role = 'user' THEN 'Q: ' || text || chr(10)
                            WHEN role = 'assistant' THEN 'A: ' || text || chr(10) || chr(10)
                            ELSE '' END, '' ORDER BY turn)
            || CASE WHEN arg_max(role, turn) = 'user' THEN 'A:' ELSE '' END, chr(10)) AS prompt
FROM {src} GROUP BY conv_id"""


ORACLES["turn_prompts"] = prompt_sql("conversations")

ORACLES["few_shot_prompts"] = """WITH d AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos
  FROM conversations WHERE role IN ('user', 'assistant')),
sel AS (SELECT * FROM d WHERE pos <= 3),
shots AS (""" + prompt_sql("sel") + """)
SELECT s.*, EXISTS (SELECT 1 FROM d WHERE d.conv_id = s.conv_id AND pos = 3 AND role = 'user') AS has_question FROM shots s"""

PAIR_SCORES = PAIRS + f""",
pt AS (SELECT conv_id, turn, regexp_extract_all(input_text, {WORD_RE}) AS rt,
              regexp_extract_all(output_text, {WORD_RE}) AS pt FROM pairs),
sc AS (SELECT conv_id, turn, len(list_intersect(list_distinct(rt), list_distinct(pt))) AS tp,
              len(list_distinct(rt)) AS nr, len(list_distinct(pt)) AS np, len(rt) AS num_true_words,
              len(pt) AS num_pred_words FROM pt),
sc2 AS (SELECT *, tp / (nr + 1e-20) AS precision, tp / (np + 1e-20) AS recall FROM sc),
sc3 AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-20) AS f1 FROM sc2),
grams AS (
  SELECT conv_id, turn, n, side, array_to_string(list_slice(toks, i, i + n - 1), ' ') AS gram
  FROM (SELECT conv_id, turn, n, side, toks, unnest(generate_series(1, len(toks) - n + 1)) AS i
        FROM (SELECT conv_id, turn, 'ref' AS side, rt AS toks FROM pt UNION ALL
              SELECT conv_id, turn, 'pred' AS side, pt AS toks FROM pt),
             (SELECT unnest([1, 2, 3]) AS n) ns)),
gc AS (SELECT conv_id, turn, n, gram, count_if(side = 'ref') AS a, count_if(side = 'pred') AS b
       FROM grams GROUP BY ALL),
gm AS (SELECT conv_id, turn, n, sum(least(a, b)) AS m FROM gc GROUP BY ALL),
scores AS (
  SELECT s.*, CAST(coalesce(g1.m, 0) AS BIGINT) AS n_ngrams_match_1, CAST(coalesce(g2.m, 0) AS BIGINT) AS n_ngrams_match_2,
         CAST(coalesce(g3.m, 0) AS BIGINT) AS n_ngrams_match_3
  FROM sc3 s LEFT JOIN gm g1 ON s.conv_id = g1.conv_id AND s.turn = g1.turn AND g1.n = 1
             LEFT JOIN gm g2 ON s.conv_id = g2.conv_id AND s.turn = g2.turn AND g2.n = 2
             LEFT JOIN gm g3 ON s.conv_id = g3.conv_id AND s.turn = g3.turn AND g3.n = 3)"""

ORACLES["token_overlap_pairs"] = with_(PAIR_SCORES) + """
SELECT conv_id, turn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(num_true_words AS BIGINT) AS num_true_words, CAST(num_pred_words AS BIGINT) AS num_pred_words,
       n_ngrams_match_1, n_ngrams_match_2, n_ngrams_match_3 FROM scores"""

ORACLES["token_overlap"] = with_(PAIR_SCORES) + """
SELECT round(avg(precision), 6) AS token_set_precision, round(avg(recall), 6) AS token_set_recall,
       round(avg(f1), 6) AS token_set_f1, round(stddev_samp(f1) / sqrt(count(*)), 6) AS token_set_f1_sem,
       round(avg(n_ngrams_match_1), 6) AS n_ngrams_match_1, round(avg(n_ngrams_match_2), 6) AS n_ngrams_match_2,
       round(avg(n_ngrams_match_3), 6) AS n_ngrams_match_3, round(avg(num_true_words), 6) AS num_true_words,
       round(avg(num_pred_words), 6) AS num_pred_words, count(*) AS n_pairs FROM scores"""

# -------------------------------------------- confusion, divergence, graphs --

CONF = """
conf0 AS (SELECT lang AS "row", language AS col,
                 avg(-(CASE WHEN lang = language OR lang = 'en' THEN 1 - p ELSE p END) * ln(p)) AS value
          FROM line_dist GROUP BY lang, language),
conf1 AS (SELECT * FROM conf0 WHERE "row" NOT IN ('unknown', 'unk') AND col NOT IN ('unknown', 'unk')),
conf AS (SELECT "row", col, value FROM (
           SELECT *, max(CASE WHEN value <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY "row") AS r_nz,
                     max(CASE WHEN value <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY col) AS c_nz FROM conf1)
         WHERE r_nz = 1 AND c_nz = 1)"""

_CONF = with_(COMPLETIONS, MODEL, LABELLED_LINES, LINE_DIST, CONF)

ORACLES["confusion_matrix"] = _CONF + '\nSELECT "row", col, round(value, 6) + 0.0 AS value FROM conf'


def jaccard_sql(inc: str, name: str) -> str:
    return f"""
{name}_sz AS (SELECT node, count(*) AS n FROM {inc} GROUP BY node),
{name}_int AS (SELECT x.node AS a, y.node AS b, count(*) AS w FROM {inc} x JOIN {inc} y
               ON x.concept = y.concept AND x.node < y.node GROUP BY ALL),
{name}_d AS (SELECT a, b, 1.0 - w / (sa.n + sb.n - w) AS value
             FROM {name}_int JOIN {name}_sz sa ON sa.node = a JOIN {name}_sz sb ON sb.node = b),
{name} AS (SELECT x.node AS "row", y.node AS col,
                  CASE WHEN x.node = y.node THEN 0.0 ELSE coalesce(d.value, 1.0) END AS value
           FROM {name}_sz x CROSS JOIN {name}_sz y
           LEFT JOIN {name}_d d ON d.a = least(x.node, y.node) AND d.b = greatest(x.node, y.node) AND x.node <> y.node)"""


TOKEN_INC = f"""
tinc0 AS (SELECT DISTINCT lang AS node, tok AS concept
          FROM (SELECT lang, unnest(regexp_extract_all(lower(text), {WORD_RE})) AS tok FROM documents)
          WHERE regexp_full_match(tok, '\\p{{L}}+')),
tinc AS (SELECT * FROM tinc0 WHERE node IN (SELECT node FROM tinc0 GROUP BY node HAVING count(*) >= 3))"""

ORACLES["language_similarity"] = with_(TOKEN_INC, jaccard_sql("tinc", "jac")) + \
    '\nSELECT "row", col, round(value, 6) AS value FROM jac'

SIMS = """
pc AS (SELECT a.lang AS "row", b.lang AS col, sum(a.weight * b.weight) AS dot FROM profile a JOIN profile b USING (gram)
       GROUP BY ALL),
pnrm AS (SELECT lang, sqrt(sum(weight * weight)) AS nrm FROM profile GROUP BY lang),
cosm AS (SELECT "row", col, (dot / (na.nrm * nb.nrm) + 1) / 2 AS value
         FROM pc JOIN pnrm na ON na.lang = "row" JOIN pnrm nb ON nb.lang = col),
sims AS (SELECT 'token_jaccard' AS sim_name, "row", col, 1.0 - value AS value FROM jac
         UNION ALL SELECT 'trigram_cosine', "row", col, value FROM cosm),
pall AS (SELECT s.sim_name, c."row", c.col, c.value FROM conf c,
         (SELECT unnest(['token_jaccard', 'trigram_cosine']) AS sim_name) s),
rws AS (SELECT DISTINCT sim_name, "row" FROM pall INTERSECT SELECT DISTINCT sim_name, "row" FROM sims),
cls AS (SELECT DISTINCT sim_name, col FROM pall INTERSECT SELECT DISTINCT sim_name, col FROM sims),
pa AS (SELECT * FROM pall SEMI JOIN rws USING (sim_name, "row") SEMI JOIN cls USING (sim_name, col)),
qa AS (SELECT * FROM sims SEMI JOIN rws USING (sim_name, "row") SEMI JOIN cls USING (sim_name, col)),
kj AS (SELECT p.sim_name, p."row", p.col, p.value AS pv, coalesce(q.value, 0.0) AS qv
       FROM pa p LEFT JOIN qa q USING (sim_name, "row", col) WHERE p.value <> 0),
kn AS (SELECT sim_name, col, pv / sum(pv) OVER w + 1e-10 AS pn,
              CASE WHEN sum(qv) OVER w = 0 THEN NULL ELSE qv / sum(qv) OVER w END + 1e-10 AS qn
       FROM kj WINDOW w AS (PARTITION BY sim_name, col)),
klc AS (SELECT sim_name, col, sum(pn * ln(pn / qn)) AS kl FROM kn GROUP BY ALL)"""

_KL = with_(COMPLETIONS, MODEL, LABELLED_LINES, LINE_DIST, CONF, TOKEN_INC, jaccard_sql("tinc", "jac"), SIMS)

ORACLES["confusion_kl"] = _KL + "\nSELECT sim_name, col, round(kl, 6) AS kl FROM klc"

ORACLES["confusion_kl_summary"] = _KL + """,
km AS (SELECT sim_name, avg(CASE WHEN isfinite(kl) THEN kl END) AS kl_mean FROM klc GROUP BY ALL),
fj AS (SELECT coalesce(p.sim_name, q.sim_name) AS sim_name, coalesce(p."row", q."row") AS "row",
              coalesce(p.col, q.col) AS col, p.value AS av, q.value AS bv
       FROM pa p FULL JOIN qa q ON p.sim_name = q.sim_name AND p."row" = q."row" AND p.col = q.col),
kw AS (SELECT sim_name, sum(pn * ln(pn / qn)) AS kl_whole FROM (
         SELECT sim_name,
                CASE WHEN sum(coalesce(av, 0.0)) OVER w = 0 THEN NULL ELSE coalesce(av, 0.0) / sum(coalesce(av, 0.0)) OVER w END + 1e-10 AS pn,
                CASE WHEN sum(coalesce(bv, 0.0)) OVER w = 0 THEN NULL ELSE coalesce(bv, 0.0) / sum(coalesce(bv, 0.0)) OVER w END + 1e-10 AS qn
         FROM fj WINDOW w AS (PARTITION BY sim_name)) GROUP BY ALL),
ke AS (SELECT sim_name, sqrt(count(DISTINCT "row") * count(DISTINCT col) / count_if(av IS NOT NULL AND bv IS NOT NULL)
                             * sum(CASE WHEN av IS NOT NULL AND bv IS NOT NULL THEN pow(av - bv, 2) END)) AS nan_euclidean
       FROM fj GROUP BY ALL)
SELECT sim_name, round(kl_mean, 6) AS kl_mean, round(kl_whole, 6) AS kl_whole, round(nan_euclidean, 6) AS nan_euclidean
FROM km JOIN kw USING (sim_name) JOIN ke USING (sim_name)"""

ORACLES["confusion_row_mean"] = _CONF + """
SELECT "row", round(avg(value), 6) AS robust_mean FROM (
  SELECT *, max(value) OVER (PARTITION BY "row") AS mx FROM conf WHERE value IS NOT NULL AND NOT isnan(value))
WHERE value < mx GROUP BY "row\""""

ORACLES["top_confusions"] = _CONF + """
SELECT col, "row", round(value, 6) AS value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY col ORDER BY value DESC, "row") AS rank FROM conf WHERE value > 0)
WHERE rank <= 20"""

NATION_PARTS = """
np_rows AS (SELECT n.n_name AS node, l.l_partkey AS concept FROM lineitem l
            JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey),
ninc AS (SELECT DISTINCT node, concept FROM np_rows),
nedges AS (SELECT x.node AS a, y.node AS b, count(*) AS weight FROM ninc x JOIN ninc y
           ON x.concept = y.concept AND x.node < y.node GROUP BY ALL),
ndeg AS (SELECT node, count(*) AS degree FROM np_rows GROUP BY node)"""

ORACLES["cooccurrence_pmi"] = with_(NATION_PARTS) + """,
kept AS (SELECT * FROM ndeg WHERE degree >= 3),
e AS (SELECT e.a, e.b, e.weight, log2(e.weight * (SELECT sum(degree) FROM kept)) - log2(ka.degree * kb.degree) AS pmi
      FROM nedges e JOIN kept ka ON ka.node = e.a JOIN kept kb ON kb.node = e.b)
SELECT a, b, CAST(weight AS BIGINT) AS weight, round(pmi, 6) AS pmi,
       round((pmi - min(pmi) OVER ()) / nullif(max(pmi) OVER () - min(pmi) OVER (), 0), 6) AS pmi_norm FROM e"""

ORACLES["degree_quantiles"] = with_(NATION_PARTS) + """
SELECT round(quantile_cont(degree, 0.25), 6) AS q, CAST(max(degree) AS BIGINT) AS max_degree FROM ndeg"""

ORACLES["jaccard_distance"] = with_(NATION_PARTS) + """,
ninc3 AS (SELECT * FROM ninc WHERE node IN (SELECT node FROM ninc GROUP BY node HAVING count(*) >= 3)),""" + \
    jaccard_sql("ninc3", "njac") + '\nSELECT "row", col, round(value, 6) AS value FROM njac'

ORACLES["embedding_cosine"] = """WITH ex AS (
  SELECT label, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS dim FROM embeddings),
cent AS (SELECT label AS node, dim, avg(CAST(x AS DOUBLE)) AS x FROM ex GROUP BY ALL),
dots AS (SELECT a.node AS "row", b.node AS col, sum(a.x * b.x) AS dot FROM cent a JOIN cent b USING (dim) GROUP BY ALL),
nrm AS (SELECT node, sqrt(sum(x * x)) AS n FROM cent GROUP BY node)
SELECT "row", col, round((dot / (na.n * nb.n) + 1) / 2, 6) AS value
FROM dots JOIN nrm na ON na.node = "row" JOIN nrm nb ON nb.node = col"""

ORACLES["nation_feature_distance"] = """WITH f AS (
  SELECT n.n_name AS node, c.c_mktsegment AS feature,
         avg(c.c_acctbal) AS value
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name, c.c_mktsegment),
g AS (SELECT a.node AS "row", b.node AS col, count(*) AS np, sum(pow(a.value - b.value, 2)) AS ss
      FROM f a JOIN f b ON a.feature = b.feature WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL)
SELECT x.n_name AS "row", y.n_name AS col,
       round(coalesce(sqrt((SELECT count(DISTINCT c_mktsegment) FROM customer) / np * ss), 0.0), 6) AS value
FROM nation x CROSS JOIN nation y LEFT JOIN g ON g."row" = x.n_name AND g.col = y.n_name"""

ORACLES["regional_subgraph"] = with_(NATION_PARTS) + """
SELECT a, b, CAST(weight AS BIGINT) AS weight FROM nedges
WHERE a IN (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')
  AND b IN (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')"""

# ------------------------------------------------- statistics, typology ----

_M = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_M) for b in _M[i + 1:]]

ORACLES["pearson_lineitem"] = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0), 6) AS r "
    f"FROM lineitem" for a, b in _PAIRS)

ORACLES["spearman_lineitem"] = "WITH rk AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in _M) + \
    " FROM lineitem WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _M) + ") " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr(r_{a}, r_{b}), 6) AS r FROM rk" for a, b in _PAIRS)

_COND = """m AS (SELECT CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS quantity,
       CASE WHEN l_linestatus = 'O' THEN l_discount END AS discount,
       CASE WHEN l_returnflag <> 'A' THEN l_tax END AS tax, l_extendedprice AS price FROM lineitem)"""
_CPAIRS = [("quantity", "discount"), ("quantity", "tax"), ("quantity", "price"), ("discount", "tax"), ("discount", "price"), ("tax", "price")]
ORACLES["pearson_conditional"] = "WITH " + _COND + " UNION ALL ".join(
    f" SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM m" for a, b in _CPAIRS)
ORACLES["spearman_conditional"] = "WITH " + _COND + "".join(
    f", k{i} AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in (a, b)) +
    f" FROM m WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for i, (a, b) in enumerate(_CPAIRS)) + " UNION ALL ".join(
    f" SELECT '{a}' AS a, '{b}' AS b, round(corr(r_{a}, r_{b}), 6) AS r FROM k{i}" for i, (a, b) in enumerate(_CPAIRS))

ORACLES["describe_lineitem"] = " UNION ALL ".join(
    f"SELECT '{c}' AS measure, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"round(min({c}), 6) AS min, round(max({c}), 6) AS max FROM lineitem" for c in _M)

ORACLES["quantity_box_summary"] = """
SELECT l_returnflag, l_linestatus,
       round(quantile_cont(l_quantity, 0.05), 6) AS p05, round(quantile_cont(l_quantity, 0.25), 6) AS p25,
       round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.75), 6) AS p75,
       round(quantile_cont(l_quantity, 0.95), 6) AS p95
FROM lineitem GROUP BY ALL"""

ORACLES["price_histogram"] = """WITH st AS (SELECT min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM lineitem),
b AS (SELECT CAST(least(floor((l_extendedprice - mn) / ((mx - mn) / 5)), 4) AS INTEGER) AS bin, mn, mx
      FROM lineitem, st WHERE l_extendedprice IS NOT NULL)
SELECT bin, round(any_value(mn) + bin * ((any_value(mx) - any_value(mn)) / 5), 6) AS lo,
       round(any_value(mn) + (bin + 1) * ((any_value(mx) - any_value(mn)) / 5), 6) AS hi, count(*) AS n
FROM b GROUP BY bin"""

ORACLES["entropy_pass_rates"] = with_(COMPLETIONS, MODEL, LABELLED_LINES, LABELLED_TOKENS, LINE_DIST, WORD_DIST,
                                      BOTH_DISTS, CHECKS, RATES) + """,
ent AS (SELECT level, id, model, task, source, language,
               sum(-(CASE WHEN lang = language THEN 1 - p ELSE p END) * ln(p)) AS h
        FROM both_dist GROUP BY ALL),
eg AS (SELECT model, source, language, task,
              round(avg(CASE WHEN level = 'line' THEN h END), 6) AS line_reweighted_entropy,
              round(avg(CASE WHEN level = 'word' THEN h END), 6) AS word_reweighted_entropy
       FROM ent GROUP BY ALL)
SELECT eg.*, round(r.acc, 6) AS acc, round(r.lpr, 6) AS lpr, round(r.wpr, 6) AS wpr
FROM eg LEFT JOIN rates r USING (model, source, language, task)"""

TYPOLOGY = """
tx0 AS (SELECT n.n_nationkey, n.n_name, c.c_mktsegment, o.o_orderpriority, count(*) AS k
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
        GROUP BY ALL),
tx1 AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey, c_mktsegment ORDER BY k DESC, o_orderpriority) AS rk FROM tx0),
typ AS (SELECT n.n_name AS node, n.n_nationkey, g.s AS feature, t.o_orderpriority AS value
        FROM nation n CROSS JOIN (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_mktsegment IS NOT NULL) g
        LEFT JOIN (SELECT * FROM tx1 WHERE rk = 1) t ON t.n_nationkey = n.n_nationkey AND t.c_mktsegment = g.s),
codes AS (SELECT feature, value, dense_rank() OVER (PARTITION BY feature ORDER BY min(n_nationkey), value) - 1 AS code
          FROM typ WHERE value IS NOT NULL GROUP BY feature, value),
typc AS (SELECT t.*, c.code FROM typ t LEFT JOIN codes c USING (feature, value))"""

ORACLES["typology_codes"] = with_(TYPOLOGY) + """,
t2 AS (SELECT * FROM typc WHERE node IN (SELECT node FROM typc GROUP BY node HAVING count(value) >= 0.25 * 5)),
t3 AS (SELECT * FROM t2 WHERE feature IN (SELECT feature FROM t2 GROUP BY feature
                                          HAVING count(value) >= 0.75 * (SELECT count(DISTINCT node) FROM t2)))
SELECT node, feature, value, CAST(code AS INTEGER) AS code FROM t3"""

ORACLES["typology_pair_match"] = with_(TYPOLOGY) + """,
pm AS (SELECT x.node AS a, y.node AS b, x.feature,
              CASE WHEN x.code IS NULL OR y.code IS NULL THEN -1 WHEN x.code = y.code THEN 1 ELSE 0 END AS match
       FROM typc x JOIN typc y ON x.feature = y.feature AND x.node < y.node)
SELECT a, b, feature, CAST(match AS INTEGER) AS match FROM pm
WHERE (a, b) IN (SELECT (a, b) FROM pm GROUP BY a, b HAVING max(match) > -1)"""

ORACLES["priority_label_codes"] = """
SELECT o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL)"""

ORACLES["incremental_line_distribution"] = ORACLES["line_distribution"]
ORACLES["matrix_csv_roundtrip"] = ORACLES["confusion_matrix"]

# ---------------------------------------------------- more matrix variants --

ORACLES["confusion_matrix_training"] = ORACLES["confusion_matrix"].replace(
    "WHEN lang = language OR lang = 'en' THEN", f"WHEN lang = language OR list_contains({train_list()}, lang) THEN")

ORACLES["confusion_by_training"] = with_(COMPLETIONS, MODEL, LABELLED_LINES, LINE_DIST) + f""",
tr AS (SELECT *, unnest({train_list()}) AS train FROM line_dist)
SELECT lang AS "row", train AS col,
       round(avg(-(CASE WHEN lang = language OR list_contains({train_list()}, lang) THEN 1 - p ELSE p END) * ln(p)), 6) + 0.0 AS value
FROM tr WHERE lang NOT IN ('unknown', 'unk') AND train NOT IN ('unknown', 'unk')
GROUP BY lang, train"""

ORACLES["confusion_norm_entropy"] = with_(COMPLETIONS, MODEL, LABELLED_LINES, LINE_DIST) + """,
cells AS (SELECT lang AS "row", language AS col,
                 round(CASE WHEN sum(p) > 0 THEN log2(sum(p)) - sum(CASE WHEN p > 0 THEN p * log2(p) END) / sum(p) END, 6)
                   AS norm_entropy
          FROM line_dist GROUP BY lang, language),
fr AS (SELECT "row" FROM cells GROUP BY "row" HAVING count(*) = (SELECT count(DISTINCT col) FROM cells)),
fc AS (SELECT col FROM cells GROUP BY col HAVING count(*) = (SELECT count(DISTINCT "row") FROM cells))
SELECT * FROM cells WHERE "row" IN (SELECT "row" FROM fr) AND col IN (SELECT col FROM fc)"""


def _iso_case(c: str) -> str:
    from langmix.plans.queries import HARMONISE, ISO3
    whens = " ".join(f"WHEN {c} = {_q(a)} THEN {_q(b)}" for a, b, _ in ISO3) + " " + \
        " ".join(f"WHEN {c} = {_q(a)} THEN {_q(b)}" for a, b in HARMONISE)
    return f"(CASE {whens} ELSE {c} END)"


def _name_case(c: str) -> str:
    from langmix.plans.queries import ISO3
    return "(CASE " + " ".join(f"WHEN {c} = {_q(b)} THEN {_q(n)}" for _, b, n in ISO3) + " END)"


ORACLES["confusion_matrix_iso3"] = _CONF + f""",
r AS (SELECT {_iso_case('"row"')} AS "row", {_iso_case('col')} AS col, value FROM conf)
SELECT "row", col, {_name_case('"row"')} AS row_name, {_name_case('col')} AS col_name, round(value, 6) + 0.0 AS value FROM r"""

ORACLES["pmi_matrix"] = with_(NATION_PARTS) + """,
kept AS (SELECT * FROM ndeg WHERE degree >= 3),
e AS (SELECT e.a, e.b, round(log2(e.weight * (SELECT sum(degree) FROM kept)) - log2(ka.degree * kb.degree), 6) AS value
      FROM nedges e JOIN kept ka ON ka.node = e.a JOIN kept kb ON kb.node = e.b)
SELECT a AS "row", b AS col, value FROM e UNION SELECT b AS "row", a AS col, value FROM e"""


def _seg_sql() -> str:
    return with_(TYPOLOGY) + """,
w AS (SELECT node, """ + ", ".join(
        f"max(CASE WHEN feature = '{s}' AND value IS NOT NULL THEN 1 ELSE 0 END) AS {s.lower()}"
        for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + """ FROM typ GROUP BY node)
SELECT * FROM w"""


ORACLES["typology_pair_match_known"] = with_(TYPOLOGY) + """
SELECT x.node AS a, y.node AS b, x.feature, CAST(CASE WHEN x.code = y.code THEN 1 ELSE 0 END AS INTEGER) AS match
FROM typc x JOIN typc y ON x.feature = y.feature AND x.node < y.node
WHERE x.code IS NOT NULL AND y.code IS NOT NULL"""

ORACLES["merged_distribution"] = _BD + """,
fv AS (SELECT id, lang, arg_min(p, level) AS p FROM both_dist GROUP BY id, lang)
SELECT id, lang, round(p, 6) AS p FROM fv
UNION ALL
SELECT id, 'unk' AS lang, round(round(1.0 - sum(p), 2), 6) AS p FROM fv GROUP BY id HAVING round(1.0 - sum(p), 2) > 0"""

ORACLES["segment_multi_hot"] = _seg_sql()

ORACLES["kl_side_by_side"] = with_(COMPLETIONS, MODEL, LABELLED_LINES, LABELLED_TOKENS, LINE_DIST, WORD_DIST,
                                   BOTH_DISTS, TOKEN_INC, jaccard_sql("tinc", "jac")) + f""",
bs AS (SELECT b.*, s.setting FROM both_dist b,
       (SELECT unnest(['all', 'mono', 'cross']) AS setting) s
       WHERE s.setting = 'all' OR s.setting = CASE WHEN list_contains({train_list("b.id")}, b.language) THEN 'mono' ELSE 'cross' END),
cf AS (SELECT level, setting, lang AS "row", language AS col,
              avg(-(CASE WHEN lang = language OR lang = 'en' THEN 1 - p ELSE p END) * ln(p)) AS value
       FROM bs WHERE lang NOT IN ('unknown', 'unk') AND language NOT IN ('unknown', 'unk')
       GROUP BY level, setting, lang, language),
pc AS (SELECT a.lang AS "row", b.lang AS col, sum(a.weight * b.weight) AS dot FROM profile a JOIN profile b USING (gram)
       GROUP BY ALL),
pnrm AS (SELECT lang, sqrt(sum(weight * weight)) AS nrm FROM profile GROUP BY lang),
cosm AS (SELECT "row", col, (dot / (na.nrm * nb.nrm) + 1) / 2 AS value
         FROM pc JOIN pnrm na ON na.lang = "row" JOIN pnrm nb ON nb.lang = col),
sims0 AS (SELECT 'token_jaccard' AS sim_name, "row", col, 1.0 - value AS value FROM jac
          UNION ALL SELECT 'trigram_cosine', "row", col, value FROM cosm),
keys AS (SELECT l.level, s.setting FROM (SELECT unnest(['line', 'word']) AS level) l,
                                       (SELECT unnest(['all', 'mono', 'cross']) AS setting) s),
sims AS (SELECT k.level, k.setting, s.* FROM sims0 s, keys k),
pall AS (SELECT c.*, n.sim_name FROM cf c, (SELECT unnest(['token_jaccard', 'trigram_cosine']) AS sim_name) n),
rws AS (SELECT DISTINCT level, setting, sim_name, "row" FROM pall INTERSECT
        SELECT DISTINCT level, setting, sim_name, "row" FROM sims),
cls AS (SELECT DISTINCT level, setting, sim_name, col FROM pall INTERSECT
        SELECT DISTINCT level, setting, sim_name, col FROM sims),
pa AS (SELECT * FROM pall SEMI JOIN rws USING (level, setting, sim_name, "row") SEMI JOIN cls USING (level, setting, sim_name, col)),
qa AS (SELECT * FROM sims SEMI JOIN rws USING (level, setting, sim_name, "row") SEMI JOIN cls USING (level, setting, sim_name, col)),
kj AS (SELECT p.level, p.setting, p.sim_name, p.col, p.value AS pv, coalesce(q.value, 0.0) AS qv
       FROM pa p LEFT JOIN qa q USING (level, setting, sim_name, "row", col) WHERE p.value <> 0),
kn AS (SELECT level, setting, sim_name, col, pv / sum(pv) OVER w + 1e-10 AS pn,
              CASE WHEN sum(qv) OVER w = 0 THEN NULL ELSE qv / sum(qv) OVER w END + 1e-10 AS qn
       FROM kj WINDOW w AS (PARTITION BY level, setting, sim_name, col)),
klc AS (SELECT level, setting, sim_name, col, sum(pn * ln(pn / qn)) AS kl FROM kn GROUP BY ALL),
km AS (SELECT level || '_' || setting AS name, sim_name, avg(CASE WHEN isfinite(kl) THEN kl END) AS kl_mean
       FROM klc GROUP BY ALL)
SELECT split_part(sim_name, '_', 1) AS kind, split_part(sim_name, '_', 2) AS measure, """ + ", ".join(
    f"round(max(CASE WHEN name = '{n}' THEN kl_mean END), 6) AS {n}"
    for n in [f"{l}_{s}" for l in ("line", "word") for s in ("all", "mono", "cross")]) + """
FROM km GROUP BY sim_name"""


def _attr_sql() -> str:
    from langmix.sources.dims import DATA_CODES, LANG_ATTRIBUTES
    attrs = ", ".join(f"({_q(c)}, {_q(f)}, {_q(w)}, {_q(d)})" for c, f, w, d in LANG_ATTRIBUTES)
    codes = ", ".join(f"({_q(a)}, {_q(b)})" for a, b in DATA_CODES)
    return f"""WITH attrs(code, family, word_order, direction) AS (VALUES {attrs}),
codes(code, mapped) AS (VALUES {codes}),
u AS (SELECT d.doc_id AS id, coalesce(c.mapped, d.lang) AS eval_code FROM documents d LEFT JOIN codes c ON c.code = d.lang),
tr AS (SELECT u.*, t.pos, coalesce(c.mapped, t.lang) AS tcode
       FROM (SELECT id, unnest({train_list()}) AS lang, unnest(generate_series(0, len({train_list()}) - 1)) AS pos FROM u) t
       JOIN u ON u.id = t.id LEFT JOIN codes c ON c.code = t.lang),
j AS (SELECT tr.*, ta.family AS tf, ta.word_order AS tw, ta.direction AS td,
             ea.family AS ef, ea.word_order AS ew, ea.direction AS ed
      FROM tr LEFT JOIN attrs ta ON ta.code = tr.tcode LEFT JOIN attrs ea ON ea.code = tr.eval_code)
SELECT id, eval_code AS eval_lang,
       CAST(max(CASE WHEN split_part(tcode, '_', 2) = split_part(eval_code, '_', 2) THEN 1 ELSE 0 END) AS INTEGER) AS script,
       CAST(max(CASE WHEN tf = ef THEN 1 ELSE 0 END) AS INTEGER) AS family,
       CAST(max(CASE WHEN tw = 'ND' OR ew = 'ND' OR tw = ew THEN 1 ELSE 0 END) AS INTEGER) AS word_order,
       CAST(max(CASE WHEN td = ed THEN 1 ELSE 0 END) AS INTEGER) AS script_lr,
       CAST(CASE WHEN count(*) = 1 THEN 1
                 WHEN max(CASE WHEN pos = 0 THEN td END) = max(CASE WHEN pos = 1 THEN td END) THEN 1 ELSE 0 END AS INTEGER)
         AS training_script_lr
FROM j GROUP BY id, eval_code"""


ORACLES["attribute_match_features"] = _attr_sql()

ORACLES["share_means_by_task"] = _LD + """,
w AS (SELECT id, task, coalesce(max(CASE WHEN lang = 'de' THEN p END), 0.0) AS de,
             coalesce(max(CASE WHEN lang = 'en' THEN p END), 0.0) AS en,
             coalesce(max(CASE WHEN lang = 'es' THEN p END), 0.0) AS es,
             coalesce(max(CASE WHEN lang = 'fr' THEN p END), 0.0) AS fr
      FROM line_dist GROUP BY id, task),
l AS (SELECT task, 'de' AS lang, de AS share FROM w UNION ALL SELECT task, 'en', en FROM w
      UNION ALL SELECT task, 'es', es FROM w UNION ALL SELECT task, 'fr', fr FROM w)
SELECT lang, task, round(avg(share), 6) AS mean_share FROM l GROUP BY lang, task"""


def _o7_sql() -> str:
    from langmix.plans.queries import ISO3
    iso = ", ".join(f"({_q(a)}, {_q(b)})" for a, b, _ in ISO3)
    mt5 = "('deu', 3.05), ('eng', 5.67)"
    return with_(COMPLETIONS, MODEL, LABELLED_LINES, LINE_DIST, CHECKS, RATES) + f""",
ent AS (SELECT id, task, language AS expected, {ent_raw('reweighted_entropy')} FROM line_dist GROUP BY ALL),
eg AS (SELECT expected AS lang, task, round(avg(reweighted_entropy), 6) AS entropy FROM ent GROUP BY ALL),
lp AS (SELECT language AS lang, task, round(avg(lpr), 6) AS lpr_mean FROM rates GROUP BY ALL),
iso(lang, iso3) AS (VALUES {iso}),
mt(iso3, mt5) AS (VALUES {mt5})
SELECT coalesce(iso.iso3, eg.lang) AS lang, eg.task, eg.entropy, lp.lpr_mean, mt.mt5
FROM eg LEFT JOIN lp USING (lang, task) LEFT JOIN iso USING (lang) LEFT JOIN mt USING (iso3)"""


ORACLES["entropy_metric_share"] = _o7_sql()

ORACLES["stacked_shares_by_task"] = _LD + """,
nu AS (SELECT language, task, count(DISTINCT id) AS n FROM line_dist GROUP BY ALL),
full_ AS (SELECT language FROM nu GROUP BY ALL HAVING count(DISTINCT task) = 2),
w AS (SELECT l.language, l.task,
             round(coalesce(sum(CASE WHEN lang = 'de' THEN p END), 0.0) / any_value(nu.n), 6) AS de,
             round(coalesce(sum(CASE WHEN lang = 'en' THEN p END), 0.0) / any_value(nu.n), 6) AS en,
             round(coalesce(sum(CASE WHEN lang = 'es' THEN p END), 0.0) / any_value(nu.n), 6) AS es,
             round(coalesce(sum(CASE WHEN lang = 'fr' THEN p END), 0.0) / any_value(nu.n), 6) AS fr
      FROM line_dist l JOIN nu USING (language, task)
      WHERE l.language IN (SELECT language FROM full_)
      GROUP BY l.language, l.task)
SELECT *, round(1.0 - (((de + en) + es) + fr), 6) AS etc,
       CAST(CASE WHEN task = 'monolingual' THEN 0 ELSE 1 END AS INTEGER) AS step_order FROM w"""

ORACLES["distribution_with_similarity"] = _LD + """,
pc AS (SELECT a.lang AS "row", b.lang AS col, sum(a.weight * b.weight) AS dot FROM profile a JOIN profile b USING (gram)
       GROUP BY ALL),
pnrm AS (SELECT lang, sqrt(sum(weight * weight)) AS nrm FROM profile GROUP BY lang),
cosm AS (SELECT "row", col, round((dot / (na.nrm * nb.nrm) + 1) / 2, 6) AS cos_sim
         FROM pc JOIN pnrm na ON na.lang = "row" JOIN pnrm nb ON nb.lang = col)
SELECT d.id, d.language, d.lang, d.p, c.cos_sim
FROM line_dist d LEFT JOIN cosm c ON c."row" = d.lang AND c.col = d.language"""

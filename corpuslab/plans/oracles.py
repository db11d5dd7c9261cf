"""DuckDB twins of the registered queries (the correctness gate).

Each text runs on the driver's pre-registered views (documents, labels, ...).
Shared stand-in views are written once as CTE text and spliced in.
"""

from __future__ import annotations

from corpuslab.functions.stopwords import STOP_WORDS, all_stop_words
from corpuslab.sources.fixtures import CURVE_RUNS, SCORE_COLUMNS

ORACLES: dict[str, str] = {}


def oracle(key: str, sql: str) -> None:
    ORACLES[key] = sql.strip()


# --- shared stand-in views -------------------------------------------------
CASES = """
cases AS (
  SELECT d.doc_id,
    concat('ID:XX:', upper(d.source), ':', CAST(1910 + d.doc_id % 111 AS VARCHAR), ':', CAST(d.doc_id AS VARCHAR)) AS identifier,
    CASE WHEN l.doc_id IS NULL THEN 'none' WHEN l.toxic = 1 THEN '-'
         ELSE split_part(d.text, chr(10), 1) END AS summary,
    CASE WHEN d.doc_id % 97 = 0 THEN 'none' ELSE d.text END AS description,
    CASE WHEN l.doc_id IS NULL AND d.doc_id % 97 = 0 THEN 'summary|description'
         WHEN l.doc_id IS NULL THEN 'summary'
         WHEN d.doc_id % 97 = 0 THEN 'description' ELSE 'none' END AS missing_parts,
    d.lang AS class, d.n_chars
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

PAIRS = """
pairs AS (
  SELECT u.conv_id, u.turn, u.text AS ref, concat('</s><s>', a.text, '</s>') AS c_summary
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

CURVES = """
curves AS (
  SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY day) - 1 AS INTEGER) AS epoch, n, loss
  FROM (SELECT event_type AS run, CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS n,
               round(avg(value), 6) AS loss
        FROM events GROUP BY event_type, CAST(ts AS DATE)))"""

GENERATED = """
generated AS (
  SELECT identifier, 'full' AS model, concat('</s><s>', split_part(description, chr(10), 2), '</s>') AS c_summary
  FROM cases WHERE description <> 'none'
  UNION ALL
  SELECT identifier, class AS model, concat('</s><s>', split_part(description, chr(10), 3), '</s>') AS c_summary
  FROM cases WHERE description <> 'none')"""

SCORES = "scores AS (SELECT identifier, class, " + ", ".join(
    f"CAST(1 + (n_chars * {2 * k + 1} + {k}) % 5 AS INTEGER) AS {name}"
    for k, name in enumerate(SCORE_COLUMNS)) + " FROM cases)"


def wc(x: str) -> str:
    """Word count: the one place where the two engines' texts must differ."""
    return f"CAST(len(regexp_extract_all({x}, '\\S+')) AS BIGINT)"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]{{2,}}')"


def sentences(x: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all({x}, '[^.!?]+[.!?]*'), "
            f"lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')")


def _lit_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def stop_list(lang: str) -> str:
    expr = _lit_list(all_stop_words())
    for code in sorted(STOP_WORDS):
        expr = f"CASE WHEN {lang} = '{code}' THEN {_lit_list(STOP_WORDS[code])} ELSE {expr} END"
    return expr


def tokens_nostop(x: str, lang: str) -> str:
    return f"list_filter({tokens(x)}, lambda t: NOT list_contains({stop_list(lang)}, t))"


def decade(x: str) -> str:
    return f"CAST(floor(CAST(split_part({x}, ':', 4) AS INTEGER) / 10) * 10 AS INTEGER)"


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


# --- 2.5 aggregations --------------------------------------------------------
DECADE_ROLLUP = with_(CASES) + f"""
, per AS (
  SELECT {decade('identifier')} AS decade, missing_parts, summary,
         {wc("replace(summary, '|', ' ')")} AS sw FROM cases),
agg AS (
  SELECT decade, CAST(count(*) AS BIGINT) AS cases,
    CAST(sum(CASE WHEN missing_parts = 'none' THEN 1 ELSE 0 END) AS BIGINT) AS complete_cases,
    CAST(sum(CASE WHEN summary <> 'none' AND sw = 1 THEN 1 ELSE 0 END) AS BIGINT) AS oneword_summaries,
    CAST(sum(CASE WHEN summary <> 'none' AND sw > 1 AND sw < 10 THEN 1 ELSE 0 END) AS BIGINT) AS short_summaries,
    CAST(sum(CASE WHEN missing_parts = 'summary' THEN 1 ELSE 0 END) AS BIGINT) AS missing_summaries
  FROM per GROUP BY decade),
frame AS (SELECT CAST(d AS INTEGER) AS decade FROM range(1910, 2021, 10) t(d)),
roll AS (
  SELECT f.decade, CAST(coalesce(cases, 0) AS BIGINT) AS cases,
    CAST(coalesce(complete_cases, 0) AS BIGINT) AS complete_cases,
    CAST(coalesce(oneword_summaries, 0) AS BIGINT) AS oneword_summaries,
    CAST(coalesce(short_summaries, 0) AS BIGINT) AS short_summaries,
    CAST(coalesce(missing_summaries, 0) AS BIGINT) AS missing_summaries
  FROM frame f LEFT JOIN agg a ON f.decade = a.decade)
"""

oracle("decade_rollup", DECADE_ROLLUP + """
SELECT *, CAST(complete_cases - short_summaries - oneword_summaries AS BIGINT) AS viable_cases FROM roll""")


# --- derived views shared by many keys ----------------------------------------
VIABLE = f"""
viable AS (
  SELECT identifier, summary, description, class FROM cases
  WHERE missing_parts = 'none' AND summary <> '-' AND {wc('summary')} >= 10
    AND {wc('description')} <= 1024)"""

PREP = f"""
prep AS (
  SELECT identifier, summary, description, class,
    {tokens("replace(description, '|', ' ')")} AS d_tok, {sentences("replace(description, '|', ' ')")} AS d_sent,
    {tokens("replace(summary, '|', ' ')")} AS s_tok, {sentences("replace(summary, '|', ' ')")} AS s_sent
  FROM viable)"""

ALL_STOP = _lit_list(all_stop_words())


def jaccard(a: str, b: str) -> str:
    u = f"len(list_distinct(list_concat({a}, {b})))"
    return (f"(CASE WHEN {u} > 0 THEN len(list_intersect(list_distinct({a}), list_distinct({b}))) / {u} "
            f"ELSE 0.0 END)")


def coherence(sents: str, k: int | None = None) -> str:
    s = f"{sents}[1:{k}]" if k else sents
    toks = f"list_transform({s}, lambda x: {tokens('x')})"
    return (f"(SELECT CASE WHEN len(tk) >= 2 THEN round(list_reduce(list_prepend(0.0::DOUBLE, "
            f"list_transform(range(1, len(tk)), lambda i: {jaccard('tk[i]', 'tk[i + 1]')} / (len(tk) - 1))), "
            f"lambda a, v: a + v), 4) ELSE 0.0 END FROM (SELECT {toks} AS tk))")


def unigram_sim(a: str, b: str) -> str:
    pq = (f"list_transform(list_distinct(list_concat({a}, {b})), lambda t: {{'p': len(list_filter({a}, lambda x: x = t)) / len({a}), "
          f"'q': len(list_filter({b}, lambda x: x = t)) / len({b})}})")
    term = ("list_transform(pq, lambda e: (CASE WHEN e.p > 0 THEN e.p * ln(e.p / ((e.p + e.q) / 2)) ELSE 0.0 END) "
            "+ (CASE WHEN e.q > 0 THEN e.q * ln(e.q / ((e.p + e.q) / 2)) ELSE 0.0 END))")
    return (f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN (SELECT round(1.0 - sqrt(greatest(list_sum({term}) / 2, 0.0)), 4) "
            f"FROM (SELECT {pq} AS pq)) END)")


FEATS = f"""
feats0 AS (
  SELECT identifier,
    {unigram_sim('s_tok', 'd_tok')} AS topic_similarity,
    CASE WHEN len(s_tok) > 0 THEN round(1.0 - len(list_filter(s_tok, lambda t: list_contains(d_tok, t))) / len(s_tok), 4) END AS abstractivity,
    (SELECT CASE WHEN len(rs) > 0 THEN round(1.0 - len(list_distinct(rs)) / len(rs), 4) END
       FROM (SELECT list_filter(s_tok, lambda t: NOT list_contains({ALL_STOP}, t)) AS rs)) AS redundancy,
    {coherence('s_sent')} AS semantic_coherence,
    CAST(len(s_tok) AS INTEGER) AS sum_words, CAST(len(s_sent) AS INTEGER) AS sum_sents,
    CAST(len(d_tok) AS INTEGER) AS desc_words, CAST(len(d_sent) AS INTEGER) AS desc_sents,
    CASE WHEN len(s_tok) > 0 AND len(d_tok) > 0 THEN round(1.0 - len(s_tok) / len(d_tok), 4) END AS cmp_words,
    CASE WHEN len(s_sent) > 0 AND len(d_sent) > 0 THEN round(1.0 - len(s_sent) / len(d_sent), 4) END AS cmp_sents
  FROM prep),
feats AS (
  SELECT identifier, coalesce(topic_similarity, 999.0) AS topic_similarity, coalesce(abstractivity, 999.0) AS abstractivity,
    coalesce(redundancy, 999.0) AS redundancy, coalesce(semantic_coherence, 999.0) AS semantic_coherence,
    sum_words, sum_sents, desc_words, desc_sents,
    coalesce(cmp_words, 999.0) AS cmp_words, coalesce(cmp_sents, 999.0) AS cmp_sents
  FROM feats0)"""

FEATURE_COLS = ["topic_similarity", "abstractivity", "redundancy", "semantic_coherence", "cmp_words", "cmp_sents"]
NO_SENT = " AND ".join(f"{c} <> 999" for c in FEATURE_COLS)
ANY_SENT = " OR ".join(f"{c} = 999" for c in FEATURE_COLS)


def quota(src: str, n: str, draws: str, out: str) -> str:
    """Largest-remainder apportionment, as SQL over a one-row-per-class table."""
    return f"""
SELECT *, CAST(fl + CASE WHEN rk <= need THEN 1 ELSE 0 END AS BIGINT) AS {out} FROM (
  SELECT *, row_number() OVER (ORDER BY rem DESC, class) AS rk FROM (
    SELECT *, cont - fl AS rem, {draws} - sum(fl) OVER () AS need FROM (
      SELECT *, floor(cont) AS fl FROM (
        SELECT *, CAST({n} AS DOUBLE) / sum({n}) OVER () * {draws} AS cont FROM {src}))))"""


SPLIT = VIABLE + f""",
cc AS (SELECT class, count(*) AS n FROM viable GROUP BY class),
s1 AS (SELECT class, n, sum(n) OVER () - ceil(0.3::DOUBLE * sum(n) OVER ()) AS d1 FROM cc),
q1 AS ({quota('s1', 'n', 'd1', 'train')}),
s2 AS (SELECT class, n, train, n - train AS tmp, sum(n - train) OVER () - ceil(0.33::DOUBLE * sum(n - train) OVER ()) AS d2 FROM q1),
q2 AS ({quota('s2', 'tmp', 'd2', 'validation')}),
ranked AS (SELECT v.*, row_number() OVER (PARTITION BY v.class ORDER BY md5(v.identifier || ':42')) AS rk FROM viable v),
split_case AS (
  SELECT r.identifier, r.summary, r.description, r.class,
    CASE WHEN r.rk <= q.train THEN 'train' WHEN r.rk <= q.train + q.validation THEN 'validation' ELSE 'test' END AS split
  FROM ranked r JOIN q2 q ON r.class = q.class)"""

# --- 2.3 ------------------------------------------------------------------------
oracle("viable_filter", with_(CASES, VIABLE) + "SELECT identifier, summary, description FROM viable")
oracle("complete_filter", with_(CASES) + f"""
SELECT identifier, summary, description FROM cases
WHERE missing_parts = 'none' AND summary <> '-' AND {wc('summary')} >= 10""")
oracle("id_subset", with_(CASES) + """
SELECT identifier, summary, missing_parts FROM cases
WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
oracle("id_lookup", with_(CASES, GENERATED) + """
SELECT c.identifier, c.summary AS reference, g.model, g.c_summary
FROM cases c LEFT JOIN generated g ON c.identifier = g.identifier
WHERE c.identifier = 'ID:XX:SRC1:1911:1'""")
oracle("length_equals", with_(CASES, VIABLE, PREP, FEATS) + "SELECT identifier, desc_words FROM feats WHERE desc_words = 1000")
oracle("quantile_trim", with_(CASES, VIABLE, PREP, FEATS) + """
SELECT identifier, desc_words FROM feats
WHERE desc_words BETWEEN (SELECT min(desc_words) FROM feats) AND (SELECT quantile_cont(desc_words, 0.99) FROM feats)""")
oracle("drop_sentinel", with_(CASES, VIABLE, PREP, FEATS) + f"SELECT * FROM feats WHERE {NO_SENT}")
oracle("sentinel_audit", with_(CASES, VIABLE, PREP, FEATS) + f"SELECT * FROM feats WHERE {ANY_SENT}")
oracle("computed_only", with_(CASES, VIABLE, PREP) + """
SELECT identifier, round(1.0 - len(list_filter(s_tok, lambda t: list_contains(d_tok, t))) / len(s_tok), 4) AS abstractivity
FROM prep WHERE len(s_tok) > 0""")
oracle("decade_of_id", with_(CASES) + f"SELECT identifier, {decade('identifier')} AS decade FROM cases")
oracle("add_score_columns", with_(CASES, SPLIT) + "SELECT identifier, class, split, " + ", ".join(
    f"CAST(0 AS INTEGER) AS {c}" for c in SCORE_COLUMNS) + " FROM split_case WHERE split = 'test'")
oracle("rename_prefix", with_(CURVES) + "SELECT run, epoch AS train_epoch, n AS train_n, loss AS train_loss FROM curves")

# --- 2.5 ------------------------------------------------------------------------
oracle("year_rollup", with_(CASES) + f"""
SELECT CAST(split_part(identifier, ':', 4) AS INTEGER) AS current_year, CAST(count(*) AS BIGINT) AS case_count,
  CAST(count(*) FILTER (WHERE missing_parts = 'none') AS BIGINT) AS complete_cases,
  CAST(count(*) FILTER (WHERE description = 'none') AS BIGINT) AS missing_desc,
  CAST(count(*) FILTER (WHERE summary = 'none') AS BIGINT) AS missing_sums,
  CAST(count(*) FILTER (WHERE summary <> 'none' AND {wc("replace(summary, '|', ' ')")} BETWEEN 1 AND 9) AS BIGINT) AS short_summary
FROM cases GROUP BY 1""")
oracle("grand_totals", DECADE_ROLLUP + """
SELECT CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(complete_cases) AS BIGINT) AS complete_cases,
  CAST(sum(oneword_summaries) AS BIGINT) AS oneword_summaries, CAST(sum(short_summaries) AS BIGINT) AS short_summaries,
  CAST(sum(missing_summaries) AS BIGINT) AS missing_summaries,
  CAST(sum(complete_cases - short_summaries - oneword_summaries) AS BIGINT) AS viable_cases FROM roll""")
oracle("feature_means", with_(CASES, VIABLE, PREP, FEATS) + "SELECT " + ", ".join(
    f"round(avg({c}), 6) AS mean_{c}" for c in FEATURE_COLS + ["sum_words", "sum_sents", "desc_words", "desc_sents"])
    + f" FROM feats WHERE {NO_SENT}")
oracle("class_mean_std", with_(CASES, SCORES) + "SELECT class, " + ", ".join(
    f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std" for c in SCORE_COLUMNS)
    + " FROM scores GROUP BY class")
UNPIV = ("long AS (SELECT metric, score FROM (UNPIVOT (SELECT " + ", ".join(SCORE_COLUMNS) + " FROM scores) ON "
         + ", ".join(SCORE_COLUMNS) + " INTO NAME metric VALUE score))")
oracle("overall_mean_std", with_(CASES, SCORES, UNPIV) + """
SELECT metric, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std FROM long GROUP BY metric""")
oracle("score_freq", with_(CASES, SCORES, UNPIV) + "SELECT metric, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE score = {s}) AS BIGINT) AS n_{s}" for s in range(1, 6)) + " FROM long GROUP BY metric")
oracle("score_cumfreq", with_(CASES, SCORES, UNPIV) + """
, grid AS (SELECT m.metric, CAST(s.s AS INTEGER) AS score FROM (SELECT DISTINCT metric FROM long) m, range(1, 6) s(s)),
cnt AS (SELECT g.metric, g.score, CAST(count(l.score) AS BIGINT) AS n FROM grid g
        LEFT JOIN long l ON g.metric = l.metric AND g.score = l.score GROUP BY g.metric, g.score),
c2 AS (SELECT *, CAST(sum(n) OVER (PARTITION BY metric ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum,
       CAST(sum(n) OVER (PARTITION BY metric) AS BIGINT) AS total FROM cnt)
SELECT metric, score, n, cum, CAST(cum - n AS BIGINT) AS start, total, CAST(max(total) OVER () AS BIGINT) AS max_total FROM c2""")
oracle("distinct_count", with_(CASES, VIABLE, PREP, FEATS) + "SELECT CAST(count(DISTINCT desc_words) AS BIGINT) AS n_distinct FROM feats")
oracle("quantile", with_(CASES, VIABLE, PREP, FEATS) + """
SELECT round(CAST(min(desc_words) AS DOUBLE), 6) AS q0, round(quantile_cont(desc_words, 0.99), 6) AS q99 FROM feats""")
oracle("histogram_density", with_(CASES, VIABLE, PREP, FEATS) + """
, b AS (SELECT CAST(min(desc_words) AS DOUBLE) AS lo, quantile_cont(desc_words, 0.99) AS hi,
               count(DISTINCT desc_words) AS bins FROM feats),
w AS (SELECT lo, hi, bins, (hi - lo) / bins AS width FROM b),
x AS (SELECT CAST(least(w.bins - 1, floor((f.desc_words - w.lo) / w.width)) AS INTEGER) AS bin, w.width
      FROM feats f, w WHERE f.desc_words BETWEEN w.lo AND w.hi),
per AS (SELECT bin, any_value(width) AS width, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY bin)
SELECT bin, n, round(n / (sum(n) OVER () * width), 8) AS density FROM per""")
oracle("size_totals", """
SELECT doc_id, n_chars AS size,
  CAST(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running,
  CAST(sum(n_chars) OVER () AS BIGINT) AS total FROM documents""")
oracle("curve_bounds", with_(CURVES) + "SELECT run, max(epoch) AS max_step, max(loss) AS max_value FROM curves GROUP BY run")
oracle("best_checkpoint", with_(CURVES) + """
, b AS (SELECT run, min(loss) AS best_value FROM curves GROUP BY run)
SELECT c.run, min(c.epoch) AS best_step, b.best_value FROM curves c JOIN b ON c.run = b.run AND c.loss = b.best_value
GROUP BY c.run, b.best_value""")
oracle("weighted_curve", with_(CURVES) + """
, sz AS (SELECT run, CAST(sum(n) AS DOUBLE) AS size FROM curves GROUP BY run),
w AS (SELECT run, size / (SELECT sum(size) FROM sz) AS w FROM sz)
SELECT c.epoch, round(sum(c.loss * w.w), 6) AS weighted_loss, CAST(count(*) AS BIGINT) AS n_runs
FROM curves c JOIN w ON c.run = w.run GROUP BY c.epoch""")

# --- 2.6 ------------------------------------------------------------------------
oracle("shuffle", with_(CASES) + """
SELECT identifier, CAST(row_number() OVER (ORDER BY md5(identifier || ':42')) AS BIGINT) AS pos FROM cases""")
oracle("sample_n", with_(CASES) + "SELECT identifier, class FROM cases ORDER BY md5(identifier || ':42') LIMIT 20")
oracle("sample_per_class", with_(CASES) + """
SELECT identifier, class FROM (
  SELECT identifier, class, row_number() OVER (PARTITION BY class ORDER BY md5(identifier || ':42')) AS rk,
         round_even(count(*) OVER (PARTITION BY class) * 0.004::DOUBLE, 0) AS quota FROM cases)
WHERE rk <= quota""")
UNIFORM = "((('0x' || substr(md5(identifier || ':42'), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"
oracle("sample_weighted", with_(CASES) + f"""
SELECT identifier, n_chars FROM cases WHERE n_chars > 0
ORDER BY -ln({UNIFORM}) / n_chars, identifier LIMIT 20""")
oracle("stratified_split", with_(CASES, SPLIT) + "SELECT identifier, class, split FROM split_case")
oracle("first_k_sentences", with_(CASES, VIABLE) + f"""
SELECT identifier, array_to_string(({sentences('description')})[1:10], chr(10)) AS lead,
  CAST(least(len({sentences('description')}), 10) AS INTEGER) AS n FROM viable""")
oracle("argmax_topic", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS topic FROM embeddings""")
oracle("keep_last_k", with_(CURVES) + """
SELECT run, epoch, n, loss FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS rn FROM curves)
WHERE rn <= 3""")
oracle("cumsum", with_(CURVES) + """
SELECT run, epoch, n, loss,
  CAST(sum(n) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_n
FROM curves""")
oracle("row_index", with_(CURVES) + """
SELECT run, epoch, CAST(row_number() OVER (PARTITION BY run ORDER BY epoch) - 1 AS INTEGER) AS train_epoch,
  CAST(row_number() OVER (PARTITION BY run ORDER BY epoch) AS INTEGER) AS val_epoch FROM curves""")
oracle("sort", "SELECT doc_id, source FROM documents ORDER BY source, doc_id")


# --- 2.7 ------------------------------------------------------------------------
def rouge_words(x: str) -> str:
    return (f"flatten(list_transform(list_filter(string_split({x}, '.'), lambda s: length(s) > 0), "
            f"lambda s: string_split(trim(regexp_replace(s, '\\s+', ' ', 'g')), ' ')))")


def ngrams(w: str, n: int) -> str:
    return (f"(CASE WHEN len({w}) >= {n} THEN list_transform(range(1, len({w}) - {n} + 2), "
            f"lambda i: array_to_string({w}[i:i + {n - 1}], ' ')) ELSE [] END)")


def n_parts(x: str) -> str:
    return f"len(list_filter(string_split({x}, '.'), lambda s: length(s) > 0))"


def rouge_n(h: str, r: str, n: int, digits: int | None = 6) -> str:
    hg, rg_ = f"list_distinct({ngrams(rouge_words(h), n)})", f"list_distinct({ngrams(rouge_words(r), n)})"
    f = "2.0 * ((p * rc) / (p + rc + 1e-8))"
    f = f"round({f}, {digits})" if digits is not None else f
    return (f"(SELECT CASE WHEN {n_parts(h)} > 0 AND {n_parts(r)} > 0 THEN {f} END FROM ("
            f"SELECT CASE WHEN len(hg) > 0 THEN len(list_intersect(hg, rg)) / len(hg) ELSE 0.0 END AS p, "
            f"CASE WHEN len(rg) > 0 THEN len(list_intersect(hg, rg)) / len(rg) ELSE 0.0 END AS rc "
            f"FROM (SELECT {hg} AS hg, {rg_} AS rg)))")


STRIP = "substring(c_summary, 8, greatest(length(c_summary) - 11, 0))"

oracle("pipes_to_space", with_(CASES) + "SELECT identifier, replace(missing_parts, '|', ' ') AS parts_spaced FROM cases")
oracle("word_count", with_(CASES) + f"""
SELECT identifier, {wc('summary')} AS summary_words, {wc('description')} AS desc_words FROM cases""")
oracle("tokenize", f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)""")
oracle("tokenize_nostop", f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT doc_id, {tokens_nostop('text', 'lang')} AS t FROM documents)""")
oracle("sentences", f"""
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, md5(array_to_string(s, chr(10))) AS sentences_md5
FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)""")
oracle("strip_markers", with_(PAIRS) + f"SELECT conv_id, turn, {STRIP} AS hyp FROM pairs")
oracle("id_fields", with_(CASES) + "SELECT identifier, " + ", ".join(
    f"split_part(identifier, ':', {i}) AS f{i}" for i in range(1, 6)) + " FROM cases")
oracle("round4", "SELECT event_id, round(value / 3, 4) AS v4 FROM events")
oracle("round2", "SELECT event_id, round(value / 7, 2) AS v2 FROM events")
oracle("array_join_tags", with_(CASES) + """
SELECT identifier, array_to_string(string_split(identifier, ':')[2:3], '|') AS tags FROM cases""")
oracle("array_pos", with_(CASES) + "SELECT identifier, string_split(identifier, ':')[4] AS year FROM cases")
oracle("array_distinct", f"SELECT doc_id, CAST(len(list_distinct({tokens('text')})) AS BIGINT) AS n_types FROM documents")
oracle("softmax", """
SELECT vec_id, round(list_max(p), 6) AS p_max, round(p[1], 6) AS p_first FROM (
  SELECT vec_id, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM (
    SELECT vec_id, list_transform(embedding, lambda x: exp(x - list_max(embedding))) AS ex FROM embeddings))""")
oracle("js_distance", """
SELECT vec_id, round(sqrt(greatest((kl_p + kl_q) / 2, 0.0)), 6) AS js FROM (
  SELECT vec_id,
    list_sum(list_transform(range(1, 33), lambda i: CASE WHEN p[i] > 0 THEN p[i] * ln(p[i] / ((p[i] + q[i]) / 2)) ELSE 0.0 END)) AS kl_p,
    list_sum(list_transform(range(1, 33), lambda i: CASE WHEN q[i] > 0 THEN q[i] * ln(q[i] / ((p[i] + q[i]) / 2)) ELSE 0.0 END)) AS kl_q
  FROM (
    SELECT vec_id, list_transform(a, lambda x: x / list_sum(a)) AS p, list_transform(b, lambda x: x / list_sum(b)) AS q
    FROM (SELECT vec_id, list_transform(embedding[1:32], lambda x: abs(x)::DOUBLE) AS a,
                 list_transform(embedding[33:64], lambda x: abs(x)::DOUBLE) AS b FROM embeddings)))""")
oracle("ngrams", with_(PAIRS) + f"""
SELECT conv_id, turn, CAST(len(list_distinct({ngrams('w', 1)})) AS BIGINT) AS n_uni,
  CAST(len(list_distinct({ngrams('w', 2)})) AS BIGINT) AS n_bi
FROM (SELECT conv_id, turn, {rouge_words('ref')} AS w FROM pairs)""")

# --- 2.8 ------------------------------------------------------------------------
oracle("length_features", with_(CASES, VIABLE, PREP, FEATS) + """
SELECT identifier, sum_words, sum_sents, desc_words, desc_sents, cmp_words, cmp_sents FROM feats""")
oracle("length_features_text", with_(CASES, VIABLE, PREP) + """
SELECT identifier, CAST(len(d_tok) AS INTEGER) AS desc_words, CAST(len(d_sent) AS INTEGER) AS desc_sents FROM prep""")
oracle("abstractivity", with_(CASES, VIABLE, PREP, FEATS) + "SELECT identifier, abstractivity FROM feats")
oracle("redundancy_ttr", with_(CASES, VIABLE) + f"""
SELECT identifier, coalesce((SELECT CASE WHEN len(rs) > 0 THEN round(1.0 - len(list_distinct(rs)) / len(rs), 4) END
  FROM (SELECT {tokens_nostop("replace(description, '|', ' ')", 'class')} AS rs)), 999.0) AS redundancy FROM viable""")
oracle("coherence", with_(CASES, VIABLE, PREP) + f"SELECT identifier, {coherence('s_sent')} AS semantic_coherence FROM prep")
oracle("coherence_top10", with_(CASES, VIABLE, PREP) + f"""
SELECT identifier, {coherence('d_sent', 10)} AS semantic_coherence FROM prep""")
oracle("unigram_similarity", with_(CASES, VIABLE, PREP, FEATS) + "SELECT identifier, topic_similarity FROM feats")
oracle("rouge_n", with_(PAIRS) + f"""
SELECT conv_id, turn, {rouge_n('hyp', 'ref', 1)} AS rouge1, {rouge_n('hyp', 'ref', 2)} AS rouge2
FROM (SELECT conv_id, turn, ref, {STRIP} AS hyp FROM pairs)""")


# --- 2.4 ------------------------------------------------------------------------
TEST = "test_case AS (SELECT * FROM split_case WHERE split = 'test')"
oracle("split_join", with_(CASES, SPLIT) + "SELECT identifier, summary, description, class, split FROM split_case")
oracle("reference_lookup", with_(CASES, GENERATED, SPLIT, TEST) + """
SELECT g.identifier, g.c_summary, t.summary, t.class FROM generated g JOIN test_case t ON g.identifier = t.identifier
WHERE g.model = 'full'""")
oracle("eval_sheet_full", with_(CASES, GENERATED, SPLIT, TEST) + f"""
SELECT t.*, g.summary_full_model FROM test_case t LEFT JOIN (
  SELECT identifier, {STRIP} AS summary_full_model FROM generated WHERE model = 'full') g ON t.identifier = g.identifier""")
oracle("eval_sheet_cluster", with_(CASES, GENERATED, SPLIT, TEST) + f"""
SELECT t.*, g.summary_cluster_model FROM test_case t LEFT JOIN (
  SELECT identifier, model, {STRIP} AS summary_cluster_model FROM generated) g
  ON t.identifier = g.identifier AND t.class = g.model""")

ASSIGN = """
cen AS (SELECT label, list(c ORDER BY i) AS c FROM (
          SELECT label, i, avg(embedding[i]) AS c FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label),
dd AS (SELECT e.vec_id, e.label, cen.label AS center,
         list_sum(list_transform(range(1, 65), lambda i: (e.embedding[i]::DOUBLE - cen.c[i]) * (e.embedding[i]::DOUBLE - cen.c[i]))) AS dist
       FROM embeddings e, cen),
best AS (SELECT vec_id, label, center, dist FROM (
          SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, center) AS rn FROM dd) WHERE rn = 1)"""
oracle("kmeans_assign_step", with_(ASSIGN) + "SELECT vec_id, center, round(dist, 6) AS dist FROM best")
oracle("predictions_concat", with_(ASSIGN) + "SELECT vec_id, label, center AS class FROM best")
oracle("class_counts", with_(ASSIGN) + "SELECT center AS class, CAST(count(*) AS BIGINT) AS n FROM best GROUP BY center")
oracle("assignment_audit", with_(ASSIGN) + """
SELECT a.vec_id, a.center AS stored_class, b.center AS predicted_class FROM best a JOIN best b ON a.vec_id = b.vec_id
WHERE a.center <> b.center""")
oracle("curve_align", with_(CURVES) + """
SELECT epoch, """ + ", ".join(f"max(loss) FILTER (WHERE run = '{r}') AS {r}" for r in CURVE_RUNS) + " FROM curves GROUP BY epoch")
oracle("score_align_outer", with_(CASES, SCORES, UNPIV) + "SELECT CAST(g.s AS INTEGER) AS score, " + ", ".join(
    f"CAST(count(l.score) FILTER (WHERE l.metric = '{c}') AS BIGINT) AS {c}" for c in SCORE_COLUMNS)
    + " FROM range(1, 6) g(s) LEFT JOIN long l ON l.score = g.s GROUP BY g.s")
oracle("token_semi", with_(CASES, VIABLE, PREP) + """
SELECT identifier, CAST(len(k) AS BIGINT) AS n_shared, md5(array_to_string(k, ' ')) AS shared_md5 FROM (
  SELECT identifier, list_filter(s_tok, lambda t: list_contains(d_tok, t)) AS k FROM prep)""")
TOKS = f"toks AS (SELECT doc_id, unnest({tokens('text')}) AS token FROM documents)"
DFS = "dfs AS (SELECT token, CAST(count(*) AS BIGINT) AS tf, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM toks GROUP BY token)"
VOCAB2 = (f"btoks AS (SELECT item_id, unnest({tokens('text')}) AS token FROM benchmark), "
          "bdfs AS (SELECT token, CAST(count(*) AS BIGINT) AS tf, CAST(count(DISTINCT item_id) AS BIGINT) AS df FROM btoks GROUP BY token), "
          "vocab AS (SELECT token, tf, df, CAST(row_number() OVER (ORDER BY df DESC, token) + 2 AS BIGINT) AS term_id "
          "FROM bdfs)")
oracle("token_anti", with_(TOKS, VOCAB2) + """
SELECT t.doc_id, CAST(count(*) AS BIGINT) AS n_dropped FROM toks t LEFT JOIN vocab v ON t.token = v.token
WHERE v.token IS NULL GROUP BY t.doc_id""")
EQ = ("CAST(list_sum(list_transform(list_distinct(d_sent), lambda x: len(list_filter(d_sent, lambda y: y = x)) "
      "* (len(list_filter(d_sent, lambda y: y = x)) - 1) // 2)) AS BIGINT)")
oracle("sentence_pairs", with_(CASES, VIABLE, PREP) + f"""
SELECT identifier, CAST(len(d_sent) AS BIGINT) AS n_sentences, CAST(len(d_sent) * (len(d_sent) - 1) // 2 AS BIGINT) AS n_pairs,
  coalesce({EQ}, 0) AS n_equal_pairs FROM prep""")
oracle("sentence_pairs_unequal", with_(CASES, VIABLE, PREP) + f"""
SELECT identifier, CAST(len(d_sent) * (len(d_sent) - 1) - 2 * coalesce({EQ}, 0) AS BIGINT) AS n_ordered_unequal_pairs FROM prep""")
oracle("adjacent_pairs", with_(CASES, VIABLE, PREP) + """
SELECT identifier, CAST(i - 1 AS INTEGER) AS pos, s_sent[i] AS sentence, s_sent[i + 1] AS next_sentence FROM (
  SELECT identifier, s_sent, unnest(range(1, len(s_sent))) AS i FROM prep)""")
oracle("union_files", """
SELECT 'documents' AS origin, doc_id AS id, md5(text) AS text_md5 FROM documents
UNION ALL SELECT 'benchmark', item_id, md5(text) FROM benchmark""")

# --- 2.5 evaluation roll-ups -----------------------------------------------------
RS_FULL = f"""
rs AS (SELECT t.identifier, t.class,
         {rouge_n('hyp', 't.summary', 1, None)} AS rouge1, {rouge_n('hyp', 't.summary', 2, None)} AS rouge2
       FROM test_case t JOIN (SELECT identifier, {STRIP} AS hyp FROM generated WHERE model = 'full') g
         ON t.identifier = g.identifier)"""
RS_CLU = f"""
rs AS (SELECT t.identifier, t.class,
         {rouge_n('hyp', 't.summary', 1, None)} AS rouge1, {rouge_n('hyp', 't.summary', 2, None)} AS rouge2
       FROM test_case t JOIN (SELECT identifier, model, {STRIP} AS hyp FROM generated) g
         ON t.identifier = g.identifier AND t.class = g.model)"""
oracle("rouge_means", with_(CASES, GENERATED, SPLIT, TEST, RS_FULL) + """
SELECT round(avg(rouge1 * 100), 2) AS rouge1_mean, round(avg(rouge2 * 100), 2) AS rouge2_mean FROM rs""")
oracle("rouge_means_by_class", with_(CASES, GENERATED, SPLIT, TEST, RS_CLU) + """
SELECT class, round(avg(rouge1 * 100), 2) AS rouge1_mean, round(avg(rouge2 * 100), 2) AS rouge2_mean FROM rs GROUP BY class""")
oracle("weighted_combine", with_(CASES, GENERATED, SPLIT, TEST, RS_CLU) + """
, m AS (SELECT class, round(avg(rouge1 * 100), 2) AS rouge1_mean, round(avg(rouge2 * 100), 2) AS rouge2_mean FROM rs GROUP BY class),
sz AS (SELECT class, count(*) AS size FROM split_case GROUP BY class)
SELECT round(sum(rouge1_mean * size) / sum(size), 2) AS rouge1_mean, round(sum(rouge2_mean * size) / sum(size), 2) AS rouge2_mean
FROM m JOIN sz ON m.class = sz.class""")
oracle("split_dimensions", with_(CASES, SPLIT) + """
SELECT coalesce(class, 'full') AS dataset,
  CAST(count(*) FILTER (WHERE split = 'train') AS BIGINT) AS train,
  CAST(count(*) FILTER (WHERE split = 'validation') AS BIGINT) AS validation,
  CAST(count(*) FILTER (WHERE split = 'test') AS BIGINT) AS test, CAST(count(*) AS BIGINT) AS total
FROM split_case GROUP BY ROLLUP (class)""")

# --- 2.9 ------------------------------------------------------------------------
oracle("vocabulary", with_(TOKS, DFS) + """
SELECT token, tf, df, CAST(row_number() OVER (ORDER BY df DESC, token) + 2 AS BIGINT) AS term_id FROM dfs""")
oracle("doc_term_counts", with_(TOKS, DFS, VOCAB2) + """
SELECT t.doc_id, t.token, CAST(count(*) AS BIGINT) AS n, any_value(v.term_id) AS term_id
FROM toks t JOIN vocab v ON t.token = v.token GROUP BY t.doc_id, t.token""")
ENC = with_(TOKS, DFS, VOCAB2) + f"""
, t AS (SELECT doc_id, ({tokens('text')})[1:1024] AS tk FROM documents),
ex AS (SELECT doc_id, unnest(range(1, len(tk) + 1)) AS pos, unnest(tk) AS token FROM t),
m AS (SELECT ex.doc_id, ex.pos, coalesce(v.term_id, 1) AS id FROM ex LEFT JOIN vocab v ON ex.token = v.token),
ids AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM m GROUP BY doc_id),
enc AS (SELECT t.doc_id, coalesce(ids.ids, []::BIGINT[]) AS ids FROM t LEFT JOIN ids ON t.doc_id = ids.doc_id),
padded AS (SELECT doc_id, len(ids) AS n_real,
             list_concat(ids, list_transform(range(1024 - len(ids)), lambda x: 0::BIGINT)) AS input_ids FROM enc)
"""
def enc_cases(col: str, n: int, prefix: str) -> str:
    return f"""
{prefix}_t AS (SELECT identifier, ({tokens(f"replace({col}, '|', ' ')")})[1:{n}] AS tk FROM viable),
{prefix}_ex AS (SELECT identifier, unnest(range(1, len(tk) + 1)) AS pos, unnest(tk) AS token FROM {prefix}_t),
{prefix}_m AS (SELECT e.identifier, e.pos, coalesce(v.term_id, 1) AS id FROM {prefix}_ex e LEFT JOIN vocab v ON e.token = v.token),
{prefix}_ids AS (SELECT identifier, list(id ORDER BY pos) AS ids FROM {prefix}_m GROUP BY identifier),
{prefix}_enc AS (SELECT t.identifier, coalesce(i.ids, []::BIGINT[]) AS ids FROM {prefix}_t t
                 LEFT JOIN {prefix}_ids i ON t.identifier = i.identifier),
{prefix}_out AS (SELECT identifier, CAST({n} AS BIGINT) AS n_{prefix}, CAST(len(ids) AS BIGINT) AS n_{prefix}_real,
  md5(array_to_string(list_concat(ids, list_transform(range({n} - len(ids)), lambda x: 0::BIGINT)), ' ')) AS {prefix}_md5
  FROM {prefix}_enc)"""


oracle("encode_pad", with_(CASES, VIABLE, TOKS, DFS, VOCAB2) + "," + enc_cases("description", 1024, "ids") + ","
       + enc_cases("summary", 256, "labels") + """
SELECT a.identifier, a.n_ids, a.n_ids_real, a.ids_md5, b.n_labels, b.n_labels_real, b.labels_md5
FROM ids_out a JOIN labels_out b ON a.identifier = b.identifier""")
UMASK = ("((('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':' || CAST(i - 1 AS VARCHAR) || ':42'), 1, 13))::BIGINT)::DOUBLE"
         " + 0.5) / 4503599627370496.0")
oracle("mask_examples", ENC + f"""
, n AS (SELECT count(*) AS n_vocab FROM vocab),
pos AS (SELECT doc_id, unnest(range(1, 1025)) AS i, unnest(input_ids) AS t FROM padded),
h AS (SELECT doc_id, i, t, md5(CAST(doc_id AS VARCHAR) || ':' || CAST(i - 1 AS VARCHAR) || ':42') AS h, t <> 0 AND {UMASK} < 0.15 AS taken FROM pos),
x AS (
  SELECT doc_id, i, CASE WHEN taken THEN t ELSE -100 END AS y, CASE WHEN NOT taken THEN t
    WHEN ('0x' || substr(h, 14, 7))::BIGINT < 214748364 THEN 2
    WHEN ('0x' || substr(h, 14, 7))::BIGINT < 241591910 THEN 3 + ('0x' || substr(h, 21, 12))::BIGINT % n_vocab
    ELSE t END AS x FROM h, n)
SELECT doc_id, CAST(count(*) FILTER (y <> -100 AND x = 2) AS BIGINT) AS n_masked,
  CAST(count(*) FILTER (y <> -100 AND x <> 2 AND x <> y) AS BIGINT) AS n_replaced,
  CAST(count(*) FILTER (y <> -100 AND x <> 2 AND x = y) AS BIGINT) AS n_kept,
  md5(string_agg(CAST(x AS VARCHAR), ' ' ORDER BY i)) AS masked_md5, md5(string_agg(CAST(y AS VARCHAR), ' ' ORDER BY i)) AS labels_md5
FROM x GROUP BY doc_id""")


# --- 2.1 / 2.2 ------------------------------------------------------------------
oracle("xml_dates", """
SELECT event_id,
  strftime(try_strptime(strftime(ts, '%Y-%m-%d'), '%Y-%m-%d'), '%Y-%m-%d %H:%M:%S') AS judgment_date,
  strftime(try_strptime(props, '%Y-%m-%d'), '%Y-%m-%d %H:%M:%S') AS issue_date,
  strftime(try_strptime(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS modified
FROM events""")
HTML = ("regexp_replace(regexp_replace(replace(replace(replace(replace(replace("
        "regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), "
        "'<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), "
        "'\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')")
oracle("markup_to_text", f"""
SELECT page_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, {HTML} AS t FROM pages)""")
oracle("missing_flag", with_(CASES) + """
SELECT identifier, coalesce(nullif(concat_ws('|', CASE WHEN summary = 'none' THEN 'summary' END,
  CASE WHEN description = 'none' THEN 'description' END), ''), 'none') AS missing_flag FROM cases""")
oracle("parquet_scan", "SELECT doc_id, lang, n_chars FROM documents")
oracle("csv_scan", with_(CASES) + "SELECT identifier, class, n_chars FROM cases")
oracle("text_column_source", "SELECT text FROM documents")
oracle("generated_scan", with_(CASES, GENERATED) + "SELECT identifier, model, c_summary FROM generated")
oracle("size_balanced_chunks", """
SELECT doc_id, CAST(least(3, floor(4 * (cum - n_chars) / total)) AS INTEGER) AS chunk FROM (
  SELECT doc_id, n_chars,
    sum(n_chars) OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42') ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
    sum(n_chars) OVER () AS total FROM documents)""")
oracle("shuffled_chunk_write", with_(CASES) + f"""
, r AS (SELECT *, row_number() OVER (ORDER BY md5(identifier || ':42')) AS rn, count(*) OVER () AS total FROM cases)
SELECT identifier, CAST(least(9, floor((rn - 1) / greatest(total // 10, 1))) AS INTEGER) AS chunk FROM r
WHERE missing_parts = 'none' AND summary <> '-' AND {wc('summary')} >= 10 AND {wc('description')} <= 1024""")


# --- archive round trip: what parsing the generated archives must give back -------
ARCHIVED = """
archived AS (
  SELECT *, split_part(identifier, ':', 4) AS year,
    lpad(CAST(CAST(doc_id // 111 AS BIGINT) % 12 + 1 AS VARCHAR), 2, '0') AS month
  FROM cases WHERE CAST(split_part(identifier, ':', 4) AS INTEGER) NOT IN (1910, 1912))"""
PARAS = ("array_to_string(list_filter(list_transform(string_split({x}, chr(10)), "
         "lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> ''), ' ')")
oracle("xml_single_tags", with_(CASES, ARCHIVED) + """
SELECT identifier, split_part(identifier, ':', 3) AS seat_location, 'court-' || split_part(identifier, ':', 3) AS creator,
  'uitspraak' AS case_type FROM archived""")
oracle("xml_multi_tags", with_(CASES, ARCHIVED) + """
SELECT identifier, class || '|' || split_part(identifier, ':', 2) AS jurisdiction, split_part(identifier, ':', 5) AS case_number,
  'none' AS procedures, 'none' AS "references", 'none' AS relation FROM archived""")
oracle("text_fallback", with_(CASES, ARCHIVED) + f"""
SELECT identifier, missing_parts, md5(d) AS description_md5, coalesce({wc('d')}, 0) AS desc_words FROM (
  SELECT identifier, missing_parts,
    CASE WHEN description <> 'none' THEN {PARAS.format(x='description')} END AS d FROM archived)""")
oracle("write_per_archive", with_(CASES, ARCHIVED) + """
SELECT year, month, CAST(count(*) AS BIGINT) AS n FROM archived GROUP BY year, month""")
oracle("incremental_replacement", with_(CASES, ARCHIVED) + "SELECT identifier, year, month, missing_parts FROM archived")
oracle("incremental_ingest", with_(CASES, ARCHIVED) + "SELECT identifier, year, month, missing_parts FROM archived")


# --- what sinks and streams give back ---------------------------------------------
oracle("csv_write", with_(CASES) + "SELECT doc_id AS row_index, identifier, class, n_chars FROM cases")
oracle("curve_scan", with_(CURVES) + """
SELECT run, tag, CAST(n AS DOUBLE) AS wall_time, CAST(epoch AS BIGINT) AS step, loss AS value
FROM curves, (VALUES ('train_loss'), ('eval_loss')) AS t(tag)""")
oracle("split_write", with_(CASES, SPLIT) + "SELECT split, CAST(count(*) AS BIGINT) AS n FROM split_case GROUP BY split")
oracle("cluster_split_write", with_(CASES, SPLIT) + "SELECT split, class, CAST(count(*) AS BIGINT) AS n FROM split_case GROUP BY split, class")
oracle("incremental_decade_rollup", ORACLES["decade_rollup"])

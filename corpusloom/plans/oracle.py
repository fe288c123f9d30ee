"""Independent DuckDB SQL for every named query that SQL can express.

The tables ``region nation customer supplier part orders lineitem events
documents embeddings pages benchmark labels conversations`` are views.  The
derived inputs of FIXTURES.md are re-stated here as CTEs, so the oracle
shares no code with the Spark side, only fixed patterns and code tables.  DuckDB lambdas use ``lambda x: ...``.
"""

from __future__ import annotations

from importlib.util import find_spec

from corpusloom.functions.text import ALNUM_CLASS, WS_CHARS, WS_CLASS
from corpusloom.functions.tokens import TOKEN_PATTERN


def _sql_str(s: str) -> str:
    """Quote a Python string as a DuckDB string literal (no backslash
    escapes in standard SQL strings; control characters via chr())."""
    parts, buf = [], []
    for ch in s:
        if ch == "'" or ord(ch) < 32 or ord(ch) > 126:
            if buf:
                parts.append("'" + "".join(buf) + "'")
                buf = []
            parts.append("''''" if ch == "'" else f"chr({ord(ch)})")
        else:
            buf.append(ch)
    if buf:
        parts.append("'" + "".join(buf) + "'")
    return "(" + " || ".join(parts) + ")" if len(parts) > 1 else (parts[0] if parts else "''")


WS = _sql_str(WS_CHARS)
WSRE = WS_CLASS
TOKRE = TOKEN_PATTERN
ALNUM = ALNUM_CLASS


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{WSRE}]+'), lambda w: w <> '')"


def alnum(x: str) -> str:
    return f"regexp_replace({x}, '[^{ALNUM}]', '', 'g')"


def r9(x: str, d: int = 9) -> str:
    return f"round(CAST({x} AS DOUBLE), {d})"


# ---------------------------------------------------------------- derived inputs
VOTES = """votes AS (
  SELECT user_id, CAST(floor((day(ts) - 1) / 7) AS INTEGER) AS week,
         CAST(count_if(event_type = 'purchase') AS INTEGER) AS bullish,
         CAST(count_if(event_type = 'error') AS INTEGER) AS bearish,
         CAST(count_if(event_type = 'click') AS INTEGER) AS liked,
         CAST(count_if(event_type = 'view') AS INTEGER) AS disliked,
         CAST(count_if(event_type = 'signup') AS INTEGER) AS important,
         CAST(count_if(value > 100) AS INTEGER) AS lol
  FROM events GROUP BY 1, 2)"""

MKT = """mkt AS (
  SELECT user_id, week, bearish, bullish,
         CAST(bullish AS DOUBLE) / NULLIF(bearish + bullish, 0) * 100 AS bullish_pct,
         CAST(bearish AS DOUBLE) / NULLIF(bearish + bullish, 0) * 100 AS bearish_pct
  FROM votes)"""

PAIRS = [("market_direction", "bearish", "bullish", ["neutral", "bearish", "bullish"]),
         ("engagement_quality", "disliked", "liked", ["neutral", "liked", "disliked"]),
         ("content_characteristics", "lol", "important", ["neutral", "important", "lol"])]


def _label_case(v: str, lo: str, hi: str, low_label: str, high_label: str) -> str:
    return (f"CASE WHEN {v} >= {hi} THEN '{high_label}' WHEN {v} <= {lo} THEN '{low_label}' "
            f"ELSE 'neutral' END")


def _id_case(col: str, labels: list[str]) -> str:
    whens = " ".join(f"WHEN {col} = '{lab}' THEN {i}" for i, lab in enumerate(labels))
    return f"CAST(CASE {whens} END AS INTEGER)"


def _vote_quantile_labels() -> str:
    pct = ",\n  ".join(
        f"CAST({c} AS DOUBLE) / NULLIF({neg} + {pos}, 0) * 100 AS {c}_pct"
        for _n, neg, pos, _l in PAIRS for c in (neg, pos))
    q = ", ".join(f"quantile_cont({pos}_pct, 0.25) AS {n}_p25, quantile_cont({pos}_pct, 0.75) AS {n}_p75"
                  for n, _neg, pos, _l in PAIRS)
    lab = ",\n  ".join(
        f"{_label_case(pos + '_pct', 'q.' + n + '_p25', 'q.' + n + '_p75', neg, pos)} AS {n}"
        for n, neg, pos, _l in PAIRS)
    return f"""WITH {VOTES},
p AS (SELECT *, CAST(bearish + bullish + liked + disliked + important + lol AS INTEGER) AS total_votes,
  CAST(bearish + bullish AS INTEGER) AS pair_votes_market_direction,
  CAST(disliked + liked AS INTEGER) AS pair_votes_engagement_quality,
  CAST(lol + important AS INTEGER) AS pair_votes_content_characteristics,
  {pct} FROM votes),
q AS (SELECT {q} FROM p),
l AS (SELECT p.*, {lab} FROM p, q)
SELECT user_id, week, bearish, bullish, liked, disliked, important, lol, total_votes,
  pair_votes_market_direction, pair_votes_engagement_quality, pair_votes_content_characteristics,
  {", ".join(f"{r9(c + '_pct')} AS {c}_pct" for _n, neg, pos, _l in PAIRS for c in (neg, pos))},
  {", ".join(f"{n}, {_id_case(n, labs)} AS {n}_id" for n, _a, _b, labs in PAIRS)}
FROM l"""


ORACLE: dict[str, str] = {}

ORACLE["vote_quantile_labels"] = _vote_quantile_labels()

ORACLE["vote_quality_filter"] = f"""WITH {VOTES},
t AS (SELECT *, CAST(bearish + bullish + liked + disliked + important + lol AS INTEGER) AS total_votes,
        bearish + bullish AS m, liked + disliked AS e, important + lol AS c FROM votes),
pos AS (SELECT * FROM t WHERE total_votes > 0),
med AS (SELECT least(median(m), median(e), median(c)) AS mm FROM pos)
SELECT user_id, week, bearish, bullish, liked, disliked, important, lol, total_votes
FROM pos, med WHERE total_votes >= mm"""

ORACLE["vote_rank_labels"] = f"""WITH {VOTES}, {MKT},
vc AS (SELECT bullish_pct, count(*) AS c FROM mkt WHERE bullish_pct IS NOT NULL GROUP BY 1),
rk AS (SELECT bullish_pct,
         (coalesce(sum(c) OVER (ORDER BY bullish_pct ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          + (c + 1) / 2.0) / (SELECT sum(c) FROM vc) * 100 AS sentiment_rank FROM vc),
r AS (SELECT m.user_id, m.week, m.bullish_pct, rk.sentiment_rank FROM mkt m LEFT JOIN rk USING (bullish_pct))
SELECT user_id, week, {r9('bullish_pct')} AS bullish_pct, {r9('sentiment_rank')} AS sentiment_rank,
  {_label_case('sentiment_rank', '25', '75', 'bearish', 'bullish')} AS rank_label FROM r"""

ORACLE["vote_zscore_labels"] = f"""WITH {VOTES}, {MKT},
r AS (SELECT *, CAST(bullish AS DOUBLE) / (bearish + 1) AS sentiment_ratio FROM mkt),
s AS (SELECT avg(sentiment_ratio) AS mu, stddev_pop(sentiment_ratio) AS sd FROM r),
z AS (SELECT r.*, CASE WHEN s.sd = 0 THEN NULL ELSE (sentiment_ratio - s.mu) / s.sd END AS sentiment_z_score FROM r, s)
SELECT user_id, week, {r9('sentiment_ratio')} AS sentiment_ratio, {r9('sentiment_z_score')} AS sentiment_z_score,
  CASE WHEN sentiment_z_score <= -0.67 THEN 'bearish' WHEN sentiment_z_score >= 0.67 THEN 'bullish'
       ELSE 'neutral' END AS zscore_label FROM z"""

ORACLE["vote_minmax_labels"] = f"""WITH {VOTES}, {MKT},
s AS (SELECT min(bullish_pct) AS lo, max(bullish_pct) AS hi FROM mkt),
m AS (SELECT mkt.*, CASE WHEN bullish_pct IS NULL THEN NULL WHEN hi - lo = 0 THEN 0.0
                         ELSE (bullish_pct - lo) / (hi - lo) END AS bullish_pct_scaled FROM mkt, s)
SELECT user_id, week, {r9('bullish_pct')} AS bullish_pct, {r9('bullish_pct_scaled')} AS bullish_pct_scaled,
  {_label_case('bullish_pct_scaled', '0.25', '0.75', 'bearish', 'bullish')} AS minmax_label FROM m"""

ORACLE["label_distribution"] = f"""WITH {VOTES}, {MKT},
q AS (SELECT quantile_cont(bullish_pct, 0.25) AS p25, quantile_cont(bullish_pct, 0.75) AS p75 FROM mkt),
l AS (SELECT {_label_case('bullish_pct', 'p25', 'p75', 'bearish', 'bullish')} AS market_direction FROM mkt, q)
SELECT market_direction, count(*) AS count, {r9('count(*) * 100.0 / (SELECT count(*) FROM l)')} AS percent,
  {_id_case('market_direction', PAIRS[0][3])} AS market_direction_id
FROM l GROUP BY market_direction"""

ORACLE["struct_pack_unpack"] = f"""WITH {VOTES}
SELECT user_id, week, bearish, bullish, liked, disliked, important, lol FROM votes"""

ORACLE["vote_pair_study"] = f"""WITH {VOTES}, {MKT},
v AS (SELECT *, bullish + bearish AS votes_mkt FROM mkt),
f AS (SELECT * FROM v WHERE votes_mkt >= (SELECT median(votes_mkt) FROM v))
SELECT week, CAST(sum(bullish) AS BIGINT) AS sum_bullish, CAST(sum(bearish) AS BIGINT) AS sum_bearish,
  {r9('median(votes_mkt)')} AS median_votes, {r9('avg(abs(bullish_pct - bearish_pct))')} AS avg_diff,
  count(*) AS n
FROM f GROUP BY week"""


# ------------------------------------------------------------------ joins
META = """meta AS (
  SELECT CAST(doc_id AS VARCHAR) AS key, doc_id, quality,
         CASE WHEN doc_id % 7 = 0 THEN NULL ELSE toxic END AS toxic, 0 AS ord,
         CAST(CASE WHEN doc_id % 17 = 0 THEN 1 END AS INTEGER) AS remove FROM labels
  UNION ALL
  SELECT CAST(doc_id AS VARCHAR), doc_id, 1 - quality,
         CASE WHEN doc_id % 7 = 0 THEN NULL ELSE toxic END, 1,
         CAST(CASE WHEN doc_id % 17 = 0 THEN 1 END AS INTEGER) FROM labels WHERE doc_id % 10 = 0
  UNION ALL
  SELECT CAST(doc_id + 1000000 AS VARCHAR), doc_id, quality,
         CASE WHEN doc_id % 7 = 0 THEN NULL ELSE toxic END, 0,
         CAST(CASE WHEN doc_id % 17 = 0 THEN 1 END AS INTEGER) FROM labels WHERE doc_id % 13 = 0)"""

META_FIRST = """meta_first AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord, doc_id) AS rn FROM meta) WHERE rn = 1)"""
META_LAST = """meta_last AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord DESC, doc_id DESC) AS rn FROM meta) WHERE rn = 1)"""
DOCS_FIRST = """docs_first AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1)"""

ORACLE["dedup_text_first"] = f"WITH {DOCS_FIRST} SELECT doc_id, lang, n_chars FROM docs_first"
ORACLE["dedup_key_last"] = f"WITH {META}, {META_LAST} SELECT key, doc_id, quality, toxic, ord, remove FROM meta_last"
ORACLE["dedup_key_first"] = f"WITH {META}, {META_FIRST} SELECT key, doc_id, quality, toxic, ord, remove FROM meta_first"
ORACLE["semi_both"] = """
SELECT 'documents' AS side, doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL
SELECT 'labels' AS side, doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)"""
ORACLE["anti_removals"] = f"""WITH {META}
SELECT key, doc_id, ord, quality FROM meta m
WHERE NOT EXISTS (SELECT 1 FROM meta r WHERE r.remove = 1 AND r.key = m.key)"""
ORACLE["inner_join_metadata"] = f"""WITH {META}, {META_LAST}
SELECT CAST(d.doc_id AS VARCHAR) AS key, d.lang, d.source,
  coalesce(CAST(m.doc_id AS VARCHAR), '') AS doc_id, coalesce(CAST(m.quality AS VARCHAR), '') AS quality,
  coalesce(CAST(m.toxic AS VARCHAR), '') AS toxic, coalesce(CAST(m.ord AS VARCHAR), '') AS ord,
  coalesce(CAST(m.remove AS VARCHAR), '') AS remove
FROM documents d JOIN meta_last m ON CAST(d.doc_id AS VARCHAR) = m.key"""
ORACLE["left_join_suffix"] = f"""WITH {META}
SELECT m.key, m.doc_id, m.quality, m.toxic, m.ord,
  coalesce(l.quality, 0) AS quality_pos, coalesce(l.toxic, 0) AS toxic_pos
FROM meta m LEFT JOIN labels l ON m.doc_id IS NOT DISTINCT FROM l.doc_id"""
ORACLE["merge_precedence"] = f"""WITH {META}, {META_FIRST}, {DOCS_FIRST}
SELECT CAST(d.doc_id AS VARCHAR) AS key, d.doc_id, d.lang, d.n_chars, m.ord, m.quality, m.remove,
  d.source, m.toxic
FROM docs_first d JOIN meta_first m ON CAST(d.doc_id AS VARCHAR) = m.key"""
ORACLE["join_reconciliation"] = f"""WITH {META},
lk AS (SELECT CAST(doc_id AS VARCHAR) AS key, count(*) AS ln FROM documents GROUP BY 1),
rk AS (SELECT key, count(*) AS rn FROM meta GROUP BY 1),
j AS (SELECT ln, rn FROM lk FULL OUTER JOIN rk USING (key))
SELECT CAST(coalesce(sum(ln), 0) AS BIGINT) AS left_rows, CAST(coalesce(sum(rn), 0) AS BIGINT) AS right_rows,
  count(ln) AS left_keys, count(rn) AS right_keys,
  count_if(ln IS NOT NULL AND rn IS NOT NULL) AS common_keys, count_if(rn IS NULL) AS left_only_keys,
  count_if(ln IS NULL) AS right_only_keys, count_if(ln > 1) AS left_dup_keys,
  count_if(rn > 1) AS right_dup_keys
FROM j"""

DATED = """dated AS (
  SELECT doc_id, text, lang, source,
    ['social', 'patents', 'literature'][doc_id % 3 + 1] AS corpus,
    CASE WHEN doc_id % 97 = 0 THEN 'bad' || CAST(doc_id AS VARCHAR)
         WHEN doc_id % 89 = 0 THEN '1999-01-01'
         WHEN doc_id % 50 = 0 AND doc_id % 3 = 2 THEN NULL
         ELSE CAST(2013 + floor(doc_id / 3) % 12 AS BIGINT)::VARCHAR || '-0'
              || CAST(1 + doc_id % 9 AS VARCHAR) || '-01' END AS date_text
  FROM documents)"""

ORACLE["review_roundtrip"] = f"""WITH {META}, {META_FIRST}, {DATED},
papers AS (SELECT CAST(doc_id AS VARCHAR) AS key, doc_id, corpus,
    CASE WHEN length(split_part(date_text, '-', 1)) = 4
         THEN TRY_CAST(TRY_CAST(split_part(date_text, '-', 1) AS DOUBLE) AS INTEGER) END AS year
  FROM dated),
decisions AS (
  SELECT p.key, f.remove FROM papers p LEFT JOIN meta_first f USING (key) WHERE p.year <= 2008
  UNION ALL
  SELECT p.key, f.remove FROM papers p LEFT JOIN meta_first f USING (key) WHERE p.year > 2008)
SELECT * FROM papers WHERE key NOT IN (SELECT key FROM decisions WHERE remove = 1)"""


# ------------------------------------------------------------- vocabulary
def toks(x: str) -> str:
    return f"regexp_extract_all({x}, '{TOKRE}')"


def clean(w: str) -> str:
    return f"lower({alnum(w)})"


CORPORA = """corpora AS (
  SELECT lang AS corpus, doc_id, text FROM documents
  UNION ALL SELECT 'benchmark' AS corpus, item_id AS doc_id, text FROM benchmark)"""
TT = f"""tt AS (SELECT corpus, token, count(*) AS cnt FROM (
  SELECT corpus, unnest({toks('text')}) AS token FROM corpora) GROUP BY corpus, token)"""
TOT = """tot AS (SELECT corpus, CAST(sum(cnt) AS BIGINT) AS total_tokens, count(*) AS unique_tokens,
  CAST(sum(cnt) AS DOUBLE) / count(*) AS avg_freq FROM tt GROUP BY corpus)"""
TTR = "ttr AS (SELECT corpus, CAST(unique_tokens AS DOUBLE) / total_tokens AS ttr FROM tot)"
VOCAB = f"""vocab AS (
  SELECT DISTINCT term FROM (
    SELECT {alnum('w')} AS term FROM (SELECT unnest({words('lower(text)')}) AS w FROM benchmark)) t
  WHERE length(term) >= 6
  UNION SELECT unnest(['two words', 'UPPER', 'hy-phen']) AS term)"""
HITS = f"""cw AS (SELECT corpus, doc_id, {clean('w')} AS term FROM (
  SELECT corpus, doc_id, unnest({words('lower(text)')}) AS w FROM corpora)),
hits AS (SELECT corpus, doc_id, term, count(*) AS n FROM cw WHERE term IN (SELECT term FROM vocab)
  GROUP BY corpus, doc_id, term)"""
KD = f"""found AS (SELECT corpus, sum(n) AS total_occurrences, count(DISTINCT term) AS unique_found,
  count(DISTINCT doc_id) AS docs_with_keywords FROM hits GROUP BY corpus),
base AS (SELECT corpus, sum(len({words('lower(text)')})) AS total_words, count(*) AS n_docs FROM corpora GROUP BY corpus),
vs AS (SELECT count(*) AS n FROM vocab),
mt AS (SELECT count(*) AS n FROM vocab WHERE term = {clean('term')} AND length(term) > 0),
kd AS (SELECT b.corpus, CAST(b.total_words AS BIGINT) AS total_words, b.n_docs,
  CAST(coalesce(f.total_occurrences, 0) AS BIGINT) AS total_occurrences,
  CAST(coalesce(f.unique_found, 0) AS BIGINT) AS unique_found,
  CAST(coalesce(f.docs_with_keywords, 0) AS BIGINT) AS docs_with_keywords,
  vs.n AS vocab_size, mt.n AS matchable_terms,
  CASE WHEN b.total_words > 0 THEN CAST(coalesce(f.total_occurrences, 0) AS DOUBLE) / b.total_words * 1000
       ELSE 0.0 END AS density_per_1k,
  CAST(coalesce(f.unique_found, 0) AS DOUBLE) / vs.n * 100 AS coverage,
  CASE WHEN b.n_docs > 0 THEN CAST(coalesce(f.docs_with_keywords, 0) AS DOUBLE) / b.n_docs * 100
       ELSE 0.0 END AS doc_coverage
  FROM base b LEFT JOIN found f USING (corpus), vs, mt)"""
BPAIRS = """bpairs AS (SELECT DISTINCT corpus AS domain, 'benchmark' AS baseline FROM tt WHERE corpus <> 'benchmark')"""
ENR = """ctot AS (SELECT corpus, sum(cnt) AS total FROM tt GROUP BY corpus),
enr AS (SELECT p.domain, p.baseline, d.token, d.cnt AS cd, td.total AS td,
    (CAST(d.cnt AS DOUBLE) / td.total) / (CAST(coalesce(b.cnt, 1) AS DOUBLE) / tb.total) AS enrichment
  FROM bpairs p JOIN tt d ON d.corpus = p.domain JOIN ctot td ON td.corpus = p.domain
  LEFT JOIN tt b ON b.corpus = p.baseline AND b.token = d.token JOIN ctot tb ON tb.corpus = p.baseline),
ranked AS (SELECT *, row_number() OVER (PARTITION BY domain, baseline ORDER BY enrichment DESC, token) AS rank FROM enr)"""
CONC = """conc AS (SELECT domain, baseline, count(*) AS top_n,
  CAST(sum(cd) AS DOUBLE) / max(td) * 100 AS concentration FROM ranked WHERE rank <= 1000 GROUP BY domain, baseline)"""


def _js(pairs_cte: str) -> str:
    return f"""{pairs_cte},
sh AS (SELECT p.corpus_a, p.corpus_b, a.token, a.cnt AS ca, b.cnt AS cb FROM pairs p
  JOIN tt a ON a.corpus = p.corpus_a JOIN tt b ON b.corpus = p.corpus_b AND b.token = a.token),
ss AS (SELECT corpus_a, corpus_b, sum(ca) AS sa, sum(cb) AS sb FROM sh GROUP BY corpus_a, corpus_b),
pq AS (SELECT sh.corpus_a, sh.corpus_b, CAST(ca AS DOUBLE) / sa AS p, CAST(cb AS DOUBLE) / sb AS q
  FROM sh JOIN ss USING (corpus_a, corpus_b)),
jsd AS (SELECT corpus_a, corpus_b,
  sqrt(greatest(0.0, (sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2)) AS js_distance,
  count(*) AS shared_tokens FROM pq GROUP BY corpus_a, corpus_b),
js AS (SELECT p.corpus_a, p.corpus_b, coalesce(jsd.js_distance, 1.0) AS js_distance,
  CAST(coalesce(jsd.shared_tokens, 0) AS BIGINT) AS shared_tokens FROM pairs p LEFT JOIN jsd USING (corpus_a, corpus_b))"""


def rhe(x: str, d: int = 3) -> str:
    f = 10 ** d
    return f"(round_even(CAST({x} AS DOUBLE) * {f}.0, 0) / {f}.0)"


ORACLE["token_counts"] = f"""SELECT doc_id, lang,
  CAST(coalesce(len({toks('text')}), 0) + 2 AS BIGINT) AS total_tokens FROM documents"""

ORACLE["corpus_size"] = f"""WITH {DATED},
d AS (SELECT corpus, coalesce(len({toks('text')}), 0) + 2 AS t FROM dated),
s AS (SELECT count(*) AS n, sum(t) AS tt FROM d)
SELECT corpus, count(*) AS documents, CAST(sum(t) AS BIGINT) AS tokens, {r9('avg(t)')} AS avg_tokens,
  {r9('CAST(count(*) AS DOUBLE) / max(s.n) * 100')} AS doc_share,
  {r9('CAST(sum(t) AS DOUBLE) / max(s.tt) * 100')} AS token_share
FROM d, s GROUP BY corpus"""

ORACLE["vocab_stats"] = f"""WITH {CORPORA}, {TT}, {TOT}, {TTR}
SELECT tot.corpus, total_tokens, unique_tokens, {r9('avg_freq')} AS avg_freq, {r9('coalesce(ttr, 0.0)')} AS ttr
FROM tot LEFT JOIN ttr USING (corpus)"""

ORACLE["js_distance"] = f"""WITH {CORPORA}, {TT}, {_js('''pairs AS (SELECT a.corpus AS corpus_a, b.corpus AS corpus_b
  FROM (SELECT DISTINCT corpus FROM tt) a JOIN (SELECT DISTINCT corpus FROM tt) b ON a.corpus < b.corpus)''')}
SELECT corpus_a, corpus_b, {r9('js_distance')} AS js_distance, shared_tokens FROM js"""

ORACLE["domain_concentration"] = f"""WITH {CORPORA}, {TT}, {BPAIRS}, {ENR}, {CONC}
SELECT domain, baseline, top_n, {r9('concentration')} AS concentration FROM conc"""

ORACLE["enriched_tokens"] = f"""WITH {CORPORA}, {TT}, {BPAIRS}, {ENR}
SELECT domain, baseline, CAST(rank AS INTEGER) AS rank, token, {r9('enrichment')} AS enrichment, cd AS cnt
FROM ranked WHERE rank <= 25"""

ORACLE["keyword_density"] = f"""WITH {CORPORA}, {VOCAB}, {HITS}, {KD}
SELECT corpus, total_words, n_docs, total_occurrences, unique_found, docs_with_keywords, vocab_size,
  matchable_terms, {r9('density_per_1k')} AS density_per_1k, {r9('coverage')} AS coverage,
  {r9('doc_coverage')} AS doc_coverage FROM kd"""

ORACLE["top_keywords"] = f"""WITH {CORPORA}, {VOCAB}, {HITS},
c AS (SELECT corpus, term, CAST(sum(n) AS BIGINT) AS cnt FROM hits GROUP BY corpus, term)
SELECT corpus, term, cnt, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY cnt DESC, term) AS rank FROM c) WHERE rank <= 20"""

ORACLE["corpus_keyword_profile"] = f"""WITH {CORPORA}, {TT}, {TOT}, {TTR}, {VOCAB}, {HITS}, {KD}
SELECT kd.corpus, n_docs, total_words, {r9('density_per_1k')} AS density_per_1k, {r9('coverage')} AS coverage,
  {r9('doc_coverage')} AS doc_coverage, total_tokens, unique_tokens, {r9('avg_freq')} AS avg_freq,
  {r9('coalesce(ttr, 0.0)')} AS ttr
FROM kd JOIN tot USING (corpus) LEFT JOIN ttr USING (corpus)"""

ORACLE["corpus_summary"] = f"""WITH {CORPORA}, {TT}, {TOT}, {TTR}, {VOCAB}, {HITS}, {KD}, {BPAIRS}, {ENR}, {CONC},
{_js('pairs AS (SELECT domain AS corpus_a, baseline AS corpus_b FROM bpairs)')}
SELECT tot.corpus, total_tokens, unique_tokens, {rhe('avg_freq')} AS avg_freq, {rhe('ttr')} AS ttr,
  {rhe('kd.density_per_1k')} AS density_per_1k, {rhe('kd.doc_coverage')} AS doc_coverage,
  {rhe('js.js_distance')} AS js_vs_benchmark, {rhe('conc.concentration')} AS concentration_vs_benchmark
FROM tot LEFT JOIN ttr USING (corpus) LEFT JOIN kd USING (corpus)
  LEFT JOIN js ON js.corpus_a = tot.corpus LEFT JOIN conc ON conc.domain = tot.corpus"""

ORACLE["corpus_class_means"] = f"""WITH {CORPORA}, {TT}, {TOT}, {TTR}, {VOCAB}, {HITS}, {KD},
st AS (SELECT tot.corpus, ttr.ttr, kd.density_per_1k,
  CASE WHEN tot.corpus = 'benchmark' THEN 'general' ELSE 'domain' END AS corpus_class
  FROM tot LEFT JOIN ttr USING (corpus) JOIN kd USING (corpus)),
g AS (SELECT corpus_class, avg(ttr) AS mean_ttr, avg(density_per_1k) AS mean_density FROM st GROUP BY corpus_class),
gen AS (SELECT mean_ttr AS t, mean_density AS d FROM g WHERE corpus_class = 'general')
SELECT corpus_class, {r9('mean_ttr')} AS mean_ttr, {r9('mean_density')} AS mean_density,
  {r9('CASE WHEN gen.t = 0 THEN NULL ELSE mean_ttr / gen.t END')} AS ttr_ratio,
  {r9('CASE WHEN gen.d = 0 THEN NULL ELSE mean_density / gen.d END')} AS density_ratio
FROM g, gen"""


# ----------------------------------------------------------------- trends
DATED_YEARS = f"""{DATED},
dy AS (SELECT *, CASE
    WHEN corpus = 'literature' THEN (CASE WHEN split_part(date_text, '-', 1) IS NOT NULL
         THEN TRY_CAST(TRY_CAST(split_part(date_text, '-', 1) AS DOUBLE) AS INTEGER) END)
    ELSE (CASE WHEN length(split_part(date_text, '-', 1)) = 4 AND starts_with(split_part(date_text, '-', 1), '2')
         THEN TRY_CAST(TRY_CAST(split_part(date_text, '-', 1) AS DOUBLE) AS INTEGER) END) END AS year
  FROM dated),
dyv AS (SELECT * FROM dy WHERE year IS NOT NULL)"""

_TERMS = ["tion", "ment", " der ", " und ", "eau", "qxz"]


def _yearly_mentions() -> str:
    flags = {f"contains_{t}": f"contains(lower(text), '{t}')" for t in _TERMS}
    flags["contains_tion_or_ment"] = "(" + flags.pop("contains_tion") + " OR " + flags.pop("contains_ment") + ")"
    aggs = ", ".join(f"avg(CAST({e} AS INTEGER)) AS \"{k}\"" for k, e in flags.items())
    cols = ", ".join(f'"{k}"' for k in flags)
    return f"""WITH {DATED_YEARS},
wide AS (SELECT corpus, year, {aggs} FROM dyv GROUP BY corpus, year),
longt AS (UNPIVOT wide ON {cols} INTO NAME term VALUE rate),
nser AS (SELECT count(DISTINCT corpus) AS n FROM longt),
common AS (SELECT term, year FROM longt GROUP BY term, year HAVING count(DISTINCT corpus) = (SELECT n FROM nser)),
al AS (SELECT l.corpus, l.term, l.year, greatest(l.rate, 0.0) AS rate FROM longt l JOIN common c USING (term, year)),
fr AS (SELECT *, min(CASE WHEN rate > 0.0001 THEN year END) OVER (PARTITION BY corpus, term) AS first FROM al)
SELECT corpus, year, term, {r9('rate')} AS rate FROM fr WHERE year >= first"""


ORACLE["yearly_mentions"] = _yearly_mentions()

ORACLE["sentiment_share"] = f"""WITH {DATED_YEARS},
j AS (SELECT d.year, CASE WHEN l.toxic = 1 THEN 'bearish' WHEN l.quality = 1 THEN 'bullish' ELSE 'neutral' END
        AS sentiment_label FROM dyv d JOIN labels l USING (doc_id) WHERE d.corpus = 'social'),
c AS (SELECT year, sentiment_label, count(*) AS count FROM j GROUP BY year, sentiment_label)
SELECT year, sentiment_label, count, {r9('CAST(count AS DOUBLE) / sum(count) OVER (PARTITION BY year) * 100')} AS percent
FROM c"""

ORACLE["market_yearly"] = f"""WITH m AS (SELECT epoch_ms(o_orderdate) AS snapped_at, o_totalprice * 1e6 AS market_cap FROM orders)
SELECT year(epoch_ms(snapped_at)) AS year, {r9('median(market_cap) / 1e9')} AS market_cap FROM m
GROUP BY year(epoch_ms(snapped_at))"""

ORACLE["counts_before"] = """WITH c AS (SELECT year(o_orderdate) AS year, count(*) AS cnt FROM orders GROUP BY 1)
SELECT CAST(coalesce(sum(CASE WHEN year < 1998 THEN cnt END), 0) AS BIGINT) AS before,
  CAST(coalesce(sum(CASE WHEN year BETWEEN 1998 AND 2000 THEN cnt END), 0) AS BIGINT) AS within,
  CAST(coalesce(sum(CASE WHEN year > 2000 THEN cnt END), 0) AS BIGINT) AS after,
  CAST(coalesce(sum(CASE WHEN year IS NULL THEN cnt END), 0) AS BIGINT) AS undated FROM c"""

ORACLE["lag_correlation"] = f"""WITH
a AS (SELECT year(l_shipdate) * 100 + month(l_shipdate) AS period, count(*) AS activity FROM lineitem GROUP BY 1),
b AS (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS period, median(o_totalprice) AS price FROM orders GROUP BY 1),
j AS (SELECT period, activity, price, row_number() OVER (ORDER BY period) - 1 AS pos FROM a JOIN b USING (period)),
lags AS (SELECT unnest(range(-5, 6)) AS lag),
xs AS (SELECT j.pos AS pos_x, j.activity AS x, lags.lag FROM j, lags),
pr AS (SELECT xs.lag, xs.x, y.price AS y FROM xs JOIN j y ON y.pos = xs.pos_x - xs.lag),
rk AS (SELECT lag,
  rank() OVER (PARTITION BY lag ORDER BY x) + (count(*) OVER (PARTITION BY lag, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY lag ORDER BY y) + (count(*) OVER (PARTITION BY lag, y) - 1) / 2.0 AS ry FROM pr)
SELECT CAST(lag AS INTEGER) AS lag, count(*) AS n, {r9('corr(rx, ry)')} AS spearman_correlation FROM rk GROUP BY lag"""


# ------------------------------------------------------------- evaluation
PREDS = """preds AS (SELECT doc_id, list_transform(range(doc_id % 5), lambda i: {
    'entity_group': ['ESG', 'Consensus', 'Identifiers'][((doc_id + i) % 3) + 1],
    'score': 0.98 + ((doc_id * 37 + i * 101) % 2000) / 100000}) AS predictions FROM documents),
esc AS (SELECT doc_id, predictions, len(predictions) AS num_preds,
    list_transform(list_filter(predictions, lambda x: x.entity_group <> 'ESG'), lambda x: x.score) AS sc
  FROM preds),
pm0 AS (SELECT e.doc_id, coalesce(list_max(e.sc), 0.0) AS prediction_max, e.num_preds,
    coalesce(l.quality, 0) AS class FROM esc e LEFT JOIN labels l USING (doc_id))"""

ORACLE["entity_filter"] = f"""WITH {PREDS}
SELECT doc_id, CAST(num_preds AS INTEGER) AS num_preds, CAST(len(sc) AS INTEGER) AS n_scores,
  {r9('list_max(sc)')} AS prediction_max, {r9("list_aggregate(sc, 'median')")} AS prediction_median,
  true AS max_pred FROM esc WHERE list_max(sc) > 0.995"""

ORACLE["confusion"] = f"""WITH {PREDS},
d AS (SELECT coalesce(list_max(e.sc) > 0.995, false) AS p, coalesce(l.quality, 0) = 1 AS g
  FROM esc e LEFT JOIN labels l USING (doc_id))
SELECT count_if(NOT g AND NOT p) AS tn, count_if(NOT g AND p) AS fp, count_if(g AND NOT p) AS fn,
  count_if(g AND p) AS tp FROM d"""

ORACLE["threshold_sweep"] = f"""WITH {PREDS},
g AS (SELECT unnest(range(9900, 10001)) / 10000 AS t)
SELECT {r9('t')} AS threshold,
  {r9('CAST(sum(CASE WHEN (prediction_max > t) = (class = 1) THEN 1 ELSE 0 END) AS DOUBLE) / count(*)')} AS accuracy
FROM g, pm0 GROUP BY t"""

ORACLE["class_describe"] = f"""WITH {PREDS}
SELECT class, count(prediction_max) AS count, {r9('avg(prediction_max)')} AS mean,
  {r9('stddev_samp(prediction_max)')} AS std, {r9('min(prediction_max)')} AS min,
  {r9('quantile_cont(prediction_max, 0.25)')} AS p25, {r9('quantile_cont(prediction_max, 0.5)')} AS p50,
  {r9('quantile_cont(prediction_max, 0.75)')} AS p75, {r9('max(prediction_max)')} AS max
FROM pm0 GROUP BY class"""

ORACLE["class_box_stats"] = f"""WITH {PREDS},
q AS (SELECT class, quantile_cont(num_preds, 0.25) AS p25, quantile_cont(num_preds, 0.5) AS p50,
  quantile_cont(num_preds, 0.75) AS p75 FROM pm0 GROUP BY class),
j AS (SELECT p.num_preds AS v, q.*, q.p75 - q.p25 AS iqr FROM pm0 p JOIN q USING (class))
SELECT class, {r9('p25')} AS p25, {r9('p50')} AS p50, {r9('p75')} AS p75, {r9('iqr')} AS iqr,
  CAST(min(CASE WHEN v >= p25 - 1.5 * iqr THEN v END) AS INTEGER) AS whisker_low,
  CAST(max(CASE WHEN v <= p75 + 1.5 * iqr THEN v END) AS INTEGER) AS whisker_high,
  count_if(v < p25 - 1.5 * iqr OR v > p75 + 1.5 * iqr) AS outliers
FROM j GROUP BY class, p25, p50, p75, iqr"""

ORACLE["pct_histogram"] = f"""WITH {VOTES}, {MKT},
v AS (SELECT bullish_pct AS x FROM mkt WHERE bullish_pct IS NOT NULL),
s AS (SELECT min(x) AS lo, max(x) AS hi, count(x) AS n FROM v),
b AS (SELECT least(CASE WHEN hi = lo THEN 0 ELSE CAST(floor((x - lo) / ((hi - lo) / 10)) AS INTEGER) END, 9) AS bin,
  lo, (hi - lo) / 10 AS w, n FROM v, s)
SELECT bin, {r9('lo + bin * w')} AS bin_start, {r9('lo + (bin + 1) * w')} AS bin_end, count(*) AS count,
  {r9('CASE WHEN n * w = 0 THEN NULL ELSE count(*) / (n * w) END')} AS density
FROM b GROUP BY bin, lo, w, n"""

LOGITS = """lg AS (SELECT vec_id AS row_id, [list_sum([CAST(x AS DOUBLE) for x, i in embedding if (i - 1) % 10 = k]) for k in range(10)] AS logits, label FROM embeddings),
sm0 AS (SELECT row_id, label, list_transform(logits, lambda x: CAST(x AS DOUBLE)) AS a FROM lg),
sm1 AS (SELECT row_id, label, list_transform(a, lambda x: exp(x - list_max(a))) AS e FROM sm0),
sm AS (SELECT row_id, label, list_transform(e, lambda x: x / list_sum(e)) AS pr FROM sm1)"""

ORACLE["classification_report"] = f"""WITH {LOGITS},
pp AS (SELECT label AS y, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS p FROM lg),
pairs AS (SELECT y, p, count(*) AS n FROM pp GROUP BY y, p),
bt AS (SELECT y AS cls, sum(n) AS support, sum(CASE WHEN y = p THEN n END) AS tp FROM pairs GROUP BY y),
bp AS (SELECT p AS cls, sum(n) AS predicted FROM pairs GROUP BY p),
per AS (SELECT coalesce(bt.support, 0) AS support, coalesce(bt.tp, 0) AS tp, coalesce(bp.predicted, 0) AS predicted
  FROM bt FULL OUTER JOIN bp ON bt.cls = bp.cls),
m AS (SELECT *, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS pr,
  CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS rc FROM per),
m2 AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM m)
SELECT {r9('CAST(sum(tp) AS DOUBLE) / sum(support)')} AS accuracy,
  {r9('sum(pr * support) / sum(support)')} AS precision_weighted,
  {r9('sum(rc * support) / sum(support)')} AS recall_weighted,
  {r9('sum(f1 * support) / sum(support)')} AS f1_weighted,
  {r9('avg(pr)')} AS precision_macro, {r9('avg(rc)')} AS recall_macro, {r9('avg(f1)')} AS f1_macro FROM m2"""

ORACLE["roc_points"] = f"""WITH {LOGITS},
ex AS (SELECT label AS y, unnest(pr) AS score, unnest(range(len(pr))) AS cls FROM sm),
agg AS (SELECT cls, score, count_if(y = cls) AS pos, count_if(y <> cls) AS neg FROM ex GROUP BY cls, score),
tot AS (SELECT cls, sum(pos) AS P, sum(neg) AS N FROM agg GROUP BY cls),
cum AS (SELECT cls, score,
  sum(pos) OVER (PARTITION BY cls ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
  sum(neg) OVER (PARTITION BY cls ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM agg)
SELECT CAST(cls AS INTEGER) AS cls, {r9('score')} AS threshold,
  {r9('CASE WHEN P = 0 THEN NULL ELSE cp / P END')} AS tpr,
  {r9('CASE WHEN N = 0 THEN NULL ELSE cn / N END')} AS fpr FROM cum JOIN tot USING (cls)"""

ORACLE["prediction_summary"] = f"""WITH {LOGITS},
top AS (SELECT 'class_' || CAST(list_position(pr, list_max(pr)) - 1 AS VARCHAR) AS sentiment_label,
  round(list_max(pr), 9) AS s FROM sm),
b AS (SELECT sentiment_label, CASE WHEN s IS NULL THEN NULL WHEN s > 0.9 THEN 'high' WHEN s > 0.7 THEN 'medium'
  ELSE 'low' END AS confidence_level FROM top)
SELECT sentiment_label, confidence_level, count(*) AS count,
  {r9('CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM b) * 100')} AS percent
FROM b GROUP BY sentiment_label, confidence_level"""


def _spans(src: str, tag: str, strict: bool, name: str) -> str:
    typ = "regexp_replace(tag, '^.*-', '')"
    if strict:
        return f"""{name}_a AS (SELECT doc, pos, {tag} AS tag,
    last_value(CASE WHEN {tag} NOT LIKE 'I-%' THEN {tag} END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lni FROM {src}),
{name}_b AS (SELECT *, tag LIKE 'B-%' OR (tag LIKE 'I-%' AND coalesce(lni LIKE 'B-%'
    AND regexp_replace(lni, '^.*-', '') = {typ}, false)) AS inside, tag LIKE 'B-%' AS st FROM {name}_a),
{name}_c AS (SELECT *, sum(CASE WHEN st AND inside THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM {name}_b),
{name} AS (SELECT doc, min(pos) AS s, max(pos) AS e, first({typ}) AS typ FROM {name}_c WHERE inside GROUP BY doc, sid)"""
    return f"""{name}_a AS (SELECT doc, pos, {tag} AS tag,
    lag({tag}) OVER (PARTITION BY doc ORDER BY pos) AS prev FROM {src}),
{name}_b AS (SELECT *, tag LIKE 'B-%' OR tag LIKE 'I-%' AS inside,
    tag LIKE 'B-%' OR (tag LIKE 'I-%' AND (prev IS NULL OR prev = 'O'
      OR regexp_replace(prev, '^.*-', '') <> {typ})) AS st FROM {name}_a),
{name}_c AS (SELECT *, sum(CASE WHEN st AND inside THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM {name}_b),
{name} AS (SELECT doc, min(pos) AS s, max(pos) AS e, first({typ}) AS typ FROM {name}_c WHERE inside GROUP BY doc, sid)"""


def _span_report() -> str:
    parts = []
    for mode, strict in (("strict", True), ("lenient", False)):
        parts.append(_spans("tk", "gold", strict, f"{mode}_g"))
        parts.append(_spans("tk", "pred", strict, f"{mode}_p"))
        parts.append(f"""{mode} AS (SELECT count(g.doc) AS gold_n, count(p.doc) AS pred_n,
  count_if(g.doc IS NOT NULL AND p.doc IS NOT NULL) AS tp
  FROM {mode}_g g FULL OUTER JOIN {mode}_p p ON g.doc = p.doc AND g.s = p.s AND g.e = p.e AND g.typ = p.typ)""")
    sel = []
    for mode in ("strict", "lenient"):
        pr = f"CASE WHEN {mode}.pred_n > 0 THEN CAST({mode}.tp AS DOUBLE) / {mode}.pred_n ELSE 0.0 END"
        rc = f"CASE WHEN {mode}.gold_n > 0 THEN CAST({mode}.tp AS DOUBLE) / {mode}.gold_n ELSE 0.0 END"
        f1 = f"CASE WHEN ({pr}) + ({rc}) > 0 THEN 2 * ({pr}) * ({rc}) / (({pr}) + ({rc})) ELSE 0.0 END"
        sel += [f"{r9(pr)} AS {mode}_precision", f"{r9(rc)} AS {mode}_recall", f"{r9(f1)} AS {mode}_f1",
                f"{mode}.gold_n AS {mode}_gold_spans", f"{mode}.pred_n AS {mode}_pred_spans"]
    return f"""WITH
wd AS (SELECT doc_id AS doc, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM (
  SELECT doc_id, {words('text')} AS ws FROM documents)),
lb AS (SELECT doc, pos, length(w) AS ln, last_value(CASE WHEN length(w) < 5 OR length(w) >= 7 THEN length(w) END
  IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lastbreak FROM wd),
t0 AS (SELECT doc, pos, CASE WHEN ln >= 7 THEN 1 WHEN ln >= 5 AND lastbreak >= 7 THEN 2 ELSE 0 END AS g FROM lb),
tk AS (SELECT doc, pos, ['O', 'B-T', 'I-T'][g + 1] AS gold,
  ['O', 'B-T', 'I-T'][(CASE WHEN (doc + pos) % 11 = 0 THEN 0 ELSE g END) + 1] AS pred FROM t0 WHERE pos % 13 <> 0),
acc AS (SELECT count(*) AS n_tokens, avg(CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END) AS token_accuracy FROM tk),
{", ".join(parts)}
SELECT acc.n_tokens, {r9('acc.token_accuracy')} AS token_accuracy, {", ".join(sel)}
FROM acc, strict, lenient"""


ORACLE["span_report"] = _span_report()

ORACLE["parse_printed_list"] = f"""WITH {PREDS}
SELECT doc_id, CAST(len(predictions) AS INTEGER) AS n_parsed,
  {r9('list_max(list_transform(predictions, lambda x: x.score))')} AS max_score,
  CAST(len(list_filter(predictions, lambda x: x.entity_group = 'ESG')) AS INTEGER) AS n_esg FROM preds"""

ORACLE["parse_literal_cells"] = f"""WITH {PREDS},
e AS (SELECT doc_id, text, CASE WHEN doc_id % 7 = 3 THEN [] ELSE predictions END AS p FROM preds JOIN documents USING (doc_id))
SELECT doc_id, CAST(len(p) AS INTEGER) AS n_parsed,
  coalesce(array_to_string(list_transform(range(len(p)), lambda i: substr(text, i::INTEGER * 9 + 1, 30) || 'it''s "so"'), '|'), '') AS words,
  CAST(len(list_filter(p, lambda x: x.score > 0.99)) AS INTEGER) AS n_ok,
  CAST(len(list_filter(p, lambda x: x.score <= 0.99)) AS INTEGER) AS n_none,
  CAST(coalesce(list_sum(list_transform(range(len(p)), lambda i: i + 30)), 0) AS INTEGER) AS span_ends,
  {r9('list_max(list_transform(p, lambda x: x.score))')} AS max_score FROM e"""

ORACLE["label_id_roundtrip"] = f"""WITH {VOTES}, {MKT},
q AS (SELECT quantile_cont(bullish_pct, 0.25) AS p25, quantile_cont(bullish_pct, 0.75) AS p75 FROM mkt),
l AS (SELECT user_id, week, {_label_case('bullish_pct', 'p25', 'p75', 'bearish', 'bullish')} AS market_direction
  FROM mkt, q)
SELECT user_id, week, market_direction, {_id_case('market_direction', PAIRS[0][3])} AS market_direction_id,
  market_direction AS decoded FROM l"""


# ---------------------------------------------------------------- textprep
NL = "chr(10)"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WSRE}]+', ' ', 'g'), {WS})"


ORACLE["clean_text"] = f"""WITH c AS (SELECT doc_id, {collapse('text')} AS text FROM documents)
SELECT doc_id, text FROM c WHERE coalesce(length({strip('text')}) >= 1, false)
  AND text <> 'null' AND text <> '-' AND NOT starts_with(text, 'RT @')"""


def _news() -> str:
    pct = ",\n  ".join(f"CAST({c} AS DOUBLE) / NULLIF({neg} + {pos}, 0) * 100 AS {c}_pct"
                       for _n, neg, pos, _l in PAIRS for c in (neg, pos))
    q = ", ".join(f"quantile_cont({pos}_pct, 0.25) AS {n}_p25, quantile_cont({pos}_pct, 0.75) AS {n}_p75"
                  for n, _neg, pos, _l in PAIRS)
    lab = ",\n  ".join(f"{_label_case(pos + '_pct', 'q.' + n + '_p25', 'q.' + n + '_p75', neg, pos)} AS {n}"
                       for n, neg, pos, _l in PAIRS)
    ids = ", ".join(f"{_id_case(n, labs)} AS {n}_id" for n, _a, _b, labs in PAIRS)
    return f"""WITH {VOTES},
art AS (SELECT v.*, split_part(d.text, {NL}, 1) AS title,
    NULLIF(regexp_extract(d.text, '(?s)^[^\\n]*\\n(.*)$', 1), '') AS description
  , d.doc_id AS article_id FROM votes v JOIN documents d
    ON d.doc_id % (SELECT max(user_id * 5 + week) + 1 FROM votes) = v.user_id * 5 + v.week),
t AS (SELECT *, CAST(bearish + bullish + liked + disliked + important + lol AS INTEGER) AS total_votes,
  bearish + bullish AS m, liked + disliked AS e, important + lol AS c FROM art),
pos AS (SELECT * FROM t WHERE total_votes > 0),
f0 AS (SELECT * FROM pos WHERE total_votes >= (SELECT least(median(m), median(e), median(c)) FROM pos)),
f1 AS (SELECT * EXCLUDE (description), coalesce(description, '') AS description FROM f0 WHERE title IS NOT NULL),
f2 AS (SELECT * FROM f1 WHERE coalesce(length({strip('description')}) >= 1, false) AND description <> 'null'
  AND length(description) > 0 AND NOT starts_with(description, 'RT @') AND description <> '-'),
p AS (SELECT *, {pct} FROM f2),
q AS (SELECT {q} FROM p),
l AS (SELECT p.*, {lab} FROM p, q)
SELECT article_id, user_id, week, {strip(f"{strip('title')} || {NL} || {NL} || {strip('description')}")} AS text,
  {ids}, total_votes, bearish, bullish, liked, disliked, important, lol FROM l"""


ORACLE["news_labelled"] = _news()

def spans(x: str) -> str:
    return f"regexp_extract_all({x}, '(?:{TOKRE})[{WSRE}]*')"


ORACLE["fixed_windows"] = f"""WITH t AS (SELECT doc_id, {spans('text')} AS sp FROM documents),
ch AS (SELECT doc_id, unnest(range(0, len(sp), 512)) AS s, sp FROM t WHERE len(sp) > 0)
SELECT doc_id, CAST(s // 512 AS INTEGER) AS chunk_id, {strip("array_to_string(list_slice(sp, s + 1, s + 512), '')")} AS chunk_text,
  CAST(least(512, len(sp) - s) AS INTEGER) AS n_tokens FROM ch"""

ORACLE["overlap_windows"] = f"""WITH t AS (SELECT doc_id, lang, text, {spans('text')} AS sp FROM documents),
k AS (SELECT *, CASE WHEN len(sp) > 0 THEN greatest(CAST(ceil((len(sp) - 510) / 460) AS BIGINT), 0) + 1 END AS k FROM t),
ch AS (SELECT doc_id, lang, CASE WHEN k IS NOT NULL THEN list_transform(range(0, k),
    lambda w: {strip("array_to_string(list_slice(sp, w * 460 + 1, w * 460 + 510), '')")}) ELSE [{strip('text')}] END AS chunks FROM k)
SELECT doc_id, lang, CAST(unnest(range(len(chunks))) AS INTEGER) AS chunk_id, unnest(chunks) AS chunk_text FROM ch"""

ORACLE["pack_blocks"] = f"""WITH t AS (SELECT doc_id, lang, coalesce({toks('text')}, []) AS tk FROM documents),
o AS (SELECT *, coalesce(sum(len(tk)) OVER (PARTITION BY lang ORDER BY doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM t),
ex AS (SELECT lang, start, unnest(tk) AS token, unnest(range(len(tk))) AS i FROM o)
SELECT lang, CAST((start + i) // 512 AS BIGINT) AS block_id, CAST(count(*) AS INTEGER) AS n_tokens,
  string_agg(token, ' ' ORDER BY start + i) AS block_text FROM ex GROUP BY lang, (start + i) // 512"""

ORACLE["pad_truncate"] = f"""WITH t AS (SELECT doc_id, list_slice(coalesce({toks('text')}, []), 1, 512) AS kept FROM documents)
SELECT doc_id, array_to_string(list_concat(kept, list_transform(range(512 - len(kept)), lambda x: '[PAD]')), ' ')
  AS input_text, CAST(len(kept) AS INTEGER) AS n_real FROM t"""

WORD_TAGS = f"""wd AS (SELECT doc_id AS doc, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM (
  SELECT doc_id, {words('text')} AS ws FROM documents)),
lb AS (SELECT doc, pos, w, length(w) AS ln, last_value(CASE WHEN length(w) < 5 OR length(w) >= 7 THEN length(w) END
  IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lastbreak FROM wd),
t0 AS (SELECT doc, pos, w, CASE WHEN ln >= 7 THEN 1 WHEN ln >= 5 AND lastbreak >= 7 THEN 2 ELSE 0 END AS g FROM lb)"""

ORACLE["label_alignment"] = f"""WITH {WORD_TAGS},
pc AS (SELECT doc, pos, g, unnest({toks('w')}) AS piece, unnest(range(len({toks('w')}))) AS pi FROM t0),
lab AS (SELECT doc, list(CASE WHEN pi = 0 THEN g ELSE -100 END ORDER BY pos, pi) AS l FROM pc GROUP BY doc),
cut AS (SELECT doc, l, unnest(range(0, len(l), 510)) AS s FROM lab),
fin AS (SELECT doc AS doc_id, CAST(s // 510 AS INTEGER) AS part,
  list_concat(list_concat([-100], list_slice(l, s + 1, s + 510)), [-100]) AS labels FROM cut)
SELECT doc_id, part, CAST(len(labels) AS INTEGER) AS n_labels,
  CAST(len(list_filter(labels, lambda x: x <> -100)) AS INTEGER) AS n_labelled,
  array_to_string(labels, ' ') AS labels_text FROM fin"""

ORACLE["row_label_mode"] = f"""WITH {WORD_TAGS},
c AS (SELECT doc, g, count(*) AS n, min(pos) AS f FROM t0 WHERE pos % 13 <> 0 GROUP BY doc, g),
b AS (SELECT doc, g FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, f) AS r FROM c) WHERE r = 1),
docs AS (SELECT DISTINCT doc FROM t0)
SELECT d.doc AS doc_id, CAST(coalesce(b.g, 0) AS INTEGER) AS label_mode FROM docs d LEFT JOIN b USING (doc)"""


def _html(x: str) -> str:
    def rr(e, pat, rep):
        return f"regexp_replace({e}, '{pat}', {rep}, 'g')"
    e = x
    e = rr(e, r"(?is)<head\b[^>]*>.*?</head>", "''")
    e = rr(e, r"(?is)<script\b[^>]*>.*?</script>", "''")
    e = rr(e, r"(?is)<style\b[^>]*>.*?</style>", "''")
    e = rr(e, r"(?s)<!--.*?-->", "''")
    for n in range(1, 7):
        e = rr(e, rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}>", f"{NL} || '{'#' * n} \\1' || {NL}")
    e = rr(e, r"(?is)<li\b[^>]*>(.*?)</li>", f"{NL} || '* \\1'")
    e = rr(e, r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', r"'[\2](\1)'")
    e = rr(e, r"(?i)<br\s*/?>", NL)
    e = rr(e, r"(?i)</?p\b[^>]*>", f"{NL} || {NL}")
    e = rr(e, r"(?i)</?(?:div|section|article|header|footer|nav|main|aside|table|tr|ul|ol|form|body)\b[^>]*>", NL)
    e = rr(e, r"(?i)</?(?:td|th)\b[^>]*>", "' '")
    e = rr(e, r"<[^>]+>", "''")
    for ent, ch in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
        e = f"replace({e}, '{ent}', '{ch}')"
    e = rr(e, r"[ \t]+", "' '")
    e = rr(e, r" ?\n ?", NL)
    e = rr(e, r"\n{3,}", f"{NL} || {NL}")
    e = strip(e)
    banner = "'# US Patent & Trademark Office Patent Public Search | Text View'"
    e = f"replace({e}, {banner} || {NL} || {NL}, '')"
    e = f"replace({e}, {banner}, '')"
    return e


ORACLE["html_to_text"] = f"SELECT page_id, {_html('html')} AS text FROM pages"

CSIZE = f"""{DATED},
d AS (SELECT corpus, coalesce(len({toks('text')}), 0) + 2 AS t FROM dated),
cs AS (SELECT corpus, count(*) AS documents, CAST(sum(t) AS BIGINT) AS tokens FROM d GROUP BY corpus)"""

ORACLE["human_numbers"] = f"""WITH {CSIZE}
SELECT corpus,
  CASE WHEN tokens >= 1e9 THEN CAST(CAST(round_even(tokens / 1e9, 0) AS BIGINT) AS VARCHAR) || 'B'
       WHEN tokens >= 1e6 THEN CAST(CAST(round_even(tokens / 1e6, 0) AS BIGINT) AS VARCHAR) || 'M'
       WHEN tokens >= 1e3 THEN CAST(CAST(round_even(tokens / 1e3, 0) AS BIGINT) AS VARCHAR) || 'K'
       ELSE CAST(tokens AS VARCHAR) END AS tokens_short,
  CASE WHEN documents >= 1e6 THEN printf('%.2fM', documents / 1e6)
       WHEN documents >= 1e3 THEN printf('%.1fK', documents / 1e3)
       ELSE printf('%.0f', CAST(documents AS DOUBLE)) END AS documents_label,
  CASE WHEN tokens > 1000 THEN printf('%.1fK', tokens / 1000) ELSE printf('%.0f', CAST(tokens AS DOUBLE)) END
    AS tokens_label
FROM cs"""

ORACLE["clip_scale"] = f"""WITH {CSIZE}
SELECT corpus, {r9('greatest(tokens - 50000, 0.0) / 1e3')} AS excess_k FROM cs"""

ORACLE["strip_text"] = f"""WITH t0 AS (SELECT conv_id, text AS title FROM conversations WHERE turn = 0),
t1 AS (SELECT conv_id, text AS body FROM conversations WHERE turn = 1)
SELECT conv_id, {strip(f"{strip('title')} || {NL} || {NL} || {strip('body')}")} AS text,
  CAST(length({strip('title')}) AS INTEGER) AS title_len FROM t0 JOIN t1 USING (conv_id)"""


# ----------------------------------------------------------------- sampling
ORACLE["bounded_scan"] = "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 100"
ORACLE["value_extremes"] = """SELECT event_type, min(value) AS min_value, max(value) AS max_value,
  min(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS first_ts, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS last_ts
FROM events GROUP BY event_type"""
ORACLE["distinct_keys"] = "SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey"
ORACLE["text_join"] = f"""WITH {DOCS_FIRST}
SELECT d.doc_id, f.doc_id AS first_doc_id FROM documents d JOIN docs_first f ON d.text = f.text"""
ORACLE["year_lookup"] = f"""WITH
a AS (SELECT year(l_shipdate) * 100 + month(l_shipdate) AS period, count(*) AS activity FROM lineitem GROUP BY 1),
b AS (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS period, median(o_totalprice) AS price FROM orders GROUP BY 1)
SELECT a.period, a.activity, {r9('b.price')} AS price, b.price IS NULL AS missing FROM a LEFT JOIN b USING (period)"""


def _per_fold() -> str:
    return f"""WITH {LOGITS},
pp AS (SELECT CAST(row_id % 5 AS INTEGER) AS fold, label AS y,
  CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS p FROM lg),
pairs AS (SELECT fold, y, p, count(*) AS n FROM pp GROUP BY fold, y, p),
bt AS (SELECT fold, y AS cls, sum(n) AS support, sum(CASE WHEN y = p THEN n END) AS tp FROM pairs GROUP BY fold, y),
bp AS (SELECT fold, p AS cls, sum(n) AS predicted FROM pairs GROUP BY fold, p),
per AS (SELECT coalesce(bt.fold, bp.fold) AS fold, coalesce(bt.support, 0) AS support, coalesce(bt.tp, 0) AS tp,
  coalesce(bp.predicted, 0) AS predicted FROM bt FULL OUTER JOIN bp ON bt.fold = bp.fold AND bt.cls = bp.cls),
m AS (SELECT *, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS pr,
  CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS rc FROM per),
m2 AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM m)
SELECT fold, {r9('CAST(sum(tp) AS DOUBLE) / sum(support)')} AS eval_accuracy,
  {r9('avg(f1)')} AS f1_macro, {r9('avg(pr)')} AS precision_macro, {r9('avg(rc)')} AS recall_macro
FROM m2 GROUP BY fold"""


ORACLE["per_fold_report"] = _per_fold()


# ------------------------------------------------------------------- ingest
VIEWS_SQL = """cv AS (SELECT *, '2020-' || lpad(CAST(conv_id % 12 + 1 AS VARCHAR), 2, '0') || '-01' AS d,
    lpad(CAST(turn % 24 AS VARCHAR), 2, '0') || ':00:00' AS clk, conv_id * 1000 + turn AS ord FROM conversations),
std AS (
  SELECT d AS timestamp, role AS username, text AS tweet, 'view_created_at' AS source, 0 AS src_rank, ord
    FROM cv WHERE turn % 3 = 0
  UNION ALL SELECT d, NULL, text, 'view_date_time', 1, ord FROM cv WHERE turn % 3 = 1
  UNION ALL SELECT d || ' ' || clk, NULL, text, 'view_datetime', 2, ord FROM cv WHERE turn % 3 = 2)"""

ORACLE["standardise_columns"] = f"WITH {VIEWS_SQL} SELECT timestamp, username, tweet, source FROM std"
ORACLE["standardise_merge_date_time"] = f"""WITH {VIEWS_SQL}
SELECT CASE WHEN source = 'view_date_time' THEN timestamp || ' ' || clk2 ELSE timestamp END AS timestamp,
  username, tweet, source FROM (SELECT std.*, lpad(CAST((ord % 1000) % 24 AS VARCHAR), 2, '0') || ':00:00' AS clk2
  FROM std)"""
ORACLE["union_sources"] = f"""WITH {VIEWS_SQL}
SELECT source, count(*) AS rows, {r9('CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM std) * 100')} AS percent
FROM std GROUP BY source"""
ORACLE["posts_ingest"] = f"""WITH {VIEWS_SQL},
c AS (SELECT timestamp, username, {collapse('tweet')} AS tweet, src_rank, ord FROM std),
f AS (SELECT * FROM c WHERE coalesce(length({strip('tweet')}) >= 1, false)),
k AS (SELECT *, row_number() OVER (PARTITION BY tweet ORDER BY src_rank, ord) AS rn FROM f)
SELECT timestamp, username, tweet FROM k WHERE rn = 1"""
ORACLE["combine_text_sources"] = f"""WITH {VIEWS_SQL},
u AS (SELECT text, 'documents' AS source FROM documents
  UNION ALL SELECT text, 'conversations' FROM conversations
  UNION ALL SELECT tweet, 'posts' FROM std
  UNION ALL SELECT text, 'benchmark' FROM benchmark)
SELECT source, count(*) AS rows, sum(length(text)) AS chars,
  {r9('CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM u) * 100')} AS percent FROM u GROUP BY source"""

RECORDS = f"""{META},
recs AS (SELECT CASE WHEN doc_id % 23 = 0 THEN '' ELSE key END AS paperId, doc_id, ord, quality, toxic,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'v' || key END AS venue_id,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'Venue ' || CAST(doc_id % 11 AS VARCHAR) END AS venue_name,
  CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 2 END AS n_fields,
  CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(2000 + doc_id % 25 AS VARCHAR) END AS year_text FROM meta)"""

ORACLE["standardise_records"] = f"""WITH {RECORDS}
SELECT paperId, doc_id, ord, TRY_CAST(TRY_CAST(year_text AS DOUBLE) AS INTEGER) AS year, n_fields,
  venue_id IS NOT NULL AS has_venue, venue_name FROM recs
WHERE paperId IS NOT NULL AND paperId <> '' AND TRY_CAST(TRY_CAST(year_text AS DOUBLE) AS INTEGER) IS NOT NULL"""

ORACLE["literature_join"] = f"""WITH {RECORDS}, {DOCS_FIRST},
rf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paperId ORDER BY ord, doc_id) AS rn
  FROM recs WHERE paperId <> '') WHERE rn = 1)
SELECT CAST(d.doc_id AS VARCHAR) AS paperId, d.doc_id, d.lang, CAST(n_fields AS INTEGER) AS n_fields, r.ord,
  r.quality, CAST(length(d.text) AS INTEGER) AS text_chars, r.venue_name AS venue
FROM docs_first d JOIN rf r ON CAST(d.doc_id AS VARCHAR) = r.paperId"""

ORACLE["patent_join"] = f"""WITH {META}, {META_LAST}
SELECT CAST(d.doc_id AS VARCHAR) AS key, CAST(length(d.text) AS INTEGER) AS text_chars,
  coalesce(CAST(m.doc_id AS VARCHAR), '') AS doc_id, coalesce(CAST(m.quality AS VARCHAR), '') AS quality,
  coalesce(CAST(m.toxic AS VARCHAR), '') AS toxic, coalesce(CAST(m.ord AS VARCHAR), '') AS ord
FROM documents d JOIN meta_last m ON CAST(d.doc_id AS VARCHAR) = m.key"""

ORACLE["language_id"] = f"""WITH dd AS (SELECT doc_id, lang, ' ' || lower({collapse('text')}) || ' ' AS t,
    substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' AS train FROM documents),
g AS (SELECT doc_id, lang, train, unnest([substr(t, i, 3) for i in range(1, length(t) - 1)]) AS gram FROM dd),
cnt AS (SELECT lang, gram, count(*) AS c FROM g WHERE train AND lang IS NOT NULL GROUP BY lang, gram),
tot AS (SELECT lang, sum(c) AS total, count(*) AS v FROM cnt GROUP BY lang),
dt AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
hit AS (SELECT g.doc_id, cnt.lang, sum(ln((c + 1) / CAST(total + v AS DOUBLE))) AS s, count(*) AS m
  FROM g JOIN cnt USING (gram) JOIN tot ON tot.lang = cnt.lang GROUP BY g.doc_id, cnt.lang),
sc AS (SELECT dt.doc_id, tot.lang, coalesce(s, 0) + (n - coalesce(m, 0)) * ln(1.0 / CAST(total + v AS DOUBLE)) AS score
  FROM dt CROSS JOIN tot LEFT JOIN hit ON hit.doc_id = dt.doc_id AND hit.lang = tot.lang),
best AS (SELECT doc_id, lang AS language FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS r FROM sc) WHERE r = 1)
SELECT d.doc_id, b.language, d.lang, NOT d.train AS held_out FROM dd d LEFT JOIN best b USING (doc_id)"""

ORACLE["english_only"] = f"SELECT doc_id FROM ({ORACLE['language_id']}) WHERE language = 'en'"

ORACLE["lag_correlation_p"] = f"""WITH lc AS ({ORACLE['lag_correlation'].replace(r9('corr(rx, ry)'), 'corr(rx, ry)')}),
t AS (SELECT *, abs(spearman_correlation) AS s, 1 - spearman_correlation * spearman_correlation AS c2, n - 2 AS df FROM lc),
a AS (SELECT *, CASE WHEN df % 2 = 0
  THEN s * list_sum([exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(c2, k) for k in range(df // 2)])
  ELSE (asin(s) + CASE WHEN df > 1 THEN s * list_sum([exp(lgamma(k + 1) - lgamma(k + 1.5)) * sqrt(pi()) / 2
    * pow(c2, k + 0.5) for k in range((df - 1) // 2)]) ELSE 0 END) * 2 / pi() END AS inside FROM t)
SELECT lag, n, {r9('spearman_correlation')} AS spearman_correlation, {r9('greatest(1 - inside, 0.0)')} AS p_value FROM a"""


# ---------------------------------------------------------------- sub-words
def _subwords(source: str) -> str:
    """CTEs: the public vocabulary ``voc`` and, for the distinct words ``w`` of
    ``source``, their pieces by longest match in ``pcs`` (w, pi, id, a, z: first
    character and end)."""
    from corpusloom.operators.subwords import byte_letters
    from corpusloom.plans.subwords import FIRST, LAST, vocabulary_path
    table = "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in byte_letters()) + "]"
    assert (FIRST, LAST) == (49406, 49407)
    return f"""voc AS MATERIALIZED (
  SELECT key AS piece, value::INT AS id FROM json_each((SELECT content FROM read_text('{vocabulary_path()}')), '$.model.vocab')),
low AS (SELECT w, list_transform(string_split(w, ''), lambda c: CASE WHEN length(lower(c)) = 1 THEN lower(c) ELSE c END) AS cs
  FROM (SELECT DISTINCT w FROM {source})),
byt AS MATERIALIZED (SELECT w, array_to_string(list_transform(range(octet_length(encode(array_to_string(cs, '')))),
    lambda i: {table}[('0x' || substr(hex(encode(array_to_string(cs, ''))), i::INT * 2 + 1, 2))::INT + 1]), '') AS m,
  flatten(list_transform(range(len(cs)), lambda i: list_transform(range(octet_length(encode(cs[i + 1]))), lambda k: i))) AS at_char FROM low),
cut(w, m, pos_, pi, id) AS (
  SELECT w, m, 0::BIGINT, -1, -1 FROM byt
  UNION ALL
  SELECT w, m, pos_ + n, pi + 1, vid FROM (
    SELECT c.w, c.m, c.pos_, c.pi, n, v.id AS vid, row_number() OVER (PARTITION BY c.w ORDER BY n DESC) AS r
    FROM cut c JOIN range(1, 40) t(n) ON c.pos_ + n <= length(c.m)
    JOIN voc v ON v.piece = substr(c.m, c.pos_ + 1, n) || CASE WHEN c.pos_ + n = length(c.m) THEN '</w>' ELSE '' END
    WHERE c.pos_ < length(c.m)) WHERE r = 1),
whole AS (SELECT w FROM cut WHERE pos_ = length(m)),
steps AS (SELECT w, pi, id, lag(pos_) OVER (PARTITION BY w ORDER BY pi) AS a, pos_ AS z FROM cut SEMI JOIN whole USING (w)),
pcs AS MATERIALIZED (SELECT w, pi, id, at_char[a + 1] AS a, at_char[z] + 1 AS z FROM steps JOIN byt USING (w) WHERE pi >= 0
  UNION ALL SELECT w, 0, {LAST}, 0, length(w) FROM byt ANTI JOIN whole USING (w))"""


def _subword_oracles() -> dict[str, str]:
    spans = f"regexp_extract_all(coalesce(text, ''), '(?:{TOKRE})[{WSRE}]*')"
    placed = f"""sp AS (SELECT doc_id, text, {spans} AS s FROM documents),
un AS (SELECT doc_id, length(coalesce(text, '')) - coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) AS lead,
  unnest(s) AS x, unnest(range(len(s))) AS k FROM sp),
tk AS (SELECT doc_id, k, regexp_extract(x, '{TOKRE}') AS w, lead + coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY k
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_ FROM un)"""
    return {
        "subword_counts": f"""WITH RECURSIVE {placed}, {_subwords('tk')},
s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (id = 49407) AS u, max(z - a) AS l FROM tk JOIN pcs USING (w) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) + 2 AS BIGINT) AS total_tokens, CAST(coalesce(u, 0) AS INTEGER) AS n_unknown,
  CAST(coalesce(l, 0) AS INTEGER) AS longest FROM documents LEFT JOIN s USING (doc_id)""",
        "subword_pad": f"""WITH RECURSIVE {placed}, {_subwords('tk')},
r AS (SELECT doc_id, id, pos_ + z AS z, row_number() OVER (PARTITION BY doc_id ORDER BY k, pi) AS r FROM tk JOIN pcs USING (w)),
s AS (SELECT doc_id, list(id ORDER BY r) AS ids, max(z) AS z FROM r WHERE r <= 510 GROUP BY doc_id)
SELECT doc_id, md5(array_to_string(list_concat(list_concat(list_concat([49406], coalesce(ids, [])), [49407]),
    list_transform(range(510 - coalesce(len(ids), 0)), lambda x: 0)), ' ')) AS ids_md5,
  CAST(coalesce(len(ids), 0) + 2 AS INTEGER) AS n_real, CAST(coalesce(z, 0) AS INTEGER) AS n_chars_covered
FROM documents LEFT JOIN s USING (doc_id)""",
        "subword_alignment": f"""WITH RECURSIVE {WORD_TAGS},
tk AS (SELECT doc, pos, g, unnest({toks('w')}) AS w, unnest(range(len({toks('w')}))) AS ti FROM t0), {_subwords('tk')},
lab AS (SELECT doc, list(CASE WHEN ti = 0 AND pi = 0 THEN g ELSE -100 END ORDER BY pos, ti, pi) AS l FROM tk JOIN pcs USING (w) GROUP BY doc),
part AS (SELECT doc, l, unnest(range(0, len(l), 510)) AS s FROM lab),
fin AS (SELECT doc AS doc_id, CAST(s // 510 AS INTEGER) AS part, list_slice(l, s + 1, s + 510) AS b FROM part)
SELECT doc_id, part, CAST(len(b) AS INTEGER) AS n_pieces, CAST(len(list_filter(b, lambda x: x <> -100)) AS INTEGER) AS n_labelled,
  md5(array_to_string(list_concat(list_concat([-100], b), [-100]), ' ')) AS labels_md5 FROM fin"""}


if find_spec("public_tokenizers"):  # the vocabulary file of these queries
    ORACLE |= _subword_oracles()


# ---------------------------------------------------------------- seeded orders and predictors
def _h(key: str, seed: int) -> str:
    return f"('0x' || substr(md5('{seed}|' || coalesce(CAST({key} AS VARCHAR), '')), 1, 15))::BIGINT"


ORACLE["sample_exact"] = f"""SELECT event_id, user_id, event_type FROM events ORDER BY {_h('event_id', 42)}, event_id LIMIT 500"""

ORACLE["seeded_shuffle"] = f"""SELECT event_id, row_number() OVER (ORDER BY {_h('event_id', 42)}, event_id) AS shuffle_pos FROM events"""

LABELLED = "lb AS (SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id))"

ORACLE["split_exact"] = f"""WITH {LABELLED}
SELECT doc_id, lang, quality, CASE WHEN row_number() OVER (ORDER BY {_h('doc_id', 42)}, doc_id) <= ceil((SELECT count(*) FROM lb) * 0.1::DOUBLE)
  THEN 'test' ELSE 'train' END AS split FROM lb"""

ORACLE["split_stratified"] = f"""WITH {LABELLED},
t AS (SELECT count(*) AS n, ceil(count(*) * 0.1::DOUBLE) AS n_test FROM lb),
q AS (SELECT quality, count(*) * max(n_test) / max(n) AS exact FROM lb, t GROUP BY quality),
r AS (SELECT quality, floor(exact) + (row_number() OVER (ORDER BY exact - floor(exact) DESC, quality)
  <= max(n_test) OVER () - sum(floor(exact)) OVER ())::INT AS quota FROM q, t)
SELECT doc_id, lang, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY {_h('doc_id', 42)}, doc_id) <= quota
  THEN 'test' ELSE 'train' END AS split FROM lb JOIN r USING (quality)"""

# the greedy walk over groups, one by one
ORACLE["group_folds"] = f"""WITH RECURSIVE g AS (SELECT conv_id, size, row_number() OVER (ORDER BY size DESC, {_h('conv_id', 0)}, conv_id) AS k
  FROM (SELECT conv_id, count(*) AS size FROM conversations GROUP BY conv_id)),
walk(k, conv_id, fold, loads) AS (
  SELECT 0::BIGINT, NULL::BIGINT, 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[]
  UNION ALL
  SELECT g.k, g.conv_id, list_position(loads, list_min(loads)) - 1,
    [x + CASE WHEN i = list_position(loads, list_min(loads)) THEN g.size ELSE 0 END FOR x, i IN loads]
  FROM walk JOIN g ON g.k = walk.k + 1)
SELECT c.conv_id, c.turn, CAST(w.fold AS INTEGER) AS fold FROM conversations c JOIN walk w ON w.k > 0 AND w.conv_id = c.conv_id"""


def _sentiment() -> str:
    from corpusloom.plans.inference import NEGATIVE, POSITIVE
    has = lambda ws: "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{x}'" for x in ws) + ")))"
    return f"""WITH c AS (SELECT conv_id, turn, text, {words("lower(coalesce(text, ''))")} AS w FROM conversations),
n AS (SELECT *, {has(POSITIVE)} AS p, {has(NEGATIVE)} AS q, len(w) > 0 AS ok FROM c),
s AS (SELECT *, (greatest(p, q) + 1) / CAST(p + q + 2 AS DOUBLE) AS score FROM n)
SELECT conv_id, turn, CASE WHEN ok THEN CASE WHEN p > q THEN 'bullish' WHEN q > p THEN 'bearish' ELSE 'neutral' END END AS sentiment_label,
  CASE WHEN ok THEN {r9('score')} END AS sentiment_score,
  CASE WHEN ok THEN CASE WHEN score > 0.9 THEN 'high' WHEN score > 0.7 THEN 'medium' ELSE 'low' END END AS confidence_level,
  CAST(ok AS INTEGER) AS n_classes FROM s"""


ORACLE["batch_sentiment"] = _sentiment()


# ---------------------------------------------------------------- text repair
def _encoding_search() -> str:
    from corpusloom.operators.mojibake import CODECS, detector
    from corpusloom.plans.textprep import DAMAGE
    quoted = {k: "[" + ", ".join("'" + c.replace("'", "''") + "'" if ord(c) else "chr(0)" for c in v) + "]" for k, v in CODECS.items()}

    def broken(x: str, codec: str) -> str:
        return f"array_to_string(list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda h: {quoted[codec]}[('0x' || h)::INT + 1]), '')"

    steps, cases, depth = ["d0 AS (SELECT doc_id, CAST(doc_id % 7 AS INTEGER) AS variant, coalesce(text, '') AS text FROM documents)"], [], []
    for k, layers in enumerate(DAMAGE):
        x = "left(text, length(text) // 2)" if layers == "half" else "text"
        cases.append(f"WHEN {k} THEN octet_length(encode({x})) <> length({x})")
        made, layers_ = x, ("cp1252",) if layers == "half" else layers
        for codec in layers_:
            made = broken(made, codec)
        depth.append(f"WHEN {k} THEN {len(layers_)}")
        tail = " || substr(text, length(text) // 2 + 1)" if layers == "half" else ""
        steps.append(f"v{k} AS (SELECT doc_id, variant, text, {made}{tail} AS t FROM d0 WHERE variant = {k})")
    union = " UNION ALL ".join(f"SELECT * FROM v{k}" for k in range(len(DAMAGE)))
    return f"""WITH {", ".join(steps)}, u AS ({union})
SELECT doc_id, variant, regexp_matches(t, '{detector()}') AS suspect, CAST(length(t) AS INTEGER) AS n_chars,
  CAST(CASE WHEN CASE variant {" ".join(cases)} END THEN CASE variant {" ".join(depth)} END ELSE 0 END AS INTEGER) AS layers,
  md5(text) AS restored_md5 FROM u"""


ORACLE["encoding_search"] = _encoding_search()

# a repaired text is its original again
ORACLE["encoding_repair"] = "SELECT doc_id, CASE WHEN text IS NOT NULL THEN true END AS restored FROM documents"

ORACLE["small_files_scan"] = """WITH c AS (SELECT *, turn % 3 AS style, '2020-' || lpad(CAST(conv_id % 12 + 1 AS VARCHAR), 2, '0') || '-01' AS d FROM conversations)
SELECT CASE WHEN style < 2 THEN 'csv' ELSE 'json' END AS kind, 'good' AS status,
  CASE WHEN style = 1 THEN d || ' ' || lpad(CAST(turn % 24 AS VARCHAR), 2, '0') || ':00' ELSE d END AS timestamp,
  CASE WHEN style = 1 THEN NULL ELSE role END AS username, md5(CASE WHEN style = 2 THEN text ELSE nullif(text, '') END) AS tweet_md5 FROM c
UNION ALL
SELECT CASE WHEN style < 2 THEN 'csv' ELSE 'json' END, CASE style WHEN 0 THEN '6 fields instead of 5' WHEN 1 THEN 'unclosed quote' ELSE 'no JSON' END, NULL, NULL,
  md5(CASE style WHEN 0 THEN 'x,y,z,1,2,3' WHEN 1 THEN 'x,"y' ELSE '{"datetime": "x", ' END) FROM c WHERE conv_id % 11 = 0"""

# ---------------------------------------------------------------- runs and micro-batches
ORACLE["stream_key_first"] = ORACLE["dedup_key_first"]
ORACLE["stream_text_first"] = ORACLE["dedup_text_first"]
ORACLE["ledger_outcomes"] = """SELECT CAST(page_id AS VARCHAR) AS key, CASE WHEN page_id % 10 = 3 THEN 'dead' ELSE 'done' END AS outcome,
  CASE page_id % 10 WHEN 3 THEN 3 WHEN 5 THEN 2 ELSE 1 END AS attempt,
  CASE WHEN page_id % 10 <> 3 THEN CAST(length(html) AS INTEGER) END AS n_chars FROM pages"""

# ---------------------------------------------------------------- files
ORACLE["csv_roundtrip"] = """SELECT o_orderpriority, count(*) AS good, CAST(sum(o_orderkey) AS BIGINT) AS keys, round(sum(o_totalprice), 2) AS price
FROM orders WHERE o_orderkey % 97 <> 0 GROUP BY o_orderpriority
UNION ALL SELECT 'quarantine', count(*), CAST(sum(o_orderkey) AS BIGINT), NULL FROM orders WHERE o_orderkey % 97 = 0"""
ORACLE["json_records_roundtrip"] = """SELECT conv_id, turn, role, md5(text) AS text_md5, 'good' AS status FROM conversations
UNION ALL SELECT conv_id, turn, NULL, NULL, 'quarantine' FROM conversations WHERE conv_id % 11 = 0"""
# the text writer ends a row with a line feed
ORACLE["text_tree_scan"] = """SELECT page_id, CAST(length(html) + 1 AS INTEGER) AS n_chars, md5(html || chr(10)) AS text_md5, true AS has_key FROM pages"""
ORACLE["partitioned_tables"] = "SELECT lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang"
ORACLE["pending_pages"] = "SELECT page_id, url FROM pages WHERE page_id % 3 <> 0"
ORACLE["converted_pages"] = f"SELECT page_id, CASE WHEN page_id % 13 <> 0 THEN md5({_html('html')}) END AS text_md5 FROM pages"


# ---------------------------------------------------------------- versions and sketches of the vocabulary
def _corpora_where(condition: str, bench: bool = True) -> str:
    only = CORPORA.replace("FROM documents", f"FROM documents WHERE {condition}")
    return only if bench else only.replace("FROM benchmark", "FROM benchmark WHERE false")


LAST = _corpora_where("doc_id % 10 <> 0")
_STATS = f"SELECT tot.corpus, total_tokens, unique_tokens, {r9('avg_freq')} AS avg_freq, {r9('coalesce(ttr, 0.0)')} AS ttr"
ORACLE["vocab_stats_versions"] = f"""SELECT * FROM (WITH {_corpora_where('doc_id % 3 < 2', False)}, {TT}, {TOT}, {TTR}
{_STATS}, 2 AS version FROM tot LEFT JOIN ttr USING (corpus))
UNION ALL SELECT * FROM (WITH {LAST}, {TT}, {TOT}, {TTR}
{_STATS}, 5 AS version FROM tot LEFT JOIN ttr USING (corpus))"""
ORACLE["js_distance_versions"] = ORACLE["js_distance"].replace(CORPORA, LAST)
ORACLE["keyword_density_versions"] = ORACLE["keyword_density"].replace(CORPORA, LAST)
ORACLE["js_divergence"] = f"""SELECT corpus_a, corpus_b, js_distance, CASE WHEN shared_tokens = 0 THEN 1.0 ELSE {r9('d * d')} END AS js_divergence, shared_tokens
FROM (SELECT * FROM ({ORACLE['js_distance'].replace(r9('js_distance') + ' AS js_distance', 'js_distance AS d, ' + r9('js_distance') + ' AS js_distance')}))"""
ORACLE["distinct_sketch"] = f"""WITH {CORPORA}, {TT}, {TOT},
p AS (SELECT corpus, count(DISTINCT doc_id % 10) AS n_parts FROM corpora WHERE len({toks('text')}) > 0 GROUP BY corpus)
SELECT corpus, n_parts, unique_tokens, true AS within FROM tot JOIN p USING (corpus)"""


# ---------------------------------------------------------------- entity metrics by fold
def _span_report_folds() -> str:
    whole = _span_report()
    tokens_, counts = whole.split("acc AS (", 1)
    spans = counts.split("),\n", 1)[1].rsplit("\nSELECT ", 1)[0]
    for mode in ("strict", "lenient"):
        old = f"{mode} AS (SELECT count(g.doc) AS gold_n, count(p.doc) AS pred_n,"
        assert old in spans
        spans = spans.replace(old, f"{mode} AS (SELECT fold, count(g.doc) AS gold_n, count(p.doc) AS pred_n,")
        end = f"FROM {mode}_g g FULL OUTER JOIN {mode}_p p ON g.doc = p.doc AND g.s = p.s AND g.e = p.e AND g.typ = p.typ)"
        assert end in spans
        spans = spans.replace(end, end[:-1] + " JOIN fold_of f ON f.doc = coalesce(g.doc, p.doc) GROUP BY fold)")
    select = "SELECT acc.fold, " + counts.rsplit("\nSELECT ", 1)[1].split("\nFROM ")[0]
    head = tokens_.removeprefix("WITH\n")
    return f"""WITH RECURSIVE sz AS (SELECT source, size, row_number() OVER (ORDER BY size DESC, {_h('source', 0)}, source) AS k
  FROM (SELECT source, count(*) AS size FROM documents GROUP BY source)),
walk(k, source, fold, loads) AS (
  SELECT 0::BIGINT, NULL::VARCHAR, 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[]
  UNION ALL
  SELECT g.k, g.source, list_position(loads, list_min(loads)) - 1,
    [x + CASE WHEN i = list_position(loads, list_min(loads)) THEN g.size ELSE 0 END FOR x, i IN loads]
  FROM walk JOIN sz g ON g.k = walk.k + 1),
fold_of AS (SELECT d.doc_id AS doc, CAST(w.fold AS INTEGER) AS fold FROM documents d JOIN walk w ON w.k > 0 AND w.source = d.source),
{head}acc AS (SELECT fold, count(*) AS n_tokens, avg(CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END) AS token_accuracy
  FROM tk JOIN fold_of USING (doc) GROUP BY fold),
{spans}
{select}
FROM acc JOIN strict ON strict.fold = acc.fold JOIN lenient ON lenient.fold = acc.fold"""


ORACLE["span_report_folds"] = _span_report_folds()


# ---------------------------------------------------------------- calendar lags, aliases
ORACLE["lag_correlation_calendar"] = (
    ORACLE["lag_correlation"].replace("JOIN b USING (period)", "JOIN b USING (period) WHERE period % 7 <> 0")
    .replace("row_number() OVER (ORDER BY period) - 1 AS pos", "period // 100 * 12 + period % 100 AS pos"))
ORACLE["month_gaps"] = ORACLE["lag_correlation"].split("j AS (")[0] + """j AS (SELECT period // 100 * 12 + period % 100 AS i FROM a JOIN b USING (period) WHERE period % 7 <> 0),
n AS (SELECT i, lead(i) OVER (ORDER BY i) AS nx FROM j)
SELECT CAST(i AS BIGINT) AS before, CAST(nx AS BIGINT) AS after, CAST(nx - i - 1 AS BIGINT) AS missing FROM n WHERE nx > i + 1"""
ORACLE["text_alias_roundtrip"] = f"""SELECT 'documents' AS source, doc_id, 'tweet' AS alias, md5({collapse('text')}) AS text_md5 FROM documents
UNION ALL SELECT 'benchmark', item_id, 'sentence', md5({collapse('text')}) FROM benchmark"""


# ---------------------------------------------------------------- entities with places
ORACLE["document_entities"] = f"""WITH r AS (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS s FROM documents
  WHERE len({toks('text')}) > 0),
u AS (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS k FROM r),
p AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM u),
e AS (SELECT doc_id, k, a, regexp_extract(x, '^\\p{{L}}[\\p{{L}}\\p{{N}}]{{6,}}') AS w FROM p),
f AS (SELECT doc_id, count(*) AS n, string_agg(a::BIGINT || ':' || (a + length(w))::BIGINT || ':' || w, '|' ORDER BY k) AS t FROM e
  WHERE w <> '' AND upper(w[1]) = w[1] AND lower(w[1]) <> w[1] GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS num_preds, md5(coalesce(t, '')) AS entities_md5, true AS text_holds_them FROM r LEFT JOIN f USING (doc_id)"""

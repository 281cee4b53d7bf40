"""DuckDB SQL oracles for the registered queries (same names as the catalog).

Inputs are the driver's parquet tables registered as views.  Derived
fixtures are repeated here as CTEs so the oracle never depends on Spark.
Timestamps are rendered as ISO text and doubles rounded to 6 decimals,
matching ``topicpulse.plans.output.present``.
"""

from __future__ import annotations

import datetime as _dt
import re

from topicpulse.functions.sentiment import DEFAULT_LEXICON, NEGATION_FACTOR
from topicpulse.sources.fixtures import AS_OF, CYRILLIC, F4_TOPICS, LATIN

ORACLE: dict[str, str] = {}

# Runs of anything but letters and digits of any script (RE2).
NONWORD = r"[^\p{L}\p{N}]+"

# The dates below are literals, worked out by hand for AS_OF 2024-01-31 12:00.
_DT = _dt.datetime


def _ts(d: _dt.datetime) -> str:
    return f"TIMESTAMP '{d:%Y-%m-%d %H:%M:%S}'"


def iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%gZ')"


K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

# F2 topic_posts
TOPIC_POSTS = f"""
tp AS (
  SELECT event_type AS topic_id,
         't3_' || CAST(event_id AS VARCHAR) AS event_id,
         ts AS created_at,
         CAST(floor(value) AS INTEGER) + {K} + 1 AS engagement,
         CASE WHEN value >= 50 THEN CAST(0.5 AS DOUBLE) ELSE CAST(-0.25 AS DOUBLE) END AS sentiment_score
  FROM events)"""

_LO, _HI = _DT(2022, 1, 31), _DT(2024, 2, 1)


def report_ctes(where: str = "", extra_topic: str | None = None,
                source: str | None = None, extra_topics: list[str] | None = None) -> str:
    """Report CTEs over a ``tp`` source (topic_id, created_at, engagement,
    sentiment_score); ``extra_topics`` get a series even without posts."""
    names = ([extra_topic] if extra_topic else []) + list(extra_topics or [])
    extra = "".join(f" UNION ALL SELECT '{t}' AS topic_id, NULL::TIMESTAMP, NULL::TIMESTAMP"
                    for t in names)
    return f"""{source or TOPIC_POSTS},
d AS (
  SELECT topic_id, date_trunc('day', created_at) AS day, count(*) AS n,
         sum(engagement) AS eng, sum(sentiment_score) AS sent
  FROM tp {where} GROUP BY 1, 2),
g AS (
  SELECT topic_id, '1d' AS window_type, day AS start, n, eng, sent FROM d
  UNION ALL SELECT topic_id, '1w', date_trunc('week', day), n, eng, sent FROM d
  UNION ALL SELECT topic_id, '1m', date_trunc('month', day), n, eng, sent FROM d),
b AS (
  SELECT topic_id, window_type, start, sum(n) AS n, sum(eng) AS eng, sum(sent) AS sent
  FROM g GROUP BY 1, 2, 3),
t0 AS (SELECT topic_id, min(day) AS dmin, max(day) AS dmax FROM d GROUP BY 1{extra}),
t AS (
  SELECT topic_id,
         least(coalesce(min(dmin), {_ts(_LO)}), {_ts(_LO)}) AS lo,
         greatest(coalesce(max(dmax), {_ts(_HI)}), {_ts(_HI)}) AS hi
  FROM t0 GROUP BY 1),
s AS (
  SELECT topic_id, '1d' AS window_type,
         unnest(generate_series(date_trunc('day', lo), date_trunc('day', hi), INTERVAL 1 DAY)) AS start FROM t
  UNION ALL
  SELECT topic_id, '1w',
         unnest(generate_series(date_trunc('week', lo), date_trunc('week', hi), INTERVAL 7 DAY)) FROM t
  UNION ALL
  SELECT topic_id, '1m',
         unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) FROM t),
f AS (
  SELECT s.topic_id, s.window_type, CAST(s.start AS TIMESTAMP) AS start,
         CAST(coalesce(b.n, 0) AS BIGINT) AS mentions, CAST(coalesce(b.eng, 0) AS BIGINT) AS engagement, b.sent
  FROM s LEFT JOIN b ON s.topic_id = b.topic_id AND s.window_type = b.window_type
                     AND CAST(s.start AS TIMESTAMP) = CAST(b.start AS TIMESTAMP)),
l AS (
  SELECT *, lag(mentions, 1, 0) OVER (PARTITION BY topic_id, window_type ORDER BY start) AS prev
  FROM f),
rep AS (
  SELECT topic_id, start,
         start + CASE window_type WHEN '1d' THEN INTERVAL 1 DAY WHEN '1w' THEN INTERVAL 7 DAY
                                  ELSE INTERVAL 30 DAY END AS "end",
         mentions, engagement,
         CASE WHEN mentions > 0 THEN coalesce(sent, 0) / mentions ELSE 0.0 END AS sentiment,
         CASE WHEN prev = 0 THEN 1.0 ELSE mentions / prev END AS growth,
         window_type
  FROM l)"""


REPORT_SELECT = f"""
SELECT topic_id, {iso('start')} AS start, {iso('"end"')} AS "end", mentions, engagement,
       round(sentiment, 6) AS sentiment, round(growth, 6) AS growth,
       round(engagement * growth, 6) AS trend_score, window_type
FROM rep"""

ORACLE["report_topic"] = ("WITH " + report_ctes("WHERE topic_id = 'click'", "click")
                          + REPORT_SELECT)
ORACLE["report_all_topics"] = "WITH " + report_ctes() + REPORT_SELECT
ORACLE["bucket_metrics"] = f"""WITH {TOPIC_POSTS},
d AS (
  SELECT topic_id, date_trunc('day', created_at) AS day, count(*) AS n,
         sum(engagement) AS eng, sum(sentiment_score) AS sent
  FROM tp GROUP BY 1, 2),
g AS (
  SELECT topic_id, '1d' AS window_type, day AS start, n, eng, sent FROM d
  UNION ALL SELECT topic_id, '1w', date_trunc('week', day), n, eng, sent FROM d
  UNION ALL SELECT topic_id, '1m', date_trunc('month', day), n, eng, sent FROM d)
SELECT topic_id, window_type, {iso('start')} AS start, CAST(sum(n) AS BIGINT) AS mentions,
       CAST(sum(eng) AS BIGINT) AS engagement, round(sum(sent), 6) AS sentiment_sum
FROM g GROUP BY topic_id, window_type, start"""


# ---------------------------------------------------------------- timelines
_RANGES = {
    "this_week": (_DT(2024, 1, 29), _DT(2024, 2, 5)),
    "this_month": (_DT(2024, 1, 1), _DT(2024, 2, 1)),
    "3m": (_DT(2023, 11, 1), _DT(2024, 2, 1)),
    "6m": (_DT(2023, 8, 1), _DT(2024, 2, 1)),
    "12m": (_DT(2023, 2, 1), _DT(2024, 2, 1)),
}


def _timeline_sql(window_type: str, range_name: str, clip: bool = False,
                  cols: str = "topic_id, \"end\", mentions, engagement, sentiment, growth") -> str:
    r_start, r_end = _RANGES[range_name]
    step = {"1d": "INTERVAL 1 DAY", "1w": "INTERVAL 7 DAY", "1m": "INTERVAL 1 MONTH"}[window_type]
    clip_sql = f"WHERE bar <= {_ts(AS_OF)}" if clip else ""
    # J4 as a range search: a bar shows the metric that starts in [bar, bar + step),
    # the latest one if there are several
    return f"""WITH {report_ctes()},
bars AS (
  SELECT topic_id, CAST(unnest(generate_series({_ts(r_start)},
         {_ts(r_end)} - INTERVAL 1 MICROSECOND, {step})) AS TIMESTAMP) AS bar
  FROM (SELECT DISTINCT topic_id FROM rep)),
bars2 AS (SELECT * FROM bars {clip_sql}),
found AS (
  SELECT b.topic_id, b.bar, m.mentions, m.engagement, m.sentiment, m.growth,
         row_number() OVER (PARTITION BY b.topic_id, b.bar ORDER BY m.start DESC) AS nth
  FROM bars2 b LEFT JOIN (SELECT * FROM rep WHERE window_type = '{window_type}') m
    ON m.topic_id = b.topic_id AND m.start >= b.bar AND m.start < b.bar + {step}),
j AS (
  SELECT topic_id, epoch_ms(bar) AS "end",
         CAST(coalesce(mentions, 0) AS BIGINT) AS mentions,
         CAST(coalesce(engagement, 0) AS BIGINT) AS engagement,
         round(coalesce(sentiment, 0.0), 6) AS sentiment,
         round(coalesce(growth, 0.0), 6) AS growth
  FROM found WHERE nth = 1)
SELECT {cols} FROM j"""


ORACLE["timeline_1d_this_week"] = _timeline_sql("1d", "this_week")
ORACLE["timeline_1w_3m"] = _timeline_sql("1w", "3m")
ORACLE["timeline_1m_12m"] = _timeline_sql("1m", "12m")
ORACLE["growth_clipped"] = _timeline_sql("1d", "this_month", clip=True,
                                         cols='topic_id, "end", growth')

_MS = _DT(2024, 1, 1)
ORACLE["summary_this_month"] = f"""WITH {report_ctes()},
v AS (
  SELECT topic_id, sum(mentions) AS mentions, sum(engagement) AS engagement,
         sum(sentiment * mentions) AS weighted
  FROM rep
  WHERE window_type = '1d' AND start > {_ts(_MS - _dt.timedelta(seconds=1))}
    AND start < {_ts(AS_OF)}
  GROUP BY topic_id),
w AS (SELECT *, CASE WHEN mentions > 0 THEN weighted / mentions ELSE 0.0 END AS s FROM v)
SELECT topic_id, CAST(mentions AS BIGINT) AS mentions, CAST(engagement AS BIGINT) AS engagement,
       round(s, 6) AS sentiment,
       CASE WHEN s >= 0.05 THEN 'Positive' WHEN s <= -0.05 THEN 'Negative' ELSE 'Neutral' END AS label
FROM w"""

ORACLE["available_windows"] = f"""WITH {report_ctes()}
SELECT DISTINCT window_type FROM rep"""


# ---------------------------------------------------------------- dashboard
_DLO, _DHI = _DT(2023, 12, 31, 12), _DT(2024, 1, 31, 12)
_DASH_BASE = f"""{TOPIC_POSTS},
base AS (
  SELECT * FROM tp
  WHERE engagement IS NOT NULL AND sentiment_score IS NOT NULL
    AND created_at BETWEEN {_ts(_DLO)} AND {_ts(_DHI)})"""

ORACLE["kpis"] = f"""WITH {_DASH_BASE}
SELECT CASE WHEN count(*) = 0 THEN NULL ELSE count(*) END AS matched_posts,
       round(avg(sentiment_score), 6) AS avg_sentiment,
       CAST(sum(engagement) AS BIGINT) AS engagement
FROM base"""


def _daily_sql(agg: str, fill: str) -> str:
    return f"""WITH {_DASH_BASE},
pd AS (SELECT date_trunc('day', created_at) AS day, {agg} AS value FROM base GROUP BY 1),
days AS (
  SELECT CAST(unnest(generate_series(date_trunc('day', {_ts(_DLO)}),
         date_trunc('day', {_ts(_DHI)}), INTERVAL 1 DAY)) AS TIMESTAMP) AS day)
SELECT {iso('days.day')} AS day, {fill} AS value
FROM days LEFT JOIN pd ON days.day = CAST(pd.day AS TIMESTAMP)"""


ORACLE["daily_matched"] = _daily_sql("count(*)", "CAST(coalesce(pd.value, 0) AS BIGINT)")
ORACLE["daily_engagement"] = _daily_sql("CAST(sum(engagement) AS BIGINT)", "pd.value")
ORACLE["daily_sentiment"] = _daily_sql("avg(sentiment_score)", "round(pd.value, 6)")
ORACLE["topic_options"] = f"""WITH {_DASH_BASE}
SELECT topic_id, count(*) AS doc_count FROM base GROUP BY topic_id"""

# rows with gaps and old dates: every 7th post has no engagement, every 11th no
# sentiment, and every 3rd is 40 days older
_GAPS = f"""{TOPIC_POSTS},
gaps AS (
  SELECT topic_id, created_at - CASE WHEN n % 3 = 0 THEN INTERVAL 40 DAY ELSE INTERVAL 0 DAY END
           AS created_at,
         CASE WHEN n % 7 <> 0 THEN engagement END AS engagement,
         CASE WHEN n % 11 <> 0 THEN sentiment_score END AS sentiment_score
  FROM (SELECT *, CAST(substr(event_id, 4) AS BIGINT) AS n FROM tp)),
kept AS (
  SELECT * FROM gaps WHERE engagement IS NOT NULL AND sentiment_score IS NOT NULL
    AND created_at BETWEEN TIMESTAMP '2023-12-31 12:00:00' AND TIMESTAMP '2024-01-31 12:00:00')"""
ORACLE["topic_options_gaps"] = f"""WITH {_GAPS}
SELECT topic_id, count(*) AS doc_count FROM kept GROUP BY topic_id"""
ORACLE["kpis_gaps"] = f"""WITH {_GAPS}
SELECT CASE WHEN count(*) = 0 THEN NULL ELSE count(*) END AS matched_posts,
       round(avg(sentiment_score), 6) AS avg_sentiment,
       CAST(sum(engagement) AS BIGINT) AS engagement FROM kept"""
# 31 March: the month before ends on 29 February
ORACLE["kpis_month_end"] = f"""WITH {TOPIC_POSTS},
moved AS (SELECT *, created_at + INTERVAL 60 DAY AS moved_at FROM tp)
SELECT CASE WHEN count(*) = 0 THEN NULL ELSE count(*) END AS matched_posts,
       round(avg(sentiment_score), 6) AS avg_sentiment,
       CAST(sum(engagement) AS BIGINT) AS engagement
FROM moved WHERE engagement IS NOT NULL AND sentiment_score IS NOT NULL
  AND moved_at BETWEEN TIMESTAMP '2024-02-29 12:00:00' AND TIMESTAMP '2024-03-31 12:00:00'"""


# ---------------------------------------------------------------- phase 3


def _s(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


# F1 posts
POSTS = f"""
posts AS (
  SELECT 't3_' || {_s('e.event_id')} AS event_id, d.source AS subreddit,
         'u_' || {_s('e.user_id')} AS author, e.ts AS created_at, d.text, d.lang,
         CAST(floor(e.value) AS INTEGER) AS score, {K} AS num_comments,
         CAST(floor(e.value) AS INTEGER) + {K} + 1 AS engagement
  FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents))"""


def _f4_cnf(kw: str):
    import json
    try:
        v = json.loads(kw)
    except ValueError:
        return None
    if not isinstance(v, list):
        return None
    if v and isinstance(v[0], list):
        return v
    return [v] if v else []


def _group(terms: list[str]) -> str:
    """Whole-token test of one OR group (RE2)."""
    edge = r"[^\p{L}\p{N}]"
    words = "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", t.lower()) for t in terms)
    return f"(^|{edge})({words})({edge}|$)"


def _match_sql(subs: list[str], cutoff=None, text: str = "lower(text)",
               term=lambda t: t) -> str:
    parts = []
    for tid, kw in F4_TOPICS:
        cnf = _f4_cnf(kw)
        if not cnf or any(len(g) == 0 for g in cnf):
            continue
        conds = [f"regexp_matches({text}, '{_group([term(t) for t in g])}')" for g in cnf]
        if subs:
            conds.append("lower(subreddit) IN (" + ", ".join(f"'{s}'" for s in subs) + ")")
        if cutoff is not None:
            conds.append(f"created_at >= {_ts(cutoff)}")
        parts.append(f"SELECT '{tid}' AS topic_id, event_id, subreddit, created_at, engagement "
                     f"FROM posts WHERE " + " AND ".join(conds))
    return f"WITH {POSTS},\nm AS (" + "\nUNION ALL\n".join(parts) + ")"


# one topic per document: two phrases of three words, and three words; terms are
# looked for in each document once, and a post has its document's matches
_EDGE = r"[^\p{L}\p{N}]"
ORACLE["match_many_terms"] = f"""WITH {POSTS},
dw AS (SELECT doc_id, lower(text) AS lt,
             list_filter(string_split_regex(lower(text), '{NONWORD}'), lambda x: x <> '') AS w
      FROM documents),
terms AS (
  SELECT DISTINCT doc_id AS t, g, term FROM (
    SELECT doc_id, 1 AS g, unnest([CASE WHEN len(w) >= 4 THEN array_to_string(w[2:4], ' ') END,
                                   CASE WHEN len(w) >= 14 THEN array_to_string(w[12:14], ' ') END])
           AS term FROM dw
    UNION ALL SELECT doc_id, 2, unnest([w[8], w[20], w[30]]) FROM dw) WHERE term IS NOT NULL),
words AS (SELECT DISTINCT doc_id, unnest(w) AS word FROM dw),
hits AS (
  SELECT terms.t, terms.g, words.doc_id FROM terms JOIN words ON words.word = terms.term WHERE g = 2
  UNION ALL
  SELECT terms.t, terms.g, dw.doc_id
  FROM (SELECT *, string_split(term, ' ')[1] AS first FROM terms WHERE g = 1) terms
  JOIN words ON words.word = terms.first JOIN dw ON dw.doc_id = words.doc_id
  WHERE contains(dw.lt, term) AND regexp_matches(dw.lt, '(^|{_EDGE})' || term || '({_EDGE}|$)')),
whole AS (SELECT t, doc_id FROM hits GROUP BY ALL HAVING count(DISTINCT g) = 2)
SELECT 'doc-' || {_s('t')} AS topic_id, event_id, subreddit, {iso('created_at')} AS created_at, engagement
FROM whole JOIN (SELECT 't3_' || {_s('event_id')} AS event_id,
                        event_id % (SELECT count(*) FROM documents) AS doc_id FROM events) pd USING (doc_id)
JOIN posts USING (event_id)"""

_SRC09 = [f"src{i}" for i in range(10)]
_MATCH_OUT = f"\nSELECT topic_id, event_id, subreddit, {iso('created_at')} AS created_at, engagement FROM m"
ORACLE["match_cnf_narrow"] = _match_sql(_SRC09) + _MATCH_OUT
ORACLE["match_cnf_inverted"] = _match_sql([]) + _MATCH_OUT
ORACLE["match_non_latin"] = _match_sql(
    [], text=f"translate(lower(text), '{LATIN}', '{CYRILLIC}')",
    term=lambda t: t.translate(str.maketrans(LATIN, CYRILLIC))) + _MATCH_OUT
ORACLE["match_since_48h"] = _match_sql([], _DT(2024, 1, 29, 12)) + _MATCH_OUT
ORACLE["match_windows"] = f"""WITH {POSTS},
win AS (SELECT DISTINCT date_trunc('hour', ts) AS since FROM events
        WHERE event_type = 'error' AND value >= 99.9)
SELECT event_id, subreddit, {iso('created_at')} AS created_at FROM posts p
WHERE EXISTS (SELECT 1 FROM win WHERE p.created_at BETWEEN since AND since + INTERVAL 90 MINUTE)"""
ORACLE["limit_per_topic"] = _match_sql([]) + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY created_at DESC, event_id) AS rn
      FROM m)
SELECT topic_id, event_id, {iso('created_at')} AS created_at FROM r WHERE rn <= 200"""

# F4s topic catalogue (one topic per event)
CATALOG = f"""
cat AS (
  SELECT event_id AS seq,
    CASE event_id % 4 WHEN 0 THEN 'topic-' || {_s('event_id')}
                      WHEN 1 THEN 'Topic ' || upper(event_type) || ' ' || {_s('event_id')}
                      WHEN 2 THEN NULL
                      ELSE 'my-topic-id-' || {_s('event_id')} END AS id,
    'Posts about ' || event_type || ' from user ' || {_s('user_id')} AS description,
    CASE event_id % 6
      WHEN 0 THEN '[["' || event_type || '","u' || {_s('user_id')} || '"],["k' || {_s(K)} || ' '
                  || event_type || '"]]'
      WHEN 1 THEN '["' || event_type || '","  ","' || event_type || '"]'
      WHEN 2 THEN '[["' || event_type || '"," ' || event_type || ' "],[]]'
      WHEN 3 THEN event_type
      WHEN 4 THEN '[]'
      ELSE NULL END AS keywords,
    CASE WHEN event_id % 9 = 0 THEN NULL
         ELSE 'src' || {_s('user_id % 20')} || ', src' || {_s(f'{K} % 20')} || ', ,SRC'
              || {_s('event_id % 20')} END AS subreddits,
    CASE WHEN event_id % 5 = 0 THEN NULL
         ELSE '{{"lang":"' || CASE WHEN {K} % 2 = 0 THEN 'en' ELSE 'fr' END || '"}}' END
      AS filters_json
  FROM events),
catp AS (
  SELECT *,
    CASE WHEN keywords IS NULL OR NOT json_valid(keywords) THEN NULL
         WHEN json_type(keywords) <> 'ARRAY' THEN NULL
         WHEN json_array_length(keywords) = 0 THEN CAST([] AS VARCHAR[][])
         WHEN json_type(keywords, '$[0]') = 'ARRAY' THEN from_json(keywords, '[["VARCHAR"]]')
         ELSE [from_json(keywords, '["VARCHAR"]')] END AS cnf,
    CASE WHEN keywords IS NULL OR NOT json_valid(keywords) THEN NULL
         WHEN json_type(keywords) <> 'ARRAY' THEN NULL
         WHEN json_array_length(keywords) = 0 THEN NULL
         WHEN json_type(keywords, '$[0]') = 'ARRAY' THEN 'nested'
         ELSE 'flat' END AS shape
  FROM cat),
slugged AS (
  SELECT * REPLACE (
    CASE WHEN id IS NULL OR id = '' OR contains(id, 'topic-id') OR regexp_matches(id, '[A-Z\\s]')
         THEN substr(regexp_replace(regexp_replace(lower(coalesce(cnf[1][1], description)),
                     '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 30)
         ELSE id END AS id)
  FROM catp)"""

ORACLE["parse_topics"] = f"""WITH {CATALOG}
SELECT seq, CAST(to_json(cnf) AS VARCHAR) AS keywords_cnf,
       CAST(to_json(string_split(coalesce(subreddits, ''), ',')) AS VARCHAR) AS subreddit_list,
       json_extract_string(coalesce(filters_json, '{{}}'), '$.text') AS filter_text,
       json_extract_string(coalesce(filters_json, '{{}}'), '$.lang') AS filter_lang,
       json_extract_string(coalesce(filters_json, '{{}}'), '$.author') AS filter_author
FROM catp"""

_Q = "lambda t: CASE WHEN contains(t, ' ') THEN '\"' || t || '\"' ELSE t END"
ORACLE["render_cnf"] = f"""WITH {CATALOG}
SELECT seq,
  CASE WHEN shape = 'nested' THEN array_to_string(list_transform(cnf,
            lambda g: '(' || array_to_string(list_transform(g, {_Q}), ' OR ') || ')'), ' AND ')
       WHEN shape = 'flat' THEN array_to_string(list_transform(cnf[1], {_Q}), ' OR ')
       ELSE '' END AS query
FROM catp"""

ORACLE["clean_cnf"] = f"""WITH {CATALOG},
c1 AS (SELECT seq, list_filter(list_transform(cnf, lambda g: list_filter(g, lambda t: trim(t) <> '')),
                               lambda g: len(g) > 0) AS c FROM catp),
c2 AS (SELECT seq, list_transform(c, lambda g: list_transform(g, lambda t: trim(t))) AS c FROM c1)
SELECT seq, CAST(to_json(list_transform(c, lambda g: list_filter(g, lambda x, i: list_position(g, x) = i)))
       AS VARCHAR) AS clean
FROM c2"""

ORACLE["slugify"] = f"""WITH {CATALOG}
SELECT seq, id FROM slugged"""

_VALID = ("coalesce(id IS NOT NULL AND id <> '' AND keywords IS NOT NULL AND keywords <> '' "
          "AND subreddits IS NOT NULL AND subreddits <> '', false)")
ORACLE["validate_topics"] = f"""WITH {CATALOG}
SELECT seq, {_VALID} AS valid FROM cat"""

_ALLOWED = "[" + ", ".join(f"'{s}'" for s in _SRC09) + "]"
ORACLE["subreddit_checks"] = f"""WITH {CATALOG},
s AS (SELECT seq, list_filter(list_transform(string_split(coalesce(subreddits, ''), ','),
                                             lambda x: trim(x)), lambda x: x <> '') AS subs
      FROM cat)
SELECT seq, CAST(len(list_filter(subs, lambda x: trim(x) <> '')) AS INTEGER) AS n_selected,
       len(list_filter(subs, lambda x: trim(x) <> '')) <= 30 AS within_cap,
       CAST(to_json(list_filter(subs, lambda x, i: NOT list_contains({_ALLOWED}, x)
                                              AND list_position(subs, x) = i)) AS VARCHAR)
         AS not_allowed
FROM s"""

ORACLE["allowed_search"] = f"""WITH {CATALOG},
s AS (SELECT seq, list_filter(list_transform(string_split(coalesce(subreddits, ''), ','),
                                             lambda x: trim(x)), lambda x: x <> '') AS subs
      FROM cat)
SELECT seq, CAST(to_json(list_filter(subs, lambda x: contains(lower(x), 'rc1'))) AS VARCHAR) AS found
FROM s"""

_EXISTING = ("SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t, _ in F4_TOPICS)
             + ", ('click'), ('signup')) AS x(id)")
ORACLE["append_topics"] = f"""WITH {CATALOG},
v AS (SELECT *, {_VALID} AS ok FROM slugged),
r AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn,
         id IN ({_EXISTING}) AS stored
  FROM v WHERE ok)
SELECT seq, id, CASE WHEN stored OR rn > 1 THEN 'duplicate' ELSE 'inserted' END AS outcome,
       coalesce(description, '') AS description, coalesce(filters_json, '{{}}') AS filters_json,
       60 AS update_frequency_seconds, '2024-01-31T12:00:00.000Z' AS created_at,
       'IDLE' AS backfill_status
FROM r
UNION ALL
SELECT seq, id, 'invalid', coalesce(description, ''), coalesce(filters_json, '{{}}'), 60,
       '2024-01-31T12:00:00.000Z', 'IDLE'
FROM v WHERE NOT ok"""

ORACLE["insert_topics"] = f"""WITH {CATALOG},
v AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 0 ELSE 1 END AS batch FROM slugged WHERE {_VALID}),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch, seq) AS rn FROM v)
SELECT batch, seq, id, coalesce(description, '') AS description,
       coalesce(filters_json, '{{}}') AS filters_json, 60 AS update_frequency_seconds,
       '2024-01-31T12:00:00.000Z' AS created_at, 'IDLE' AS backfill_status
FROM r WHERE rn = 1"""

ORACLE["stored_catalogue"] = f"""WITH {CATALOG}
SELECT s.seq, s.id, CAST(to_json(c.cnf) AS VARCHAR) AS keywords_cnf,
       CAST(to_json(string_split(coalesce(c.subreddits, ''), ',')) AS VARCHAR) AS subreddit_list
FROM slugged s JOIN catp c ON c.seq = s.seq"""

ORACLE["tasks_with_topic"] = f"""WITH {CATALOG},
tasks AS (
  SELECT event_id AS task_seq,
         json_extract_string(CASE WHEN event_type <> 'error' THEN
           '{{"topic_id":"topic-' || {_s('event_id * 2')} || '","subreddits":["src1"]}}' END,
           '$.topic_id') AS topic_id
  FROM events)
SELECT t.task_seq, t.topic_id, 'accepted' AS status, s.description
FROM tasks t JOIN slugged s ON t.topic_id = s.id
UNION ALL
SELECT t.task_seq, t.topic_id, 'rejected', NULL
FROM tasks t WHERE NOT EXISTS (SELECT 1 FROM slugged s WHERE s.id = t.topic_id)"""


# ---------------------------------------------------------------- phase 4

_NOW_S = float(AS_OF.replace(tzinfo=_dt.timezone.utc).timestamp())
_AS_OF_ISO = AS_OF.strftime("%Y-%m-%dT%H:%M:%S.000Z")


def _parse_int(c: str) -> str:
    return (f"TRY_CAST(regexp_extract(CASE WHEN {c} IS NULL OR {c} = '' THEN '0' ELSE {c} END, "
            f"'^\\s*([+-]?[0-9]+)', 1) AS INTEGER)")


ORACLE["normalize_posts"] = f"""WITH raw AS (
  SELECT e.event_id AS i, e.user_id, e.ts, e.value, {K} AS k, d.text, d.source
  FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)),
r AS (
  SELECT CASE WHEN i % 7 = 0 THEN NULL ELSE lower(hex(i)) END AS id,
         CASE WHEN i % 5 = 0 OR i % 7 = 0 THEN NULL ELSE 't3_' || lower(hex(i)) END AS name,
         source AS subreddit,
         CASE WHEN i % 4 = 0 THEN NULL ELSE 'u_' || {_s('user_id')} END AS author,
         CASE WHEN i % 17 = 0 THEN NULL ELSE CAST(epoch_us(ts) AS DOUBLE) / 1e6 END AS created_utc,
         CASE WHEN i % 13 = 0 THEN 'n/a'
              WHEN i % 11 = 0 THEN {_s('CAST(floor(value) AS BIGINT)')} || '.7'
              ELSE {_s('CAST(floor(value) AS BIGINT)')} END AS score,
         CASE WHEN i % 3 = 0 THEN NULL ELSE 'post ' || {_s('i')} END AS title,
         text AS selftext, {_s('k')} AS num_comments
  FROM raw),
n AS (
  SELECT *, CASE WHEN created_utc IS NULL OR created_utc = 0 OR isnan(created_utc)
                 THEN {_NOW_S} ELSE created_utc END AS secs
  FROM r WHERE id IS NOT NULL AND id <> '')
SELECT coalesce(nullif(name, ''), id) AS event_id, 'post' AS event_type,
       coalesce(subreddit, '') AS subreddit, nullif(author, '') AS author,
       {iso("epoch_ms(CAST(trunc(secs * 1000.0) AS BIGINT))")} AS created_utc,
       {_parse_int('score')} AS score,
       '{_AS_OF_ISO}' AS ingested_at,
       coalesce(title, '') || chr(10) || coalesce(selftext, '') AS text,
       {_parse_int('num_comments')} AS num_comments
FROM n"""

_RT = f"""{POSTS},
rt AS (
  SELECT CASE WHEN ok THEN 'topic-' || subreddit END AS topic_id,
         CASE WHEN ok THEN event_id END AS event_id,
         CASE WHEN ok THEN {iso('created_at')} END AS created_utc,
         CASE WHEN ok THEN text END AS text,
         CASE WHEN ok THEN score END AS score,
         CASE WHEN ok THEN num_comments END AS num_comments,
         CASE WHEN ok THEN subreddit END AS subreddit,
         CASE WHEN ok THEN author END AS author,
         CASE WHEN ok THEN engagement END AS engagement,
         CASE WHEN ok THEN {iso('created_at')} END AS "timestamp",
         CASE WHEN ok THEN 'matched_post' END AS event_type
  FROM (SELECT *, num_comments <> 0 AS ok FROM posts))"""

ORACLE["event_json_roundtrip"] = f"WITH {_RT}\nSELECT * FROM rt"

ORACLE["event_rejects"] = f"""WITH {POSTS}
SELECT CASE WHEN num_comments = 0 THEN '{{"event_id":"' || event_id || '","score":'
            WHEN score % 17 = 0 THEN '{{"event_id":"' || event_id || '"}}' ELSE ' ' END AS value,
       CASE WHEN num_comments = 0 THEN 'malformed' WHEN score % 17 = 0 THEN 'no topic_id'
            ELSE 'empty' END AS reason
FROM posts WHERE num_comments = 0 OR score % 17 = 0 OR score % 19 = 0"""

ORACLE["event_time"] = f"""WITH {_RT},
t AS (SELECT event_id, CASE WHEN score % 13 = 0 THEN 'not-a-date' ELSE "timestamp" END AS ts FROM rt)
SELECT event_id, ts AS "timestamp",
       {iso(f"coalesce(TRY_CAST(ts AS TIMESTAMP), {_ts(AS_OF)})")} AS event_ts
FROM t"""

_LEX = "SELECT * FROM (VALUES " + ", ".join(
    "('{}', {}, {}, {})".format(w, "NULL" if p is None else f"CAST({p} AS DOUBLE)",
                                f"CAST({i} AS DOUBLE)", "true" if n else "false")
    for w, p, i, n in DEFAULT_LEXICON) + ") AS x(word, polarity, intensity, negation)"

# words whose md5 begins with 0, polarity by its next four digits
_LARGE_LEX = f"""SELECT * FROM ({_LEX}) UNION ALL
  SELECT word, (CAST('0x' || substr(md5(word), 2, 4) AS INTEGER) % 201 - 100) / 100.0, 1.0, false
  FROM (SELECT DISTINCT unnest(string_split_regex(lower(text), '{NONWORD}')) AS word FROM documents)
  WHERE word <> '' AND md5(word) LIKE '0%' AND word NOT IN (SELECT word FROM ({_LEX}))"""


def _doc_sentiment(lexicon: str) -> str:
    """m: the score of each document (a post's text is its document's); pd: post to document."""
    return f"""lex AS ({lexicon}),
tk AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{NONWORD}'),
                                  lambda t: t <> '') AS toks
       FROM documents),
ti AS (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM tk),
tp AS (SELECT doc_id, toks[i] AS tok, CASE WHEN i > 1 THEN toks[i - 1] END AS prev FROM ti),
v AS (
  SELECT tp.doc_id,
         lw.polarity * coalesce(lm.intensity, 1.0)
           * CASE WHEN ln.word IS NOT NULL THEN {NEGATION_FACTOR} ELSE 1.0 END AS v
  FROM tp JOIN lex lw ON lw.word = tp.tok AND lw.polarity IS NOT NULL
          LEFT JOIN lex lm ON lm.word = tp.prev AND lm.polarity IS NULL
          LEFT JOIN lex ln ON ln.word = tp.prev AND ln.negation),
a AS (SELECT doc_id, avg(v) AS m FROM v GROUP BY 1),
pd AS (SELECT 't3_' || {_s('event_id')} AS event_id,
              event_id % (SELECT count(*) FROM documents) AS doc_id FROM events)"""


_SCORE = """round(CAST(CAST(greatest(least(coalesce(a.m, 0.0), 1.0), -1.0) AS FLOAT) AS DOUBLE), 6)
         AS sentiment_score"""


def _post_sentiment(lexicon: str) -> str:
    return f"""WITH {_doc_sentiment(lexicon)}
SELECT pd.event_id, {_SCORE}
FROM pd JOIN documents d ON d.doc_id = pd.doc_id LEFT JOIN a ON a.doc_id = pd.doc_id"""


ORACLE["sentiment_lexicon"] = _post_sentiment(_LEX)
ORACLE["sentiment_large_lexicon"] = _post_sentiment(_LARGE_LEX)

_LOG = f"""pl AS (
  SELECT event_type AS topic_id, {_s('user_id')} AS event_id, ts AS arrival_ts, event_id AS seq,
         CAST(floor(value) AS INTEGER) AS score,
         CASE WHEN {K} % 10 = 0 THEN NULL ELSE {K} END AS num_comments,
         CASE WHEN value < 20 THEN NULL ELSE value / 100.0 END AS sentiment_score
  FROM events)"""

_ORD = "{'a': arrival_ts, 'b': seq}"
ORACLE["current_posts_merge"] = f"""WITH {_LOG}
SELECT topic_id, event_id,
       arg_max(score, {_ORD}) FILTER (WHERE score IS NOT NULL) AS score,
       arg_max(num_comments, {_ORD}) FILTER (WHERE num_comments IS NOT NULL) AS num_comments,
       round(arg_max(sentiment_score, {_ORD}) FILTER (WHERE sentiment_score IS NOT NULL), 6)
         AS sentiment_score,
       {iso('max(arrival_ts)')} AS last_seen, count(*) AS versions
FROM pl GROUP BY topic_id, event_id"""

ORACLE["latest_rows"] = f"""WITH {_LOG},
r AS (SELECT *, row_number() OVER (PARTITION BY topic_id, event_id
                                   ORDER BY arrival_ts DESC, seq DESC) AS rn FROM pl)
SELECT topic_id, event_id, {iso('arrival_ts')} AS arrival_ts, seq, score, num_comments,
       round(sentiment_score, 6) AS sentiment_score
FROM r WHERE rn = 1"""


# ---------------------------------------------------------------- phase 6
def _enriched(lexicon: str) -> str:
    return f"""WITH {_RT}, {_doc_sentiment(lexicon)}
SELECT rt.event_id, rt.topic_id, {_SCORE}
FROM rt LEFT JOIN pd ON pd.event_id = rt.event_id LEFT JOIN a ON a.doc_id = pd.doc_id"""


ORACLE["stream_enrich"] = _enriched(_LEX)
ORACLE["stream_enrich_large_lexicon"] = _enriched(_LARGE_LEX)

ORACLE["stream_upsert"] = ORACLE["current_posts_merge"]

_BF_CUT = _DT(2024, 1, 1, 12)
ORACLE["backfill_run"] = (_match_sql([], _BF_CUT)
                          + f"\nSELECT DISTINCT topic_id, event_id, {iso('created_at')} AS created_at FROM m")

_CUT_S = float(_BF_CUT.replace(tzinfo=_dt.timezone.utc).timestamp())
ORACLE["backfill_progress"] = _match_sql([], _BF_CUT) + f""",
o AS (SELECT topic_id, min(created_at) AS oldest FROM m GROUP BY 1)
SELECT topic_id, {iso('oldest')} AS oldest_seen,
       CAST(floor(least(greatest(({_NOW_S} - epoch_us(oldest) / 1e6)
                                 / ({_NOW_S} - {_CUT_S}) * 100.0, 0), 100) + 0.5) AS INTEGER)
         AS percentage
FROM o"""

_F4_LIST = "[" + ", ".join(f"'{t}'" for t, _ in F4_TOPICS) + "]"
ORACLE["topic_status"] = f"""WITH se AS (
  SELECT {_F4_LIST}[CAST(event_id % {len(F4_TOPICS)} + 1 AS INTEGER)] AS topic_id,
         CASE WHEN event_id % 3 = 0 THEN 'PENDING' WHEN event_id % 3 = 2 THEN 'COMPLETED' END
           AS status,
         CASE WHEN event_id % 3 = 1 THEN value END AS percentage,
         event_id AS seq
  FROM events)
SELECT topic_id,
       arg_max(status, seq) FILTER (WHERE status IS NOT NULL) AS status,
       round(arg_max(percentage, seq) FILTER (WHERE percentage IS NOT NULL), 6) AS percentage,
       count(*) AS versions
FROM se GROUP BY topic_id"""


# ---------------------------------------------------------------- phase 7
ORACLE["sentiment_split"] = f"""WITH {TOPIC_POSTS},
d AS (
  SELECT topic_id, date_trunc('day', created_at) AS day,
         count(*) FILTER (WHERE sentiment_score >= 0.05) AS pos,
         count(*) FILTER (WHERE sentiment_score <= -0.05) AS neg, count(*) AS n
  FROM tp GROUP BY 1, 2),
g AS (
  SELECT topic_id, '1d' AS window_type, day AS start, pos, neg, n FROM d
  UNION ALL SELECT topic_id, '1w', date_trunc('week', day), pos, neg, n FROM d
  UNION ALL SELECT topic_id, '1m', date_trunc('month', day), pos, neg, n FROM d)
SELECT topic_id, window_type, {iso('start')} AS start, CAST(sum(pos) AS BIGINT) AS positive,
       CAST(sum(neg) AS BIGINT) AS negative, CAST(sum(n) - sum(pos) - sum(neg) AS BIGINT) AS neutral
FROM g GROUP BY topic_id, window_type, start"""

ORACLE["top_keywords"] = _match_sql([]) + f""",
mt AS (SELECT m.topic_id, m.event_id, m.created_at, p.text FROM m JOIN posts p USING (event_id)),
tk AS (
  SELECT topic_id, date_trunc('day', created_at) AS day,
         unnest(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '{NONWORD}'),
                                          lambda t: t <> ''))) AS key
  FROM mt),
d AS (SELECT topic_id, day, key, count(*) AS c FROM tk GROUP BY 1, 2, 3),
g AS (
  SELECT topic_id, '1d' AS window_type, day AS start, key, c FROM d
  UNION ALL SELECT topic_id, '1w', date_trunc('week', day), key, c FROM d
  UNION ALL SELECT topic_id, '1m', date_trunc('month', day), key, c FROM d),
b AS (SELECT topic_id, window_type, start, key, sum(c) AS doc_count FROM g GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY topic_id, window_type, start
                                   ORDER BY doc_count DESC, key) AS rank FROM b)
SELECT topic_id, window_type, {iso('start')} AS start, key, CAST(doc_count AS BIGINT) AS doc_count,
       CAST(rank AS INTEGER) AS rank
FROM r WHERE rank <= 5"""

ORACLE["top_keywords_arrays"] = f"""
SELECT topic_id, window_type, start,
       CAST(to_json(list({{'key': key, 'doc_count': doc_count}} ORDER BY rank)) AS VARCHAR)
         AS top_keywords
FROM ({ORACLE["top_keywords"]}) GROUP BY 1, 2, 3"""

ORACLE["topic_filters"] = _match_sql([]) + f""",
mt AS (SELECT m.*, p.text, p.lang, p.author FROM m JOIN posts p USING (event_id))
SELECT topic_id, event_id, subreddit, {iso('created_at')} AS created_at, engagement FROM mt
WHERE (topic_id = 'cnf-two' AND lower(lang) = 'en')
   OR (topic_id = 'phrase' AND contains(lower(text), 'best'))
   OR (topic_id = 'flat' AND lower(lang) = 'fr' AND author = 'u_7')"""


# ---------------------------------------------------------------- remaining inventory
ORACLE["kpis_picked"] = f"""WITH {_DASH_BASE}
SELECT CASE WHEN count(*) = 0 THEN NULL ELSE count(*) END AS matched_posts,
       round(avg(sentiment_score), 6) AS avg_sentiment,
       CAST(sum(engagement) AS BIGINT) AS engagement
FROM base WHERE topic_id IN ('click', 'view')"""

_ALLOWED_TASK = "[" + ", ".join(f"'{s}'" for s in _SRC09 + ["src3"]) + "]"
ORACLE["backfill_tasks"] = f"""WITH {CATALOG}
SELECT '{{"topic_id":"' || id || '","subreddits":' || to_json({_ALLOWED_TASK}) || '}}' AS value
FROM slugged"""

ORACLE["raw_feed_json"] = ORACLE["normalize_posts"]

_C0 = _DT(2024, 1, 29, 11)
_C1 = _DT(2024, 1, 29, 12)
ORACLE["sync_resend"] = _match_sql([], _C0) + f""",
j AS (SELECT m.topic_id, m.event_id, m.created_at, p.score, p.num_comments,
             m.created_at >= {_ts(_C1)} AS fresh
      FROM m JOIN posts p ON p.event_id = m.event_id)
SELECT topic_id, event_id, score + CASE WHEN fresh THEN 1 ELSE 0 END AS score,
       score + CASE WHEN fresh THEN 1 ELSE 0 END + num_comments + 1 AS engagement,
       {iso('created_at')} AS created_at, CAST(CASE WHEN fresh THEN 2 ELSE 1 END AS BIGINT) AS versions
FROM j"""


# ---------------------------------------------------------------- more ranges, S6, U2
ORACLE["timeline_1w_this_month"] = _timeline_sql("1w", "this_month")
ORACLE["timeline_1m_6m"] = _timeline_sql("1m", "6m")
_WS = _DT(2024, 1, 29)
ORACLE["summary_this_week"] = ORACLE["summary_this_month"].replace(
    _ts(_MS - _dt.timedelta(seconds=1)), _ts(_WS - _dt.timedelta(seconds=1)))
ORACLE["summary_12m"] = ORACLE["summary_this_month"].replace(
    _ts(_MS - _dt.timedelta(seconds=1)), _ts(_DT(2023, 1, 31, 23, 59, 59)))
for _w, _r in (("1d", "3m"), ("1d", "this_month"), ("1w", "6m"), ("1m", "3m")):
    ORACLE[f"timeline_{_w}_{_r}"] = _timeline_sql(_w, _r)
ORACLE["topic_by_id"] = f"""WITH {CATALOG}
SELECT seq, id, description, keywords, subreddits FROM slugged WHERE id = 'topic-40'"""

ORACLE["sentiment_model"] = f"""WITH lex AS ({_LEX}),
tk AS (SELECT doc_id, unnest(string_split_regex(lower(text), '{NONWORD}')) AS tok FROM documents),
a AS (SELECT tk.doc_id, avg(lex.polarity) AS m FROM tk JOIN lex ON lex.word = tk.tok
      WHERE lex.polarity IS NOT NULL GROUP BY 1),
pd AS (SELECT 't3_' || {_s('event_id')} AS event_id,
              event_id % (SELECT count(*) FROM documents) AS doc_id FROM events)
SELECT pd.event_id, {_SCORE}
FROM pd JOIN documents d ON d.doc_id = pd.doc_id LEFT JOIN a ON a.doc_id = pd.doc_id"""


# ---------------------------------------------------------------- end to end
_TRENDS_SRC = _match_sql([]).replace("WITH ", "", 1) + f""",
lex AS ({_LEX}),
tk AS (
  SELECT event_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{NONWORD}'),
                               lambda t: t <> '') AS toks
  FROM posts),
ti AS (SELECT event_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM tk),
tpp AS (SELECT event_id, toks[i] AS tok, CASE WHEN i > 1 THEN toks[i - 1] END AS prev FROM ti),
v AS (
  SELECT tpp.event_id,
         lw.polarity * coalesce(lm.intensity, 1.0)
           * CASE WHEN ln.word IS NOT NULL THEN {NEGATION_FACTOR} ELSE 1.0 END AS v
  FROM tpp JOIN lex lw ON lw.word = tpp.tok AND lw.polarity IS NOT NULL
           LEFT JOIN lex lm ON lm.word = tpp.prev AND lm.polarity IS NULL
           LEFT JOIN lex ln ON ln.word = tpp.prev AND ln.negation),
a AS (SELECT event_id, avg(v) AS mm FROM v GROUP BY 1),
tp AS (
  SELECT m.topic_id, m.created_at, m.engagement,
         CAST(CAST(greatest(least(coalesce(a.mm, 0.0), 1.0), -1.0) AS FLOAT) AS DOUBLE)
           AS sentiment_score
  FROM m LEFT JOIN a ON a.event_id = m.event_id)"""

ORACLE["topic_trends"] = ("WITH " + report_ctes(source=_TRENDS_SRC,
                                                extra_topics=[t for t, _ in F4_TOPICS])
                          + REPORT_SELECT)

ORACLE["pipeline_report"] = ORACLE["topic_trends"]
_TASK_IDS = [t for t, _ in F4_TOPICS] + ["ghost-topic"]
ORACLE["backfill_status"] = f"""WITH tasks AS (
  SELECT [{", ".join(f"'{t}'" for t in _TASK_IDS)}][event_id % {len(_TASK_IDS)} + 1] AS topic_id
  FROM events)
SELECT topic_id,
       CASE WHEN topic_id <> 'ghost-topic' THEN 'COMPLETED' END AS status,
       CASE WHEN topic_id <> 'ghost-topic' THEN CAST(100.0 AS DOUBLE) END AS percentage,
       CASE WHEN topic_id = 'ghost-topic' THEN count(*) END AS rejected
FROM tasks GROUP BY topic_id"""
# the window of 30 days in three slices, newest first
_SPANS = [("TIMESTAMP '2024-01-21 12:00:00'", "TIMESTAMP '9999-01-01'"),
          ("TIMESTAMP '2024-01-11 12:00:00'", "TIMESTAMP '2024-01-21 12:00:00'"),
          ("TIMESTAMP '2024-01-01 12:00:00'", "TIMESTAMP '2024-01-11 12:00:00'")]
ORACLE["backfill_steps"] = _match_sql([], _BF_CUT) + """,
steps AS (
  SELECT 'PENDING' AS status, NULL::DOUBLE AS percentage, 0 AS seq, 0 AS slice_rows, NULL::TIMESTAMP AS o
  UNION ALL SELECT 'COMPLETED', 100.0, 4, 0, NULL
""" + "".join(f"""  UNION ALL
  SELECT NULL, round(100.0 * {i} / 3, 6), {i}, count(*), min(created_at) FROM m
  WHERE created_at >= {lo} AND created_at < {hi}
""" for i, (lo, hi) in enumerate(_SPANS, 1)) + f""")
SELECT t.topic_id, status, percentage, CAST(seq AS BIGINT) AS seq, CAST(slice_rows AS BIGINT) AS slice_rows,
       {iso('o')} AS slice_oldest
FROM steps, (SELECT unnest([{", ".join(f"'{t}'" for t, _ in F4_TOPICS)}]) AS topic_id) t"""
ORACLE["report_from_log"] = ORACLE["report_all_topics"]

ORACLE["report_incremental"] = ORACLE["report_from_log"]

"""Topic-rule column functions: keyword decoding, CNF hygiene, rendering, ids.

Keywords are stored as JSON text: a nested list is CNF (AND of OR groups),
a flat list is one OR group, anything else (raw text) has no usable rules.
All functions are native column expressions (higher-order functions), so
they run inside whole-stage code generation with no Python round trip.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicpulse.schemas import FILTERS_DDL

# At most 30 subreddits per topic; slug length 30.
SUBREDDIT_CAP = 30
SLUG_LEN = 30

_CNF = "array<array<string>>"
_FLAT = "array<string>"


def _nested(kw: Column) -> Column:
    return F.from_json(kw, _CNF)


def _flat(kw: Column) -> Column:
    return F.from_json(kw, _FLAT)


def parse_keywords(kw: Column) -> Column:
    """C1 + C4: keyword JSON → CNF ``array<array<string>>``.

    Nested list → as is; flat list → one OR group; ``[]`` → ``[]`` (no
    rules); raw text / null → null (no rules).  Nested is tried first: a
    flat parse of a nested list would yield JSON fragments as strings.
    """
    n = _nested(kw)
    f = _flat(kw)
    return (F.when(n.isNotNull(), n)
             .when(f.isNotNull() & (F.size(f) > 0), F.array(f))
             .when(f.isNotNull(), F.array().cast(_CNF)))


def parse_csv(c: Column, clean: bool = False) -> Column:
    """CSV → array; ``clean`` trims entries and drops empty ones."""
    parts = F.split(F.coalesce(c, F.lit("")), ",")
    if not clean:
        return parts
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != F.lit(""))


def parse_filters(c: Column) -> Column:
    """Filters JSON → struct<text, lang, author>, default ``{}``."""
    return F.from_json(F.coalesce(c, F.lit("{}")), FILTERS_DDL)


def clean_cnf(cnf: Column) -> Column:
    """Drop blank terms (trim test only), then drop empty groups."""
    groups = F.transform(cnf, lambda g: F.filter(g, lambda t: F.trim(t) != F.lit("")))
    return F.filter(groups, lambda g: F.size(g) > 0)


def dedupe_terms(cnf: Column) -> Column:
    """Trim terms and keep the first of exact duplicates inside a group."""
    return F.transform(cnf, lambda g: F.array_distinct(F.transform(g, lambda t: F.trim(t))))


def _quote(t: Column) -> Column:
    return F.when(F.instr(t, " ") > 0, F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t)


def render_keywords(kw: Column) -> Column:
    """Keyword JSON → search text.

    CNF ``(a OR "b c") AND (d)``; flat list ``a OR b``; empty list, raw
    text or null → ``""``.  Terms holding a space are quoted.
    """
    n = _nested(kw)
    f = _flat(kw)
    cnf_txt = F.array_join(F.transform(
        n, lambda g: F.concat(F.lit("("), F.array_join(F.transform(g, _quote), " OR "), F.lit(")"))),
        " AND ")
    flat_txt = F.array_join(F.transform(f, _quote), " OR ")
    return (F.when(n.isNotNull() & (F.size(n) > 0), cnf_txt)
             .when(f.isNotNull() & (F.size(f) > 0), flat_txt)
             .otherwise(F.lit("")))


def slugify(c: Column) -> Column:
    """Lower, non-alphanumeric runs → '-', strip edge '-', then cut to 30."""
    s = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-|-$", "")
    return F.substring(s, 1, SLUG_LEN)


def needs_slug(id_col: Column) -> Column:
    """C8 trigger: id missing, contains 'topic-id', or has upper case / space."""
    return (id_col.isNull() | (id_col == F.lit("")) | (F.instr(id_col, "topic-id") > 0)
            | id_col.rlike(r"[A-Z\s]"))


def ensure_topic_id(id_col: Column, keywords_json: Column, description: Column) -> Column:
    """Keep a good id, else slug of the first keyword term or description."""
    cnf = parse_keywords(keywords_json)
    first_term = F.try_element_at(F.try_element_at(cnf, F.lit(1)), F.lit(1))
    src = F.coalesce(F.nullif(first_term, F.lit("")), description)
    return F.when(needs_slug(id_col), slugify(src)).otherwise(id_col)


def subreddit_count(subs: Column) -> Column:
    """Number of selected (non-blank) subreddits."""
    return F.size(F.filter(subs, lambda s: F.trim(s) != F.lit("")))


def within_cap(subs: Column) -> Column:
    """Selection respects the 30-subreddit cap."""
    return subreddit_count(subs) <= F.lit(SUBREDDIT_CAP)


def search_allowed(allowed: Column, q: str) -> Column:
    """Allowed subreddits containing ``q``, case-insensitive."""
    return F.filter(allowed, lambda s: F.instr(F.lower(s), q.lower()) > 0)


def not_allowed(subs: Column, allowed: Column) -> Column:
    """C14: chosen subreddits that are not in the allowed list."""
    return F.array_except(subs, allowed)

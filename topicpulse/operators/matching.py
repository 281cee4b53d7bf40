"""Match posts to topics (CNF keyword rules × subreddits × cutoff).

Match semantics: lower-cased whole-token match on the post text — a term
matches where it is preceded and followed by a character that is neither letter
nor digit, in any script (or the text edge); a term holding a space is a contiguous phrase.  A topic
matches when every OR group has a matching term.  A topic without rules, or
with an empty group, never matches.  A topic whose subreddit list is empty
is not restricted; otherwise the post's subreddit must be in the list
(case-insensitive).  One output row per (post, matching topic).

Two physical strategies, same rows, whatever the posts' ids (a post that was
sent again is a row of its own, and a post without an id is matched too):

* ``narrow``   — the topic catalogue is small (checked with a bounded
  ``limit(n+1)`` fetch).  The topics become a literal array of ``CASE WHEN``
  expressions over the listed words that a post holds, and one ``explode`` emits
  the matches.  One stage, no shuffle, regexes compiled once per task.  Few listed
  words are each searched in the text, so only matching posts are tokenised, and
  those only for callers that want the tokens; of many words the post's tokens are
  compared with the list.
* ``inverted`` — any catalogue size.  A topic can only match where one of its OR
  groups does, so it is looked up by a single group: one of phrases rather than of
  single words, then the one whose keys are found in fewest posts (if a frequency
  table is given), then the one of the longest keys.  Each term of that group is
  keyed by one of its alphanumeric runs (every run of a matching term is a whole
  token of the text, so this is a necessary condition), the one found in fewest
  posts if a frequency table is given, else the longest; in a catalogue of many
  phrases by two or three neighbouring runs, which are neighbouring tokens of the text; terms
  of symbols alone are keyed by a symbol that the post must hold.  A literal of the
  keys, or of many keys a table of hash buckets of fixed size, drops other tokens
  before they are exploded, and posts without any key altogether.  What is left is
  equi-joined with the term table, whose rows carry the rules that are looked up by
  their term, each once for all its topics: a hit is verified where it lies (the term once,
  then single words among the few tokens of the post that these rules need, phrases and
  punctuated terms by the exact regex) and counts if no earlier term of its group
  matches, so each post and topic is emitted once.  The term table is broadcast when
  its bytes are below a bound: no post is shuffled then.  Beyond that the join is a
  salted shuffle join so one very common token cannot pile up in a single task; the
  post itself travels on its first token and meets its hits by its row number.
"""

from __future__ import annotations

import datetime as _dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicpulse.functions.calendar import ts_lit
from topicpulse.functions.rules import parse_csv, parse_keywords
from topicpulse.session import PARQUET_OPTIONS, scratch_dir
from topicpulse.sources.poststore import DATE_COL

# Tunables (not reference values).
NARROW_MAX_TOPICS = 256
NARROW_MAX_TERMS = 4096
BROADCAST_MAX_BYTES = 32 * 1024 * 1024
SALT_BUCKETS = 16
KEY_BUCKETS = 1 << 16          # bytes of the table that drops tokens before the explode
LITERAL_MAX_KEYS = 512         # keys compared as a literal array instead of by the table
PAIR_MIN_PHRASES = 256         # phrases from which they are keyed by neighbouring runs
SEARCH_MAX_WORDS = 16          # words searched in the text one by one instead of among its tokens

_META = re.compile(r"([\\.^$|?*+()\[\]{}])")
# Letters and digits of any script make a token.
_SPLIT = r"[^\p{L}\p{N}]+"
_SIMPLE = r"^[\p{L}\p{N}]+$"
_BOUND_L = r"(^|[^\p{L}\p{N}])"
_BOUND_R = r"([^\p{L}\p{N}]|$)"


def escape_term(term: str) -> str:
    """Escape regex metacharacters (valid for Java regex and RE2 alike)."""
    return _META.sub(r"\\\1", term)


def group_regex(terms: list[str]) -> str:
    alts = "|".join(escape_term(t.lower()) for t in terms)
    return f"{_BOUND_L}({alts}){_BOUND_R}"


def whole_term(term: str) -> str:
    """A regex for the term between non-alphanumeric characters or the text's edges.

    The literal stands first, so Java skips to it (Boyer-Moore) and tests the edges only
    there.  The one letter beyond the 16-bit range makes it look back by whole characters.
    """
    lit = escape_term(term)
    return f"{lit}(?<![\\p{{L}}\\p{{N}}\U00010400]{lit})(?![\\p{{L}}\\p{{N}}])"


def prepare_topics(topics: DataFrame) -> DataFrame:
    """topic_id, cnf (lower-cased terms), subs (clean, lower-cased list).

    Accepts the stored catalogue (id, keywords JSON, subreddits CSV) or an
    already parsed one (topic_id, cnf, subs).
    """
    cols = set(topics.columns)
    if "cnf" in cols:
        t = topics.select("topic_id", "cnf", "subs")
    else:
        tid = F.col("topic_id") if "topic_id" in cols else F.col("id")
        t = topics.select(tid.alias("topic_id"),
                          parse_keywords(F.col("keywords")).alias("cnf"),
                          parse_csv(F.col("subreddits"), clean=True).alias("subs"))
    return t.select(
        "topic_id",
        F.transform("cnf", lambda g: F.transform(g, lambda x: F.lower(x))).alias("cnf"),
        F.transform("subs", lambda s: F.lower(s)).alias("subs"))


def _since(posts: DataFrame, cutoff: _dt.datetime | None, ts_col: str) -> DataFrame:
    """Keep ``created >= cutoff`` (an older post is strictly before it).

    Posts that still carry the store's day column (``sources.poststore``) are
    pruned by it first.
    """
    if cutoff is not None:
        if DATE_COL in posts.columns:
            posts = posts.where(F.col(DATE_COL) >= F.lit(cutoff.date()))
        posts = posts.where(F.col(ts_col) >= ts_lit(cutoff))
    return posts.drop(DATE_COL)


def _sub_ok(subs: list[str] | Column, sub_col: Column) -> Column:
    if isinstance(subs, Column):
        return (F.size(subs) == 0) | F.array_contains(subs, F.lower(sub_col))
    if not subs:
        return F.lit(True)
    return F.lower(sub_col).isin(list(subs))


def _spaced(lt: Column, term: Column) -> Column:
    """Whether the term stands between spaces or the text's edges: found by a plain search,
    this spares most texts that hold the term the boundary regex."""
    space = F.lit(" ")
    return F.instr(F.concat(space, lt, space), F.concat(space, term, space)) > 0


def _boundary(term: Column | str) -> Column:
    """A regex for the term of a column between edges or non-alphanumeric characters."""
    return F.concat(F.lit(_BOUND_L + "("), F.regexp_replace(term, _META.pattern, r"\\$1"), F.lit(")" + _BOUND_R))


def _group_condition(terms: list[str], lt: Column, words: Column) -> Column:
    """Exact whole-token test for one OR group.

    A single-word term matches exactly when it is one of the text's maximal
    alphanumeric runs, so those terms become one ``arrays_overlap`` with the
    listed words of the post.  Phrases and punctuated terms are searched.
    """
    simple = [t for t in terms if t.isalnum()]
    other = [t for t in terms if not t.isalnum()]
    conds = []
    if simple:
        conds.append(F.arrays_overlap(words, F.array(*[F.lit(t) for t in simple])))
    for t in other:
        conds.append(lt.rlike(whole_term(t)))
    return reduce(lambda a, b: a | b, conds)


def match_narrow(posts: DataFrame, topics: DataFrame, cutoff: _dt.datetime | None = None,
                 ts_col: str = "created_at", tokens_col: str | None = None) -> DataFrame:
    t = prepare_topics(topics)
    rows = t.limit(NARROW_MAX_TOPICS + 1).collect()
    if len(rows) > NARROW_MAX_TOPICS:
        raise ValueError("topic catalogue too large for the narrow plan; use 'inverted'")
    if sum(len(g) for r in rows for g in (r.cnf or [])) > NARROW_MAX_TERMS:
        raise ValueError("too many terms for the narrow plan; use 'inverted'")
    # Lower-cased text, its listed words and the hits are projected once and referenced
    # by what follows (Catalyst keeps a multiply-used, non-cheap alias).
    lt, toks, words = F.col("_tp_lt"), F.col("_tp_toks"), F.col("_tp_words")
    cases, simple, subs = [], set(), set()
    for r in rows:
        cnf = r.cnf
        if not cnf or any(len(g) == 0 for g in cnf):
            continue  # no rules / empty group: never matches
        cond = reduce(lambda a, b: a & b, [_group_condition(g, lt, words) for g in cnf])
        cond = _sub_ok(r.subs, F.col("subreddit")) & cond
        cases.append(F.when(cond, F.lit(r.topic_id)))
        simple.update(t for g in cnf for t in g if t.isalnum())
        subs.add(tuple(r.subs or ()))
    p = _since(posts, cutoff, ts_col)
    if not cases:
        none = p.withColumn(tokens_col, F.array().cast("array<string>")) if tokens_col else p
        return none.withColumn("topic_id", F.lit(None).cast("string")).where(F.lit(False))
    cols = p.columns + ([toks.alias(tokens_col)] if tokens_col else [])
    if () not in subs:          # every topic is restricted: other posts are not tokenised
        p = p.where(F.lower(F.col("subreddit")).isin(sorted({s for held in subs for s in held})))
    listed = F.array(*[F.lit(t) for t in sorted(simple)]) if simple else F.array().cast("array<string>")
    staged = p.withColumn("_tp_lt", F.lower(F.col("text")))
    tokenised = F.split(lt, _SPLIT)
    if len(simple) <= SEARCH_MAX_WORDS:
        found = [F.when(lt.rlike(whole_term(t)), F.lit(t)) for t in sorted(simple)]
        staged = staged.withColumn("_tp_words", F.array_intersect(F.array(*found).cast("array<string>"), listed))
    else:
        staged = staged.withColumn("_tp_toks", tokenised).withColumn("_tp_words", F.array_intersect(toks, listed))
        tokenised = toks
    if not tokens_col:
        hits = F.filter(F.array(*cases), lambda x: x.isNotNull())
        return staged.select(*cols, F.explode(hits).alias("topic_id"))
    # the tokens of matching posts, once per post
    staged = staged.withColumn("_tp_hits", F.array(*cases))
    hits = F.filter("_tp_hits", lambda x: x.isNotNull())
    staged = staged.withColumn("_tp_toks", F.when(F.exists("_tp_hits", lambda x: x.isNotNull()), tokenised))
    return staged.select(*cols, F.explode(hits).alias("topic_id"))


def _runs(term: Column) -> Column:
    """The term's distinct runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(term, _SPLIT), lambda s: s != F.lit("")))


def term_rows(topics: DataFrame) -> DataFrame:
    """One row per (topic, group, term)."""
    t = prepare_topics(topics).where(F.col("cnf").isNotNull() & F.col("topic_id").isNotNull())
    g = t.select("topic_id", "subs", F.size("cnf").alias("n_groups"),
                 F.posexplode("cnf").alias("group_idx", "terms"))
    return g.select("topic_id", "subs", "n_groups", "group_idx", F.explode("terms").alias("term"))


def term_table(topics: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """One row per (topic, group, term): join key, exactness flag, regex.

    The key is the term's run that ``frequencies`` (tok, posts) counts in fewest
    posts; a run it does not list is in none.  Ties, and all terms without the
    table, go to the longest run, then to the first in order.  A term without
    any run takes its first character that is not white space.
    """
    x = term_rows(topics).withColumn("runs", _runs(F.col("term")))
    spread = x.select("*", F.explode_outer("runs").alias("run"))
    if frequencies is None:
        spread = spread.withColumn("posts", F.lit(0).cast("long"))
    else:
        counted = frequencies.select(F.col("tok").alias("run"), "posts")
        spread = spread.join(counted, "run", "left").withColumn("posts", F.coalesce("posts", F.lit(0)))
    order = F.struct("posts", -F.length("run"), "run")
    keyed = spread.groupBy("topic_id", "group_idx", "term").agg(
        F.any_value("subs").alias("subs"), F.any_value("n_groups").alias("n_groups"),
        F.min_by("run", order).alias("run"), F.min("posts").alias("posts"))
    first = F.substring(F.coalesce(F.nullif(F.trim("term"), F.lit("")), "term"), 1, 1)
    return keyed.select("topic_id", "subs", "n_groups", "group_idx", "term",
                        F.coalesce("run", first).alias("key"), F.col("run").isNull().alias("symbols"),
                        F.col("term").rlike(_SIMPLE).alias("exact"), _boundary("term").alias("pattern"), "posts")


def lookup_table(terms: DataFrame) -> DataFrame:
    """One row per term of a lookup group and rule that it is in, from ``term_table``.

    key and pair (two or three neighbouring runs, the longest; null if the term has
    fewer); ``earlier``, the terms of the group before this one; ``rest``, the other
    groups, each as its single words and its other terms; ``topics``, all topics of that
    rule: a catalogue of many alike topics is kept, and verified, once a rule.  A topic
    with a group without terms never matches and has no row.
    """
    runs = F.filter(F.split("term", _SPLIT), lambda s: s != F.lit(""))
    n = F.least(F.size(runs), F.lit(3))
    grams = F.transform(F.sequence(F.lit(1), F.size(runs) - n + 1),
                        lambda i: F.array_join(F.slice(runs, i, n), " "))
    pair = F.when(F.size(runs) > 1, F.array_max(F.transform(grams, lambda x: F.struct(
        F.length(x).alias("n"), x.alias("pair"))))["pair"])
    t = terms.where(F.col("term").isNotNull()).withColumn("pair", pair)
    term = F.struct("term", "key", "pair", "exact")
    groups = t.groupBy("topic_id", "group_idx").agg(
        F.any_value("subs").alias("subs"), F.max("n_groups").alias("n_groups"),
        F.struct(F.count_if(F.col("pair").isNull()).alias("words"), F.sum("posts").alias("posts"),
                 (-F.min(F.length(F.coalesce("pair", "key")))).alias("shortest")).alias("cost"),
        F.sort_array(F.collect_list(term)).alias("terms"))
    rules = groups.groupBy("topic_id").agg(
        F.any_value("subs").alias("subs"), F.max("n_groups").alias("n_groups"),
        F.sort_array(F.collect_list(F.struct("cost", "group_idx", "terms"))).alias("groups"))

    def parted(group: Column) -> Column:
        return F.struct(F.transform(F.filter(group, lambda x: x["exact"]), lambda x: x["term"]).alias("words"),
                        F.transform(F.filter(group, lambda x: ~x["exact"]), lambda x: x["term"]).alias("others"))

    rules = rules.where(F.size("groups") == F.col("n_groups")).select(
        "topic_id", "subs", F.col("groups")[0]["terms"].alias("terms"),
        F.transform(F.slice("groups", 2, F.size("groups")), lambda g: parted(g["terms"])).alias("rest"))
    rules = rules.groupBy("subs", "terms", "rest").agg(F.collect_list("topic_id").alias("topics"))
    one = rules.select("subs", "terms", "rest", "topics", F.posexplode("terms").alias("i", "t"))
    return one.select("t.*", "subs", parted(F.slice("terms", F.lit(1), F.col("i"))).alias("earlier"), "rest", "topics")


def _bytes() -> Column:
    """The aggregate size of the lookup table's strings."""
    return F.sum(F.octet_length(F.to_json(F.struct("term", "key", "pair", "subs", "earlier", "rest",
                                                   "topics"))).cast("long"))


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(KEY_BUCKETS)).cast("int")


def among(tokens: Column, buckets: list[int]) -> Column:
    """The tokens whose hash bucket is listed: all keys, and few others.

    The buckets are a literal of KEY_BUCKETS bytes however many keys there are.
    """
    held = bytearray(KEY_BUCKETS)
    for b in buckets:
        held[b] = 1
    table = F.lit(held)
    return F.filter(tokens, lambda t: F.substring(table, _bucket(t) + 1, F.lit(1)) == F.lit(b"\x01"))


def listed(keys: DataFrame):
    """A function of a token array that keeps, once each, the tokens of the column ``key``:
    few keys exactly, many by ``among``."""
    few = [r.key for r in keys.where(F.col("key").isNotNull()).distinct().limit(LITERAL_MAX_KEYS + 1).collect()]
    if len(few) <= LITERAL_MAX_KEYS:
        literal = F.array(*[F.lit(k) for k in sorted(few)]) if few else F.array().cast("array<string>")
        return lambda tokens: F.array_intersect(tokens, literal)
    buckets = keys.agg(F.collect_set(_bucket(F.col("key")))).first()[0]    # KEY_BUCKETS numbers at most
    return lambda tokens: F.array_distinct(among(tokens, buckets))


def token_frequencies(posts: DataFrame, topics: DataFrame) -> DataFrame | None:
    """tok, posts: in how many posts each run of the catalogue's phrases occurs.

    Only terms of several runs have a choice; None if there is no such term.
    One aggregate over the posts, with map-side combine; store its rows to use
    them for many cycles (a key is right whatever the counts, only slower).
    """
    runs = term_rows(topics).select(_runs(F.col("term")).alias("runs")).where(F.size("runs") > 1)
    runs = runs.select(F.explode("runs").alias("run"))
    buckets = runs.agg(F.collect_set(_bucket(F.col("run")))).first()[0]    # KEY_BUCKETS at most
    if not buckets:
        return None
    words = F.array_distinct(F.split(F.lower(F.col("text")), _SPLIT))
    found = posts.select(F.explode(among(words, buckets)).alias("tok"))
    return found.groupBy("tok").agg(F.count(F.lit(1)).alias("posts"))


def match_inverted(posts: DataFrame, topics: DataFrame, cutoff: _dt.datetime | None = None,
                   ts_col: str = "created_at", tokens_col: str | None = None,
                   frequencies: DataFrame | None = None) -> DataFrame:
    """The inverted plan.  Terms are keyed by their rarest run if ``frequencies``
    (``token_frequencies``, or a stored table of it) is given, else by the longest."""
    p = _since(posts, cutoff, ts_col)
    # read several times (for its figures and in the join), so made and written once
    path = scratch_dir(posts.sparkSession, "terms")
    table = lookup_table(term_table(topics, frequencies))
    table.write.parquet(path)
    terms = posts.sparkSession.read.schema(table.schema).parquet(path)
    known = terms.agg(_bytes().alias("bytes"), F.count("pair").alias("phrases"),
                      F.max(F.col("pair").isNull() & ~F.col("exact")).alias("odd")).first()
    paired = known["phrases"] >= PAIR_MIN_PHRASES
    terms = terms.withColumn("key", F.coalesce("pair", "key") if paired else F.col("key")).drop("pair")
    # single words of the other terms, which are looked for among the post's tokens
    needed = F.flatten(F.concat(F.array("earlier.words"), F.col("rest.words")))
    words = F.col("_toks")
    if paired:
        def joined_to(grams: Column, n: int) -> Column:
            """Each gram with the token that stands n tokens after its first."""
            return F.zip_with(grams, F.slice(F.col("_toks"), F.lit(n + 1), F.size("_toks")),
                              lambda a, b: F.coalesce(F.concat(a, F.lit(" "), b), F.lit("")))

        two = joined_to(words, 1)
        words = F.concat(words, two, joined_to(two, 2))
    if known["odd"]:
        # terms of symbols alone meet the post in one of its symbols
        words = F.concat(words, F.regexp_extract_all(F.col("_lt"), F.lit(r"([^\p{L}\p{N}])"), 1),
                         F.array(F.lit("")))
    held = listed(terms.select(F.explode(F.concat(F.array("key"), needed)).alias("key")))
    asked = listed(terms.select("key"))
    staged = (p.withColumn("_lt", F.lower(F.col("text"))).withColumn("_toks", F.split("_lt", _SPLIT))
              .withColumn("_found", held(words)))
    if not tokens_col:
        staged = staged.drop("_toks")
    # A lambda in a generator keeps it out of Spark's generated loops, which would hold all
    # rows made from one post, each with its text, at once.
    keys = F.filter(asked(F.col("_found")), lambda k: k.isNotNull())
    cols = staged.columns
    # one row per term: its text is searched once for all rules that it is looked up for
    rules = terms.groupBy("key", "term", "exact").agg(
        F.array_distinct(F.flatten(F.collect_list(needed))).alias("words"),
        F.collect_list(F.struct("subs", "earlier", "rest", "topics")).alias("rules"))
    term = F.struct("term", "exact", "words", "rules")
    if (known["bytes"] or 0) <= BROADCAST_MAX_BYTES:
        tok = staged.select(*cols, F.explode(keys).alias("_tok"))
        named = rules.groupBy("key").agg(F.collect_list(term).alias("_hits"))
        met = tok.join(F.broadcast(named), tok["_tok"] == named["key"])
    else:
        # (token, salt): a very common token is spread over SALT_BUCKETS tasks
        tok = staged.select(F.monotonically_increasing_id().alias("_row"), F.struct(*cols).alias("_data"),
                            keys.alias("_keys"))
        tok = tok.select("_row", "_data", F.posexplode("_keys").alias("_pos", "_tok"))
        tok = tok.select("_row", "_tok", F.when(F.col("_pos") == 0, F.col("_data")).alias("_data"),
                         F.pmod(F.col("_row"), F.lit(SALT_BUCKETS)).cast("int").alias("_salt"))
        keyed = rules.select("key", term.alias("_hit"),
                             F.explode(F.sequence(F.lit(0), F.lit(SALT_BUCKETS - 1))).alias("_salt"))
        joined = tok.join(keyed, (tok["_tok"] == keyed["key"]) & (tok["_salt"] == keyed["_salt"]), "left")
        met = joined.where(F.col("_hit").isNotNull() | F.col("_data").isNotNull()).groupBy("_row").agg(
            F.any_value("_data", F.lit(True)).alias("_data"), F.collect_list("_hit").alias("_hits"))
        met = met.where(F.size("_hits") > 0).select("_data.*", "_hits")
    met = met.select(*cols, F.explode(F.filter("_hits", lambda h: h.isNotNull())).alias("_hit"))

    lt = F.col("_lt")

    def stands(t: Column) -> Column:
        """Whether a term that is no single word stands in the text."""
        return (F.instr(lt, t) > 0) & (_spaced(lt, t) | F.regexp_like(lt, _boundary(t)))

    def holds(group: Column) -> Column:
        return F.arrays_overlap(group["words"], "_near") | F.exists(group["others"], stands)

    def true(rule: Column) -> Column:
        return (F.coalesce(_sub_ok(rule["subs"], F.col("subreddit")), F.lit(False))
                & ~holds(rule["earlier"]) & F.forall(rule["rest"], holds))

    met = met.where(F.col("_hit.exact") | stands(F.col("_hit.term")))
    met = met.withColumn("_near", F.array_intersect("_found", "_hit.words"))
    matched = F.flatten(F.transform(F.filter("_hit.rules", true), lambda rule: rule["topics"]))
    extra = [F.col("_toks").alias(tokens_col)] if tokens_col else []
    return met.select(*p.columns, *extra, F.explode(matched).alias("topic_id"))


def match_posts(posts: DataFrame, topics: DataFrame, cutoff: _dt.datetime | None = None,
                strategy: str = "auto", ts_col: str = "created_at",
                tokens_col: str | None = None, frequencies: DataFrame | None = None) -> DataFrame:
    """J1 entry point: ``strategy`` = 'narrow' | 'inverted' | 'auto'.

    'auto' takes the narrow plan when the catalogue is within both of its
    bounds (topics and terms), else the inverted one, for which it counts the
    phrases' runs unless ``frequencies`` are given; the two plans give the same
    rows, one per post row and matching topic.  ``tokens_col`` adds the post's
    token array, for callers that count tokens.
    """
    if strategy == "auto":
        rows = prepare_topics(topics).limit(NARROW_MAX_TOPICS + 1).collect()
        terms = sum(len(g) for r in rows for g in (r.cnf or []))
        narrow = len(rows) <= NARROW_MAX_TOPICS and terms <= NARROW_MAX_TERMS
        strategy = "narrow" if narrow else "inverted"
        if not narrow and frequencies is None:
            frequencies = token_frequencies(_since(posts, cutoff, ts_col), topics)
    if strategy == "narrow":
        return match_narrow(posts, topics, cutoff, ts_col, tokens_col)
    if strategy == "inverted":
        return match_inverted(posts, topics, cutoff, ts_col, tokens_col, frequencies)
    raise ValueError(f"unknown strategy {strategy!r}")


LIMIT_SALT = 32
LIMIT_BROADCAST_TOPICS = 100_000       # last keys of some 100 bytes
HOUR_US = 3_600_000_000


def limit_per_topic(matched: DataFrame, max_limit: int, ts_col: str = "created_at",
                    salt_buckets: int = LIMIT_SALT) -> DataFrame:
    """O3: newest posts per topic, cap rounded up to whole pages of 100.

    The first k rows of each topic by (created desc, event_id, row hash), found
    by a threshold instead of ranking rows:

    1. the matches are written once; the steps 2 and 3 read narrow columns;
    2. a histogram of hours per topic (map-side combined) gives the cut hour,
       in which the k-th newest row lies, and how many rows of it still fit;
    3. only that hour's keys are ranked (salted top-k, then per topic), which
       gives the topic's last key;
    4. rows before the last key are kept by a comparison, where they lie (the last keys
       are broadcast, or, of many topics, joined by salted topics).

    No text enters a window or its exchange.  Rows equal to the last key in
    every column are interchangeable; as many as fit are copied from one of
    them.  Null times come last, null ids first, as in a sort.
    """
    k = -(-max_limit // 100) * 100
    cols = matched.columns
    path = scratch_dir(matched.sparkSession, "limited")
    newest = -F.coalesce(F.unix_micros(ts_col), F.lit(-2**62))
    keyed = matched.select("*", newest.alias("_neg"), F.xxhash64(*cols).alias("_h"))
    keyed.write.options(**PARQUET_OPTIONS).parquet(f"{path}/rows")
    stored = matched.sparkSession.read.schema(keyed.schema).parquet(f"{path}/rows")

    topic = F.col("topic_id")
    hour = F.floor(F.col("_neg") / HOUR_US)
    hours = stored.groupBy("topic_id", hour.alias("_hour")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("topic_id").orderBy("_hour").rowsBetween(Window.unboundedPreceding, 0)
    reach = hours.withColumn("_sum", F.sum("_n").over(upto)).where(F.col("_sum") >= k)
    cut = reach.groupBy("topic_id").agg(F.min(F.struct("_hour", (F.col("_sum") - F.col("_n")).alias("_above")))
                                        .alias("_c"))
    cut = cut.select(topic.alias("_topic"), "_c._hour", (F.lit(k) - F.col("_c._above")).alias("_quota"))

    inside = stored.select("topic_id", "_neg", "event_id", "_h", hour.alias("_at")).join(
        cut, topic.eqNullSafe(F.col("_topic")) & (F.col("_at") == F.col("_hour")))
    order = [F.col("_neg"), F.col("event_id"), F.col("_h")]
    salted = Window.partitionBy("topic_id", F.pmod("_h", F.lit(salt_buckets))).orderBy(*order)
    whole = Window.partitionBy("topic_id").orderBy(*order)
    near = inside.withColumn("_rn", F.row_number().over(salted)).where(F.col("_rn") <= k)
    ranked = near.withColumn("_rn", F.row_number().over(whole)).where(
        F.col("_rn") <= F.col("_quota")).select("topic_id", "_neg", "event_id", "_h")
    key = F.struct(*order)
    last = ranked.groupBy("topic_id").agg(F.max(F.struct(key.alias("key"))).alias("_last"))
    last = last.select(topic.alias("_topic"), "_last.key")
    same = ranked.join(last, topic.eqNullSafe(F.col("_topic")) & key.eqNullSafe(F.col("key")))
    last = same.groupBy("_topic", "key").agg(F.count(F.lit(1)).cast("int").alias("_copies"))

    # One row per topic that has more than k rows, written so that its size is known: the
    # matches with their texts are never dealt by topic.
    last = last.withColumnRenamed("key", "_key")
    last.write.parquet(f"{path}/last")
    last = matched.sparkSession.read.schema(last.schema).parquet(f"{path}/last")
    on = topic.eqNullSafe(F.col("_topic"))
    if last.count() <= LIMIT_BROADCAST_TOPICS:
        j = stored.join(F.broadcast(last), on, "left")
    else:
        last = last.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
        j = stored.join(last, on & (F.pmod("_h", F.lit(salt_buckets)) == F.col("_salt")), "left")
    before = j.where(F.col("_key").isNull() | (key < F.col("_key"))).select(*cols)
    at = (j.where(key.eqNullSafe(F.col("_key"))).groupBy("_topic")
          .agg(F.any_value(F.struct(*cols)).alias("_row"), F.any_value("_copies").alias("_copies")))
    return before.unionByName(at.select("_row", F.explode(F.sequence(F.lit(1), "_copies")))
                              .select("_row.*"))

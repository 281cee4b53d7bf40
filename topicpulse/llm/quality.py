"""Quality rules with risk-controlled cutoffs (operator 8), native throughout.

Base measures come from each whole text by array expressions, without a
shuffle.  Each rule compares one ratio of them with a cutoff.  Cutoffs are
learned on the labelled documents, per stratum: they are allowed only if the
exact binomial (Clopper-Pearson) bound says that all rules together reject at
most ``RISK`` of the stratum's good texts.

Trials: a good text is one trial of its stratum, however many documents or
labels hold it, since copies prove nothing anew.

Multiple testing: within a stratum the cutoffs of all rules form one ladder
(``STEPS``), tested in fixed order from lenient to strict, and the first failure
stops it.  What is tested at a step is the share of good texts that any rule
rejects with the cutoffs up to that step, so the rules share one risk and need
no correction among them.  Across strata the level is divided by their number
(Bonferroni).  So with probability 1 - DELTA no stratum loses more than RISK of
its good texts to the rules.  Even a step that rejects none needs
ln(strata / DELTA) / -ln(1 - RISK) good texts: 228 a stratum with five strata.

Edge cases: a null text has no words; documents without words or under the
base limits fail the base; a stratum (null: its own) whose labelled sample is
too small to prove anything gets no cutoff and keeps what passes the base;
repeated rows are judged alike; repeated labels change nothing, and a text with
labels of both kinds counts as good; very long texts are measured whole; an
empty table gives an empty result; all columns but the text travel inside the
struct ``row``, so no name of theirs can clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicpulse.llm.common import materialize

RISK = 0.02
DELTA = 0.05
#: Rule -> cutoffs from lenient to strict; a ratio above the
#: cutoff rejects.
RULES = {
    "symbol_ratio": (4.0, 2.0, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1),
    "dup_line_ratio": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1),
    "repeat_ratio": (0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2),
    "chars_per_word": (30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0),
}
#: (rule, cutoff) in the order of testing: level by level, in a level rule by rule.
STEPS = tuple((rule, cutoffs[k]) for k in range(max(map(len, RULES.values())))
              for rule, cutoffs in RULES.items() if k < len(cutoffs))
WHITE = r"[\x20\x09-\x0D]"
_PLACE_BITS = 31
_PLACES = (1 << _PLACE_BITS) - 1


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space and U+0009 to U+000D."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE + "+"), "")


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The struct ``row`` (all columns of ``docs`` but the text), ``digest`` of the text, and
    the struct ``measures``: n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words.

    Repeated three-word windows are found by sorting: each window becomes one
    long, hash bits above its place, and neighbours with equal hash bits are
    candidates; only these are then compared word by word.
    """
    row = F.struct(*[c for c in docs.columns if c != text])
    docs = docs.select(row.alias("row"), F.col(text).alias("text"))
    body = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select(
        "row", F.md5(body).alias("digest"), words_of(F.col("text")).alias("words"), lines.alias("lines"),
        (F.char_length(body) - F.regexp_count(body, F.lit(WHITE))).alias("chars"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).alias("symbols"))
    keep = step.columns
    w = F.col("words")
    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]).bitwiseAND(F.lit(~_PLACES)).bitwiseOR(
            i.cast("long")))
    step = step.select(*keep, F.when(F.size(w) >= 3, F.sort_array(windows)).otherwise(
        F.array().cast("array<bigint>")).alias("hashed"))
    h = F.col("hashed")

    def high(x: Column) -> Column:
        return F.shiftright(x, _PLACE_BITS)

    # get() is null outside the array, and null never equals
    near = F.filter(h, lambda x, k: (high(x) == high(F.get(h, k - 1)))
                    | (high(x) == high(F.get(h, k + 1))))
    step = step.select(*keep, F.transform(
        near, lambda x: x.bitwiseAND(F.lit(_PLACES)).cast("int")).alias("near"))
    step = step.select(*keep, F.sort_array(F.transform(
        "near", lambda p: F.struct(w[p].alias("a"), w[p + 1].alias("b"), w[p + 2].alias("c"),
                                    p.alias("p")))).alias("same"))
    s = F.col("same")

    def equal(x: Column, y: Column) -> Column:
        return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]),
                          F.lit(False))

    again = F.filter(s, lambda x, k: equal(x, F.get(s, k - 1)) | equal(x, F.get(s, k + 1)))
    places = F.sort_array(F.transform(again, lambda x: x["p"]))
    covered = F.aggregate(
        places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("last"),
                                (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"])
    return step.select("row", "digest", F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.col("chars").cast("long").alias("word_chars"),
        F.col("symbols").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words")).alias("measures"))


def base_failed(m: Column) -> Column:
    """Too short, or more than half of the words in repeated windows."""
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def ratios(m: Column) -> dict[str, Column]:
    """The value that each rule compares with its cutoff."""
    words = F.greatest(m["n_words"], F.lit(1))
    return {
        "symbol_ratio": m["n_symbols"] / words,
        "dup_line_ratio": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)),
        "repeat_ratio": m["n_repeat_words"] / words,
        "chars_per_word": m["word_chars"] / words,
    }


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series seven places further on."""
    z = x + 7.0
    shift = F.lit(0.0)
    for k in range(7):
        shift = shift + F.log(x + float(k))
    series = 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k < n * p, and 1 from there on (never below the
    truth).  Summed from k downwards; terms more than twelve deviations below
    are under 1e-30 of the first and are left out."""
    kd, nd = k.cast("double"), n.cast("double")
    first = F.exp(log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1)
                  + kd * math.log(p) + (nd - kd) * math.log1p(-p))
    steps = F.least(kd, F.ceil(12 * F.sqrt(nd * p)) + 50).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(0), steps),
        F.struct(first.alias("term"), F.lit(0.0).alias("sum")),
        lambda acc, j: F.struct(
            (acc["term"] * (kd - j) * ((1 - p) / p) / (nd - kd + j + 1)).alias("term"),
            (acc["sum"] + acc["term"]).alias("sum")),
        lambda acc: acc["sum"])
    return F.when(kd < nd * p, F.least(total, F.lit(1.0))).otherwise(1.0)


def first_step(m: Column) -> Column:
    """The first of STEPS that rejects a text, null if none does."""
    rejects = []
    for rule, value in ratios(m).items():
        places = F.array(*[F.lit(k) for k, (r, _) in enumerate(STEPS) if r == rule])
        # one use of the value: what it is made of is not computed once per cutoff
        lenient = F.filter(F.array(*map(F.lit, RULES[rule])), lambda c: ~(value > c))
        rejects.append(F.get(places, F.size(lenient)))
    return F.least(*rejects)


def learn_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str, doc_id: str = "doc_id",
                  risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Per stratum: n (its good texts), steps (how many of STEPS are proven) and one
    column per rule: its strictest proven cutoff or null.

    Two aggregates over the labelled documents, by text and by stratum; what
    leaves them is one row per stratum, and every stratum is tested.
    """
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("good")).distinct()
    m = F.col("measures")
    rows = measured.filter(~base_failed(m)).select(
        F.col("row")[doc_id].alias("doc"), F.col("row")[stratum].alias("stratum"), "digest",
        first_step(m).alias("first"))
    # equal texts have the same first step
    texts = rows.join(good, F.col("doc") == F.col("good")).groupBy("stratum", "digest").agg(
        F.min("first").alias("first"))
    counts = materialize(texts.groupBy("stratum").agg(
        F.count("*").alias("n"),
        F.array(*[F.count_if(F.col("first") <= k) for k in range(len(STEPS))]).alias("rejected")),
        "quality-counts")
    level = delta / max(1, counts.count())
    proven = F.transform("rejected", lambda k: binomial_cdf(k, F.col("n"), risk) <= level)
    # the number of leading proofs: the place of the first failure
    steps = F.array_position(F.concat(proven, F.array(F.lit(False))), False) - 1
    ladder = counts.select("stratum", "n", steps.alias("steps"))
    return ladder.select("*", *[
        F.least(*[F.when(F.col("steps") > k, c) for k, (r, c) in enumerate(STEPS) if r == rule])
        .alias(rule) for rule in RULES])


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """row, measures, base_failed and kept."""
    rules = cutoffs.select("stratum", F.struct(*RULES).alias("cutoffs"))
    out = measured.join(rules, F.col("row")[stratum].eqNullSafe(F.col("stratum")), "left")
    m = F.col("measures")
    rejected = F.lit(False)
    for rule, value in ratios(m).items():
        rejected = rejected | F.coalesce(value > F.col("cutoffs")[rule], F.lit(False))
    failed = base_failed(m)
    return out.select("row", "measures", failed.alias("base_failed"),
                      (~failed & ~rejected).alias("kept"))


def assess(docs: DataFrame, labels: DataFrame, text: str = "text",
           stratum: str = "lang") -> DataFrame:
    """row (the columns of ``docs`` but the text), measures, base_failed, kept."""
    measured = materialize(with_measures(docs, text), "quality-measures")
    return judge(measured, learn_cutoffs(measured, labels, stratum), stratum)

"""Personal data by candidate gradient boosting (operator 13), native throughout.

High-recall generators, each a regular expression, propose spans that may
overlap.  The base kinds keep their own rule: leftmost matches that pass a
check, and these spans always stay.  Every other proposal is judged by boosted
trees over features of its format (length, digits, separators, check sums) and
of its context (neighbouring characters, cue words).  The trees learn to tell
the spans that the rules prove (the base spans; for secrets, a value assigned to
a key-like name) from all other proposals, so they find what the rules miss: a
number inside a longer match that failed, another way of writing.

Boosting is a loop of aggregates: candidates are reduced to distinct feature
vectors with counts, and each level of a tree needs the sums of gradients per
(node, feature, bin), a table of fixed size.  Equal candidates in equal
surroundings count once, so copied texts add no evidence.  One half of the
candidates (by a hash) grows the trees; the other sets, per kind, the lowest
score from which on at least PRECISION of the proposals are proven ones, by a
lower confidence bound.  A kind for which no score can show that adds nothing.

Spans added overlap no base span; of added spans that overlap each other the
one that begins first stays, of those the longest.

Edge cases: null text is empty and has no spans; a text of any length is read
whole (every expression is linear in its length), its spans are placed by a
running sum over its own matches; repeated rows are judged alike; ties in score
share their fate; with an empty table, or no candidates, nothing is learned or
added; the given columns come back inside ``row``, so their names cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicpulse.llm.common import materialize

#: The kinds, in their order in results.
KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
BASE_KINDS = 4

#: Trees, the share of each that counts, the damping of leaves, the least weight of a leaf.
ROUNDS = 10
RATE = 0.4
DAMPING = 1.0
LEAST = 2.0
#: Proven share above a cutoff, the normal deviate of its lower bound, bins of the score.
PRECISION = 0.9
DEVIATE = 1.96
SCORE_BINS = 200
BEFORE, AFTER = 24, 12

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: (kind, pattern, a cheap test of the text).  The first four are the base rules;
#: look-behinds and possessive repeats only save failed starts.
GENERATORS = (
    (EMAIL, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    (IP, r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    (CARD, r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){6}"),
    (PHONE, r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    (EMAIL, r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[{]\x20?(?:at|@)\x20?[)\]}]\x20?"
            r"[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[{]\x20?dot\x20?[)\]}])\x20?[A-Za-z0-9-]++)++",
     r"(?i)[(\[{]\x20?(?:at|@)\x20?[)\]}]"),
    (CARD, r"(?<![0-9])[0-9]{13,19}+(?![0-9])", r"[0-9]{13}"),
    (CARD, r"(?<![0-9])[0-9]{4}(?:[\x20.-][0-9]{4}){3}(?![0-9])", r"[0-9]{4}[\x20.-][0-9]{4}[\x20.-]"),
    (PHONE, r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{2,4}(?:[\x20./-][0-9]{2,4}){1,3}(?![0-9])",
     r"[0-9]{2}\)?[\x20./-]{1,2}[0-9]{2,4}[\x20./-][0-9]{2}"),
    (SECRET, r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,64}[0-9])(?=[0-9_-]{0,64}[A-Za-z])[A-Za-z0-9_-]{20,}+",
     r"[A-Za-z0-9_-]{20}"),
)
#: A secret is proven by a name like these that it is assigned to.
ASSIGNED = r"(?i)(?:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|key)[\"']?\x20?[:=]\x20?[\"']?$"
#: Cue words of the kinds that rules prove by form.
CUES = (r"(?i)mail|contact|write", r"(?i)\bip\b|host|server|addr", r"(?i)card|visa|credit|iban",
        r"(?i)phone|tel|call|fax|mobil")


def _hits(gen: int, matches: Column, gaps: Column) -> Column:
    """Per match: the characters since the last one, the match and its surroundings."""
    return F.transform(matches, lambda m, i: F.struct(
        F.lit(gen).alias("gen"), i.alias("i"), F.char_length(gaps[i]).alias("gap"), m.alias("m"),
        F.substring(gaps[i], -BEFORE, BEFORE).alias("before"),
        F.substring(gaps[i + 1], 1, AFTER).alias("after")))


def propose(docs: DataFrame, text: str = "text") -> DataFrame:
    """rid, row (the columns of ``docs`` but the text), hits of every generator."""
    row = F.struct(*[c for c in docs.columns if c != text], F.lit(0).alias("__row"))
    body = F.coalesce(F.col(text), F.lit(""))
    step = docs.select(F.monotonically_increasing_id().alias("rid"), row.alias("row"),
                       body.alias("body"))
    none = F.array().cast("array<string>")
    found = step.select("rid", "row", *[
        F.when(F.col("body").rlike(test), part).otherwise(none).alias(f"{name}{g}")
        for g, (_, pattern, test) in enumerate(GENERATORS)
        for name, part in (("m", F.regexp_extract_all("body", F.lit(pattern), F.lit(0))),
                           ("g", F.split("body", pattern, -1)))])
    return found.select("rid", "row", F.concat(*[
        _hits(g, F.col(f"m{g}"), F.col(f"g{g}")) for g in range(len(GENERATORS))]).alias("hits"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets(m: Column) -> Column:
    return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")


def _luhn(m: Column) -> Column:
    """14 to 19 digits with a right check digit."""
    digits = _digits(m)
    return F.when(F.char_length(digits).between(14, 19),
                  F.call_function("luhn_check", digits)).otherwise(F.lit(False))


def located(proposed: DataFrame) -> DataFrame:
    """rid, kind, start, end, base, proven, m, before, after: each span once per kind."""
    hits = proposed.select("rid", F.explode("hits").alias("h")).select("rid", "h.*")
    kind = F.element_at(F.array(*[F.lit(k) for k, _, _ in GENERATORS]), F.col("gen") + 1)
    size = F.char_length("m")
    upto = Window.partitionBy("rid", "gen").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = hits.withColumn("end", F.sum(F.col("gap") + size).over(upto))
    m, gen = F.col("m"), F.col("gen")
    base = (F.when(gen == EMAIL, True).when(gen == IP, _octets(m)).when(gen == CARD, _luhn(m))
            .when(gen == PHONE, F.char_length(_digits(m)).between(10, 15)).otherwise(False))
    proven = base | ((kind == SECRET) & F.col("before").rlike(ASSIGNED))
    spans = spans.select("rid", kind.alias("kind"), (F.col("end") - size).alias("start"), "end",
                         "gen", base.alias("base"), proven.alias("proven"), "m", "before", "after")
    first = F.min_by(F.struct("m", "before", "after"), "gen").alias("first")
    return spans.groupBy("rid", "kind", "start", "end").agg(
        F.max("base").alias("base"), F.max("proven").alias("proven"), first).select(
        "rid", "kind", "start", "end", "base", "proven", "first.*")


def _neighbour(c: Column) -> Column:
    """The sort of a neighbouring character: none, white, digit, letter, bracket or quote, other."""
    return (F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike("^[0-9]"), 2)
            .when(c.rlike(r"^\p{L}"), 3).when(c.rlike(r"^[\"'<>()\[\]{}]"), 4).otherwise(5))


def features() -> dict[str, Column]:
    """Name -> bin (0 to 31) over the columns kind, m, before, after.

    None of them tells by itself which generator proposed a span.
    """
    m, before, after = F.col("m"), F.col("before"), F.col("after")
    size, digits = F.char_length(m), F.regexp_count(m, F.lit("[0-9]"))
    letters = F.regexp_count(m, F.lit("[A-Za-z]"))
    cue = F.lit(0)
    for k, words in enumerate(CUES, 1):
        cue = F.when(before.rlike(words), k).otherwise(cue)
    made = {
        "kind": F.col("kind"),
        "length": F.floor(size / 2),
        "digits": digits,
        "letters": F.floor(31 * letters / size),
        "marks": size - digits - letters,
        "runs": F.regexp_count(m, F.lit("[0-9]+")),
        "variety": F.size(F.array_distinct(F.split(m, ""))),
        "hex": m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("int"),
        "checked": F.when(F.col("kind") == CARD, _luhn(m)).when(F.col("kind") == IP, _octets(m))
        .otherwise(F.lit(False)).cast("int"),
        "left": _neighbour(F.substring(before, -1, 1)),
        "right": _neighbour(F.substring(after, 1, 1)),
        "word": F.char_length(F.regexp_extract(before, r"(\p{L}*)\P{L}*$", 1)),
        "cue": cue,
    }
    return {k: F.least(v.cast("int"), F.lit(31)) for k, v in made.items()}


class Trees:
    """Boosted trees of two levels; each is (root split, left and right split or
    leaf).  A split is (feature, last bin on the left)."""

    def __init__(self, bias: float):
        self.bias = bias
        self.trees: list[tuple] = []

    def margin(self) -> Column:
        """The sum of all leaves, over columns named as the features."""
        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + _expression(tree)
        return total

    def score(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def _expression(tree) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    (feature, at), left, right = tree
    return F.when(F.col(feature) <= at, _expression(left)).otherwise(_expression(right))


def _gain(g: float, h: float) -> float:
    return g * g / (h + DAMPING)


def best_split(sums: list[tuple[str, int, float, float, float]]) -> tuple | None:
    """((feature, last left bin), left leaf, right leaf) of the largest gain from
    (feature, bin, gradient, curvature, weight) sums; None without a gain.  Ties
    go to the first feature and bin by name and number."""
    best, found = 1e-9, None
    by: dict[str, list] = {}
    for feature, *rest in sorted(sums):
        by.setdefault(feature, []).append(rest)
    for feature, bins in by.items():
        g, h, w = (sum(b[i] for b in bins) for i in (1, 2, 3))
        gl = hl = wl = 0.0
        for at, *part in bins[:-1]:
            gl, hl, wl = gl + part[0], hl + part[1], wl + part[2]
            if min(wl, w - wl) < LEAST:
                continue
            gain = _gain(gl, hl) + _gain(g - gl, h - hl) - _gain(g, h)
            if gain > best:
                leaf = RATE * gl / (hl + DAMPING), RATE * (g - gl) / (h - hl + DAMPING)
                best, found = gain, ((feature, at), *leaf)
    return found


def boost(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> Trees:
    """Trees for the proven share; ``patterns``: feature columns, n, proven (counts).

    Two aggregates a tree, each leaving at most 2 * features * 32 rows.
    """
    total = patterns.agg(F.sum("n").alias("n"), F.sum("proven").alias("k")).first()
    n, k = float(total["n"] or 0), float(total["k"] or 0)
    model = Trees(math.log((k + 0.5) / (n - k + 0.5)))
    if not 0 < k < n:
        return model
    bins = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin"))
                               for f in names])).alias("at")

    def sums(node: Column) -> dict[int, list]:
        p = model.score()
        rows = (patterns.select(node.alias("node"), bins, (F.col("proven") - F.col("n") * p).alias("g"),
                                (F.col("n") * p * (1 - p)).alias("h"), "n")
                .groupBy("node", "at.feature", "at.bin")
                .agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect())
        out: dict[int, list] = {}
        for r in rows:
            # what differs by the order of addition does not decide a split
            out.setdefault(r["node"], []).append(
                (r["feature"], r["bin"], round(r["g"], 6), round(r["h"], 6), float(r["n"])))
        return out

    for _ in range(rounds):
        root = best_split(sums(F.lit(0)).get(0, []))
        if root is None:
            break
        (feature, at), *leaves = root
        side = sums((F.col(feature) > at).cast("int"))
        model.trees.append(((feature, at), *[best_split(side.get(i, [])) or leaves[i]
                                             for i in (0, 1)]))
    return model


def cutoffs(patterns: DataFrame, model: Trees) -> dict[int, float]:
    """Kind -> the lowest score whose proposals are proven ones to PRECISION."""
    bin_ = F.floor(model.score() * SCORE_BINS).cast("int")
    rows = patterns.groupBy("kind", bin_.alias("bin")).agg(
        F.sum("n").alias("n"), F.sum("proven").alias("k")).collect()   # kinds * SCORE_BINS at most
    found: dict[int, float] = {}
    for kind in {r["kind"] for r in rows}:
        n = k = 0
        for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: -r["bin"]):
            n, k = n + r["n"], k + r["k"]
            if lower_bound(k, n) >= PRECISION:
                found[kind] = r["bin"] / SCORE_BINS
    return found


def lower_bound(k: int, n: int) -> float:
    """Wilson's lower bound of a share."""
    z2 = DEVIATE * DEVIATE
    share = k / n
    root = math.sqrt(share * (1 - share) / n + z2 / (4 * n * n))
    return (share + z2 / (2 * n) - DEVIATE * root) / (1 + z2 / n)


def learn(candidates: DataFrame) -> tuple[Trees, dict[int, float]]:
    """Trees and cutoffs from located candidates with their feature columns."""
    names = list(features())
    once = candidates.groupBy("kind", "m", "before", "after").agg(
        F.max(F.col("proven").cast("long")).alias("proven"), *[F.first(f).alias(f) for f in names
                                                               if f != "kind"])
    half = F.pmod(F.xxhash64("kind", "m"), F.lit(2)).alias("half")
    patterns = materialize(once.groupBy(half, *names).agg(
        F.count("*").alias("n"), F.sum("proven").alias("proven")), "pii-patterns", narrow=True)
    model = boost(patterns.filter("half = 0"), names)
    return model, cutoffs(patterns.filter("half = 1"), model)


def accepted(candidates: DataFrame, model: Trees, at: dict[int, float]) -> DataFrame:
    """rid, kind, start, end, base: the base spans and those that the trees add."""
    passed = F.lit(False)
    bin_ = F.floor(model.score() * SCORE_BINS)
    for kind, cutoff in sorted(at.items()):
        passed = passed | ((F.col("kind") == kind) & (bin_ >= round(cutoff * SCORE_BINS)))
    spans = candidates.filter(F.col("base") | passed).select("rid", "kind", "start", "end", "base")
    return without_overlaps(spans)


def without_overlaps(spans: DataFrame) -> DataFrame:
    """Base spans, and added ones that overlap neither them nor an earlier added one."""
    own = Window.partitionBy("rid")
    before = Window.unboundedPreceding
    forward = own.orderBy("start", F.col("base").desc(), F.col("end").desc(), "kind").rowsBetween(before, -1)
    backward = own.orderBy(F.col("start").desc(), "base", "end", F.col("kind").desc()).rowsBetween(before, -1)
    base, end = F.col("base"), F.col("end")
    seen = spans.select("*", F.max(F.when(base, end)).over(forward).alias("base_end"),
                        F.min(F.when(base, F.col("start"))).over(backward).alias("base_start"))
    free = (F.coalesce(F.col("base_end") <= F.col("start"), F.lit(True))
            & F.coalesce(F.col("base_start") >= end, F.lit(True)))
    seen = seen.filter(base | free).select("rid", "kind", "start", "end", "base")
    seen = seen.withColumn("added_end", F.max(F.when(~base, end)).over(forward))
    return seen.filter(base | F.coalesce(F.col("added_end") <= F.col("start"), F.lit(True))).drop(
        "added_end")


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (the columns of ``docs`` but the text) and spans, an array of (start,
    kind number, end, base) in order."""
    proposed = materialize(propose(docs, text), "pii-proposed")
    made = [v.alias(k) for k, v in features().items() if k != "kind"]
    candidates = materialize(located(proposed).select("*", *made), "pii-candidates")
    model, at = learn(candidates)
    spans = accepted(candidates, model, at).groupBy("rid").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "base"))).alias("spans"))
    return proposed.select("rid", "row").join(spans, "rid", "left").select(
        "row", F.coalesce("spans", F.array().cast(
            "array<struct<start:bigint,kind:int,end:bigint,base:boolean>>")).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """row, n_email, n_ip, n_card, n_phone, base_sha256, spans (written)."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    counts = [count(k).alias(f"n_{KINDS[k]}") for k in range(BASE_KINDS)]
    return found.select("row", *counts, F.sha2(written(base), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``[kind]``, and ``row`` dropped again."""
    numbered = docs.withColumn("__text", F.col(text))
    found = find(numbered, text)
    body, spans = F.coalesce(F.col("row.__text"), F.lit("")), F.col("spans")
    names = F.array(*map(F.lit, KINDS))
    # each span's mark follows what stands between it and the furthest end before it
    far = F.transform(spans, lambda s, i: F.coalesce(
        F.array_max(F.transform(F.slice(spans, F.lit(1), i), lambda p: p["end"])), F.lit(0)))
    parts = F.transform(spans, lambda s, i: F.concat(
        F.substr(body, (F.get(far, i) + 1).cast("int"),
                 F.greatest(s["start"] - F.get(far, i), F.lit(0)).cast("int")),
        F.lit("["), F.get(names, s["kind"]), F.lit("]")))
    last = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
    clean = F.concat(F.array_join(parts, ""), F.substr(body, (last + 1).cast("int"), F.lit(2**31 - 1)))
    return found.select(*[(F.when(F.col("row.__text").isNotNull(), clean) if c == text
                           else F.col("row")[c]).alias(c) for c in docs.columns])

"""The registered queries of the numbered operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicpulse.llm import alignment, bpe, chat, collocations, embeddings, langid, licenses, minhash
from topicpulse.llm import packing, pii, quality, sharding, toxicity
from topicpulse.sources.tables import read_table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the rank file holds the vocabulary of byte_bpe_50k.json
    return packing.pack_documents(read_table(spark, sf_dir, "documents"),
                                  vocabulary("byte_bpe_50k.tiktoken"), 2048)


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link(read_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).select("doc_id", "license.*")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(read_table(spark, sf_dir, "documents"), vocabulary())


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    text = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)],
                                  "conv_id long, turn long, role string, text string")
    segments = chat.format_turns(given.unionByName(extra))
    return chat.conversation_digests(segments)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.assess(docs, read_table(spark, sf_dir, "labels")).select(
        "row.doc_id", *[f"measures.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                              "n_repeat_words")], "base_failed", "kept")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    dims = {
        "length": F.log2(F.octet_length("text") + 1),
        "script": F.octet_length("text") / F.greatest(F.char_length("text"), F.lit(1)),
        "lang": F.crc32(F.col("lang").cast("binary")) / float(1 << 32),
    }
    return sharding.shard_documents(docs, 8, dims).select(
        "row.doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the rank file holds the vocabulary of byte_bpe_50k.json
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.aligned_counts(docs, vocabulary("byte_bpe_50k.tiktoken"),
                                    vocabulary("piece_bpe_32k.model")).select(
        "row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digests(pii.find(docs)).select(
        "row.doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


QUERIES = {
    "op1_packing": op1_packing,
    "op2_embeddings": op2_embeddings,
    "op3_langid": op3_langid,
    "op4_minhash": op4_minhash,
    "op5_licenses": op5_licenses,
    "op6_bpe": op6_bpe,
    "op7_chat": op7_chat,
    "op8_quality": op8_quality,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_alignment": op12_alignment,
    "op13_pii": op13_pii,
}

ORACLE = {
    "op2_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
       component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id
""",
    "op7_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL
  SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       sum(length('### ' || replace(replace(replace(replace(role, '\', '\\'), '#', '\h'), '<', '\l'),
                                    ':', '\c') || ': ')
           + length(replace(replace(replace(text, '\', '\\'), '#', '\h'), '<', '\l'))
           + length(' </turn>') + 1)::BIGINT AS formatted_chars,
       bool_and(CASE WHEN role = 'system' THEN prev IS NULL
                     WHEN role = 'user' THEN prev IS NULL OR prev IN ('system', 'assistant')
                     WHEN role = 'assistant' THEN coalesce(prev = 'user', false)
                     ELSE false END)
         AND bool_and(next IS NOT NULL OR role = 'assistant') AS valid
FROM s GROUP BY conv_id
""",
}


def _quality_sql() -> str:
    """op8 in SQL: the measures, the exact binomial bound and the two verdicts."""
    cutoffs = ", ".join(f"('{rule}', {i}, {c})" for i, (rule, c) in enumerate(quality.STEPS))
    risk = quality.RISK
    white = "[\\x20\\x09-\\x0D]"
    ratio = """CASE rule WHEN 'symbol_ratio' THEN n_symbols / greatest(n_words, 1)
        WHEN 'dup_line_ratio' THEN n_dup_lines / greatest(n_lines, 1)
        WHEN 'repeat_ratio' THEN n_repeat_words / greatest(n_words, 1)
        ELSE word_chars / greatest(n_words, 1) END"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) AS i
      FROM (SELECT rid, list_filter(string_split_regex(t, '{white}+'), lambda x: x <> '') AS ws FROM d)),
tri AS (SELECT rid, i, a, lead(a, 1) OVER s AS b, lead(a, 2) OVER s AS c FROM w
        WINDOW s AS (PARTITION BY rid ORDER BY i)),
again AS (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri WHERE c IS NOT NULL)
  WHERE n > 1),
counts AS (SELECT rid, count(*) AS n_words, CAST(sum(length(a)) AS BIGINT) AS word_chars
           FROM w GROUP BY rid),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM again GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(t, chr(10)),
                                  lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
m AS (
  SELECT d.rid, doc_id, lang, t, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM d JOIN lines USING (rid) LEFT JOIN counts USING (rid) LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
rules(rule, pos, cutoff) AS (VALUES {cutoffs}),
good AS (SELECT DISTINCT lang, t, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words
         FROM f WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
hit AS (SELECT lang, t, min(pos) FILTER ({ratio} > cutoff) AS first FROM good, rules GROUP BY lang, t),
k AS (SELECT lang, pos, count(*) AS n, count(*) FILTER (first <= pos) AS k
      FROM hit, rules GROUP BY lang, pos),
bound AS (
  SELECT *, CASE WHEN k >= n * {risk} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
           lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
                         + i * ln({risk}) + (n - i) * ln(1 - {risk})))) END AS p
  FROM k),
proven AS (
  SELECT *, bool_and(p <= {quality.DELTA} / (SELECT count(DISTINCT coalesce(lang, chr(0))) FROM good))
           OVER (PARTITION BY lang ORDER BY pos) AS ok FROM bound),
cut AS (SELECT lang, rule, min(cutoff) AS cutoff FROM proven JOIN rules USING (pos)
        WHERE ok GROUP BY lang, rule),
bad AS (SELECT DISTINCT rid FROM f JOIN cut ON cut.lang IS NOT DISTINCT FROM f.lang
        WHERE {ratio} > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept
FROM f
"""


ORACLE["op8_quality"] = _quality_sql()

ORACLE["op11_collocations"] = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents),
p AS (
  SELECT row_number() OVER () AS pid, lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS ws
  FROM (SELECT lang, unnest(string_split_regex(low, '[.,;:!?\n\x0b\x0c\r]')) AS piece FROM t)),
w AS (SELECT lang, pid, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM p),
x AS (SELECT lang, w1, lead(w1, 1) OVER s AS w2, lead(w1, 2) OVER s AS w3, lead(w1, 3) OVER s AS w4
      FROM w WINDOW s AS (PARTITION BY pid ORDER BY i)),
g AS (
  SELECT lang, [w1] AS ws FROM x
  UNION ALL SELECT lang, [w1, w2] FROM x WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, [w1, w2, w3] FROM x WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, [w1, w2, w3, w4] FROM x WHERE w4 IS NOT NULL),
f AS (SELECT lang, ws, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, count(*) AS n FROM x GROUP BY lang),
cut AS (SELECT lang, ws, f AS a, unnest(range(1, len(ws))) AS k FROM f WHERE len(ws) > 1),
s AS (SELECT c.lang, c.ws, c.a, c.k, l.f AS l, r.f AS r, (2000000 * c.a) // (l.f + r.f) AS score
      FROM cut c JOIN f l ON l.lang = c.lang AND l.ws = c.ws[1:c.k]
                 JOIN f r ON r.lang = c.lang AND r.ws = c.ws[c.k + 1:]),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
inside AS (
  SELECT lang, ws[b:e] AS ws, max(f) AS holder
  FROM (SELECT lang, ws, f, b, unnest(range(b + 1, len(ws) + 1)) AS e
        FROM (SELECT lang, ws, f, unnest(range(1, len(ws))) AS b FROM f WHERE len(ws) > 2))
  WHERE e - b + 1 < len(ws) GROUP BY ALL),
kept AS (SELECT low.*, array_to_string(low.ws, ' ') AS phrase FROM low LEFT JOIN inside USING (lang, ws)
         WHERE holder IS NULL OR 100 * holder < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
           FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
       score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

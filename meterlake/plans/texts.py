"""Queries of text functions over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.operators import texts as T
from meterlake.plans import query
from meterlake.sources import samples as S

WORDS = ["idiot", "worthless", "clown", "pathetic"]


def _ranges(ranges):
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)


def _count(text, pattern):
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _tokens(provider):
    return f"ceil({' + '.join(f'{w} * {kind}_n' for kind, w in T.WEIGHTS[provider].items())})::BIGINT"


#: ideographs and emoji make room for a sign that no class has, so that they part runs of letters and digits
TOKENS = f"""
WITH parts AS (
  SELECT doc_id, COALESCE(source, '') AS source, COALESCE(text, '') AS body,
    regexp_replace(body, '[{_ranges(T.CJK_RANGES + T.EMOJI_RANGES)}]', chr(1), 'g') AS runs,
    regexp_replace(body, '[{_ranges(T.CJK_RANGES + T.EMOJI_RANGES)}\\pL\\pN\\pZ\\t\\n\\v\\f\\r\\x{{85}}]', '', 'g') AS signs
  FROM documents),
counts AS (
  SELECT doc_id, source,
    {_count("body", "[\\t\\n]")} AS newline_n, {_count("body", "[\\v\\f\\r\\x{85}\\pZ]")} AS space_n,
    {_count("body", f"[{_ranges(T.CJK_RANGES)}]")} AS cjk_n, {_count("body", f"[{_ranges(T.EMOJI_RANGES)}]")} AS emoji_n,
    {_count("runs", "\\pL+")} AS word_n, {_count("runs", "\\pN+")} AS number_n,
    {_count("signs", f"[{T.MATH}{_ranges(T.MATH_RANGES)}]")} AS math_n,
    {_count("signs", "@")} AS at_n, {_count("signs", f"[{T.URL}]")} AS url_n,
    length(signs) - math_n - at_n - url_n AS symbol_n
  FROM parts)
SELECT doc_id, CASE WHEN contains(lower(source), 'gemini') THEN {_tokens("gemini")} ELSE {_tokens("claude")} END AS claude,
  {_tokens("gemini")} AS gemini, {_tokens("openai")} AS openai
FROM counts"""


@query(TOKENS)
def t1_t2_token_estimates(spark, sf_dir):
    name = F.concat(F.lit("claude-"), F.coalesce("source", F.lit("")))
    docs = S.table(spark, sf_dir, "documents").withColumn("provider", T.provider_of(name))
    return docs.select(
        "doc_id",
        T.estimate_tokens("text", "provider").alias("claude"),
        T.estimate_tokens("text", F.lit("gemini")).alias("gemini"),
        T.estimate_tokens("text", F.lit("openai")).alias("openai"),
    )


@query(f"""SELECT doc_id, list_sort(list_filter({WORDS}, lambda w: contains(lower(text), w))) AS words FROM documents
  WHERE len(list_filter({WORDS}, lambda w: contains(lower(text), w))) > 0""")
def t3_sensitive_words(spark, sf_dir):
    found = S.table(spark, sf_dir, "documents").select(
        "doc_id", F.array_sort(T.sensitive_words("text", WORDS)).alias("words")
    )
    return found.where(F.size("words") > 0)


@query(f"SELECT doc_id, md5(regexp_replace(text, '{'|'.join(WORDS)}', '**###**', 'gi')) AS digest FROM documents")
def t4_replace_words(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").withColumn("new", T.replace_words("text", WORDS)).select(
        "doc_id", F.md5("new.text").alias("digest")
    )


@query(f"""SELECT conv_id, bool_or(h) AS flagged, min(turn) FILTER (h) AS first_turn, count(*) FILTER (h) AS hits
  FROM (SELECT *, regexp_matches(lower(text), '{'|'.join(WORDS)}') AS h FROM conversations) GROUP BY 1""")
def t5_conversations(spark, sf_dir):
    return T.scan_conversations(S.table(spark, sf_dir, "conversations"), WORDS)


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE sha256(c_name) END AS fingerprint FROM customer")
def t6_fingerprints(spark, sf_dir):
    secret = F.when(F.col("c_custkey") % 7 == 0, "  ").otherwise(F.concat("c_name", F.lit(" \n")))
    return S.table(spark, sf_dir, "customer").withColumn("secret", secret).select(
        "c_custkey", T.fingerprint("secret").alias("fingerprint")
    )

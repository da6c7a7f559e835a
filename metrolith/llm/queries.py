"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.io import table
from metrolith.llm import ann, chat, lm, minhash, mixing, packing, simhash, substring, toxicity, url_filter


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Production parameters.
RULES = [
    url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/"),
]
EXTRA_TURNS = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), 0.3)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"), (3, 1, 2), 1.5, 2.0)
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("first_position")).orderBy("first_position", "doc_id").drop("first_position")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substring.dedup_substrings(table(spark, sf_dir, "documents"), 50, 10)
    joined = F.trim(F.regexp_replace("kept_text", r"[\x20\x09-\x0D]+", " "))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(joined, 256).alias("kept_sha256"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list, which the tables don't hold, is made from them: hosts seen with a tracking parameter."""
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES, F.col("url").contains("utm_"))


def op7_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_documents(table(spark, sf_dir, "documents"))


def minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of op7's operator: signature bands joined and Jaccard verified, with a class id for every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_inner_product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is the documents labelled as of good quality, the background the whole corpus."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, turns.schema)]) for row in EXTRA_TURNS])
    extra = spark.range(1).select(F.inline(rows))
    return chat.digest(chat.format_conversations(turns.unionByName(extra)))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_source_mixing": op4_source_mixing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_url_filters": op6_url_filters,
    "op7_minhash_fingerprints": op7_minhash_fingerprints,
    "minhash_classes": minhash_classes,
    "op8_inner_product_search": op8_inner_product_search,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_chat_formatting": op10_chat_formatting,
}

SQL = {
    "op5_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
first AS (SELECT k, min(doc_id) AS least FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (k) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
""",
    "op6_url_filters": """
WITH p AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
listed AS (SELECT DISTINCT host FROM p WHERE contains(url, 'utm_')),
fit AS (
  SELECT p.page_id, p.url, p.host, p.path, r.verdict AS v, r.rhost || r.rpath AS rule,
         row_number() OVER (PARTITION BY p.page_id, p.url ORDER BY length(r.rhost || r.rpath) DESC) AS k
  FROM p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM fit WHERE k = 1
""",
    "op10_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
         replace(replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\e'), '<turn/>', '\m') AS body,
         replace(replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\e'), '<turn/>', '\m'), chr(10), '\l') AS name
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(body) + CASE WHEN role IS NOT DISTINCT FROM before THEN 7 ELSE length(name) + 6 END
                + CASE WHEN role IS NOT DISTINCT FROM after THEN 0 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
""",
}

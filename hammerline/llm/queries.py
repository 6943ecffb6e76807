"""The registered query of each corpus operator, with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hammerline.llm import decontaminate, exact, lmscore, packing, pagetext, phrases, quality, resample, simhash, substring, tokenstore, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learned, weights = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, learned, weights)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    folder = tokenstore.write_tokens(docs)
    rows = tokenstore.lookup(spark, folder, docs.select("doc_id"), with_ids=False)
    return rows.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lmscore.score(_table(spark, sf_dir, "documents"), good)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.col("repeats.kept"), 256).alias("kept_sha256")
    return found.select("doc_id", "repeats.n_words", "repeats.n_removed", kept)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    measured = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return found.select("doc_id", *[f"quality.{c}" for c in measured])


#: Rules of the query (fixed values).
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Site names whose pages make up the block list of the query (fixed values).
LISTED_SITES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.filter(F.col("url").rlike(f"://([^/?#]*[.])?({'|'.join(LISTED_SITES)})[.]")).select("url")
    return urls.judge_urls(pages, URL_RULES, listed)


OP8_SQL = """
WITH p AS (SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
k AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www[.]', '') || regexp_replace(path, '/+$', '') END AS key FROM p),
rules(verdict, h, s) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
    ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fit AS (SELECT page_id, h || s AS rule, verdict FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || s) DESC, length(h) DESC) = 1),
listed AS (SELECT DISTINCT key FROM k WHERE key IS NOT NULL
    AND regexp_matches(url, '://([^/?#]*[.])?(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)[.]'))
SELECT k.page_id, k.host, k.path, fit.rule,
    coalesce(fit.verdict, CASE WHEN listed.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM k LEFT JOIN fit USING (page_id) LEFT JOIN listed USING (key)"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.report(decontaminate.find_windows(docs, _table(spark, sf_dir, "benchmark")))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pagetext.extract(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH pieces AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
numbered AS (SELECT row_number() OVER () AS p, lang, piece FROM pieces),
split AS (SELECT p, lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM numbered),
w AS (SELECT p, lang, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM split),
s AS (SELECT lang, w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY p ORDER BY i)),
f1 AS (SELECT lang, w1, count(*) AS f FROM s GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM s WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM s WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
cut AS (
    SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r, 1 AS k FROM f2
        JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
        WHERE NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w1 = f2.w1 AND f3.w2 = f2.w2 AND 100 * f3.f >= 50 * f2.f)
        AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w2 = f2.w1 AND f3.w3 = f2.w2 AND 100 * f3.f >= 50 * f2.f)
    UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, x.f, y.f, 1 FROM f3
        JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
    UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, x.f, y.f, 2 FROM f3
        JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
best AS (SELECT *, ((1000000 * a::HUGEINT * a) // (l::HUGEINT * r))::BIGINT AS score FROM cut
    QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n, score FROM best JOIN n USING (lang)
WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= 2000"""


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), columns=["doc_id"])
    return found.select("doc_id", *[f"copies.{c}" for c in ("keep_id", "group_size", "kept", "text_sha256")])


OP12_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_token_store": op3_token_store,
    "op4_lm_score": op4_lm_score,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op8_url_filters": op8_url_filters,
    "op7_decontamination": op7_decontamination,
    "op9_html_main_text": op9_html_main_text,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES: dict[str, str] = {
    "op6_quality_rules": quality.oracle_sql(),
    "op8_url_filters": OP8_SQL,
    "op11_phrase_collocations": OP11_SQL,
    "op12_exact_dedup": OP12_SQL,
}

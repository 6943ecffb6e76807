"""Queries over texts, pages and event streams, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from hammerline.functions import denominations as dn
from hammerline.functions import text as t
from hammerline.plans import market
from hammerline.sources import derived as d
from hammerline.streaming import streams

QUERIES, ORACLES = {}, {}


def add(name, build, sql=None):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


def _docs(s, f):
    return d.table(s, f, "documents").select("doc_id", "text")


_PLAIN = f"translate(lower(coalesce({{0}}, '')), '{t.ACCENTED}', '{t.PLAIN}')"
_SIGNS = _PLAIN
for _sign, _word in t.SIGN_WORDS.items():
    _SIGNS = f"replace({_SIGNS}, '{_sign}', '{_word}')"
_NORM = f"trim(regexp_replace(regexp_replace({_SIGNS}, '[^{t.KEPT}]+', ' ', 'g'), ' +', ' ', 'g'))"
_TOK = f"list_filter(list_distinct(string_split({_NORM}, ' ')), lambda x: x <> '')"
#: Each document's words with the place where each first stands.
_FIRST = f"firsts AS (SELECT doc_id, word, min(p) AS p FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM (SELECT doc_id, string_split({_NORM.format('text')}, ' ') AS ws FROM documents)) WHERE word <> '' GROUP BY ALL)"
_lower = "lower(coalesce({0}, ''))"
add("norm_identity", lambda s, f: _docs(s, f).select("doc_id", F.md5(t.norm(F.col("text"))).alias("norm_md5")), f"SELECT doc_id, md5({_NORM.format('text')}) AS norm_md5 FROM documents")
add("transliterate_greek", lambda s, f: d.table(s, f, "part").select("p_partkey", t.transliterate_greek(F.concat(F.lit("Θεσσαλός χψ "), F.translate("p_name", "abgdek", "αβγδεκ"))).alias("latin")),
    f"SELECT p_partkey, replace(replace(replace(translate({_PLAIN.format("'Θεσσαλός χψ ' || translate(p_name, 'abgdek', 'αβγδεκ')")}, '{t.GREEK}', '{t.LATIN}'), 'θ', 'th'), 'χ', 'ch'), 'ψ', 'ps') AS latin FROM part")
_greek = lambda: F.when(F.col("p_partkey") % 3 == 0, F.translate("p_name", "abgdek", "αβγδεκ")).otherwise(F.col("p_name"))
_GREEK = "CASE WHEN p_partkey % 3 = 0 THEN translate(p_name, 'abgdek', 'αβγδεκ') ELSE p_name END"
_LATIN = f"replace(replace(replace(translate({_PLAIN.format('g')}, '{t.GREEK}', '{t.LATIN}'), 'θ', 'th'), 'χ', 'ch'), 'ψ', 'ps')"
add("text_variants", lambda s, f: d.table(s, f, "part").select("p_partkey", F.array_join(F.array_distinct(F.array(t.norm(_greek()), t.norm(t.transliterate_greek(_greek())))), "|").alias("variants")),
    f"SELECT p_partkey, CASE WHEN a = b THEN a ELSE a || '|' || b END AS variants FROM (SELECT p_partkey, {_NORM.format('g')} AS a, {_NORM.format(_LATIN)} AS b FROM (SELECT p_partkey, {_GREEK} AS g FROM part))")
add("distinct_preserving_order", lambda s, f: _docs(s, f).select("doc_id", F.size(t.tokens(F.col("text"))).alias("n_tokens"), F.md5(F.array_join(t.tokens(F.col("text")), " ")).alias("md5")),
    f"WITH {_FIRST} SELECT doc_id, count(word)::INTEGER AS n_tokens, md5(coalesce(string_agg(word, ' ' ORDER BY p), '')) AS md5 FROM documents LEFT JOIN firsts USING (doc_id) GROUP BY doc_id")
add("contains_alias", lambda s, f: _docs(s, f).select("doc_id", *[t.contains_phrase(F.col("text"), p).alias(n) for n, p in (("of_the", "of the"), ("de_la", "de la"), ("in_der", "in der"))]),
    "SELECT doc_id, " + ", ".join(f"contains(' ' || {_NORM.format('text')} || ' ', ' {p} ') AS {n}" for n, p in (("of_the", "of the"), ("de_la", "de la"), ("in_der", "in der"))) + " FROM documents")
add("looks_unavailable", lambda s, f: d.table(s, f, "conversations").select("conv_id", "turn", t.looks_unavailable(F.col("text")).alias("gone")), f"SELECT conv_id, turn, regexp_matches({_lower.format('text')}, '\\b({t.UNAVAILABLE})\\b') AS gone FROM conversations")
add("product_scope", lambda s, f: _docs(s, f).groupBy(t.product_scope(F.col("text")).alias("scope")).agg(F.count("*").alias("n")), f"SELECT CASE WHEN regexp_matches({_lower.format('text')}, '{t.SET_WORDS}') THEN 'SET' ELSE 'SINGLE' END AS scope, count(*) AS n FROM documents GROUP BY ALL")
_VT = f"list_filter({_TOK}, lambda x: length(x) >= 3 AND x NOT IN ({', '.join(repr(w) for w in t.STOP)}) AND NOT regexp_matches(x, '[0-9]'))"
add("variant_tokens", lambda s, f: _docs(s, f).select("doc_id", F.size(t.variant_tokens(F.col("text"))).alias("n"), F.md5(F.array_join(t.variant_tokens(F.col("text")), " ")).alias("md5")),
    f"WITH {_FIRST}, v AS (SELECT * FROM firsts WHERE length(word) >= 3 AND word NOT IN ({', '.join(repr(w) for w in t.STOP)}) AND NOT regexp_matches(word, '[0-9]')) "
    "SELECT doc_id, count(word)::INTEGER AS n, md5(coalesce(string_agg(word, ' ' ORDER BY p), '')) AS md5 FROM documents LEFT JOIN v USING (doc_id) GROUP BY doc_id")  # fmt: skip
add("variant_matches", lambda s, f: d.table(s, f, "part").select("p_partkey", t.variant_matches(t.variant_tokens(F.col("p_type")), F.concat_ws(" ", "p_name", "p_type")).alias("both"), t.variant_matches(t.variant_tokens(F.col("p_name")), F.col("p_type")).alias("other")),
    "SELECT p_partkey, " + ", ".join(f"len(w{i}) > 0 AND len(list_filter(w{i}, lambda x: contains(t{i}, x))) >= ceil(len(w{i}) * 0.6) AS {n}" for i, n in ((1, "both"), (2, "other")))
    + f" FROM (SELECT p_partkey, {_VT.format('p_type')} AS w1, {_NORM.format(chr(112) + '_name || chr(32) || p_type')} AS t1, {_VT.format('p_name')} AS w2, {_NORM.format('p_type')} AS t2 FROM part)")
_raw = lambda: F.concat(F.lit("EUR "), F.when(F.col("p_partkey") % 4 == 0, F.format_number(F.col("p_retailprice"), 2)).when(F.col("p_partkey") % 4 == 1, F.translate(F.format_number(F.col("p_retailprice"), 2), ",.", ".,")).when(F.col("p_partkey") % 4 == 2, F.lit("1.234.567")).otherwise(F.lit("12,5")))
add("parse_number", lambda s, f: market.r4(d.table(s, f, "part").select("p_partkey", t.parse_number(_raw()).alias("value"))),
    "SELECT p_partkey, round(CASE p_partkey % 4 WHEN 2 THEN 1234567 WHEN 3 THEN 12.5 ELSE round(p_retailprice, 2) END + 1e-7, 4)::DOUBLE AS value FROM part")
add("parse_year", lambda s, f: _docs(s, f).select("doc_id", t.parse_year(F.col("text")).alias("year")),
    "SELECT doc_id, CAST(list_extract(regexp_extract_all(text, '\\b(1[0-9]{3}|2[01][0-9]{2})\\b', 1), -1) AS INTEGER) AS year FROM documents")
_label = lambda: F.concat(F.element_at(F.array(*map(F.lit, ("1/2 Dollar", "0,5 Euro", "1000 Lire", "25 Cents", "no unit", "2.5 Francs"))), (F.col("p_partkey") % 6 + 1).cast("int")), F.lit(" "), F.col("p_name"))
add("parse_denomination", lambda s, f: d.table(s, f, "part").select("p_partkey", *[c.alias(n) for c, n in zip(dn.parse_denomination(F.regexp_replace(_label(), ",", ".")), ("value", "unit"))]),
    "SELECT p_partkey, list_extract([0.5, 0.5, 1000, 25, NULL, 2.5]::DOUBLE[], CAST(p_partkey % 6 + 1 AS INTEGER)) AS value, list_extract(['dollar', 'euro', 'lira', 'cent', NULL, 'franc'], CAST(p_partkey % 6 + 1 AS INTEGER)) AS unit FROM part")
add("identity_key", lambda s, f: d.specs(s, f).select("id", t.identity_key(F.col("country"), F.col("denomination_value"), F.col("issue_year")).alias("key")),
    f"WITH {d.SPECS_SQL} SELECT id, lower(country) || '|' || regexp_replace(CAST(denomination_value AS VARCHAR), '\\.0$', '') || '|' || coalesce(CAST(issue_year AS VARCHAR), '') AS key FROM specs")
add("item_id_from_url", lambda s, f: d.table(s, f, "pages").select("page_id", t.item_id_from_url(F.col("url")).alias("item")), "SELECT page_id, nullif(regexp_extract(coalesce(url, ''), '[?&](?:id|page)=([0-9]+)', 1), '') AS item FROM pages")
add("dealer_from_url", lambda s, f: d.table(s, f, "pages").select("page_id", t.site_from_url(F.col("url")).alias("site")), "SELECT page_id, nullif(regexp_extract(coalesce(url, ''), '://(?:www\\.|m\\.|blog\\.)?([^./?#]+)\\.', 1), '') AS site FROM pages")
add("html_to_summary", lambda s, f: d.table(s, f, "pages").select("page_id", t.summary(F.regexp_replace("html", r"(?s)^.*<article>", "")).alias("summary")),
    "WITH p AS (SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(regexp_replace(html, '(?s)^.*<article>', ''), ''), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM pages) "
    "SELECT page_id, CASE WHEN length(t) > 220 THEN regexp_replace(substring(t, 1, 217), '\\s+\\S*$', '') || '...' ELSE t END AS summary FROM p")  # fmt: skip
add("news_topk", lambda s, f: d.table(s, f, "events").filter("event_type = 'view' OR event_type IS NOT NULL").select("event_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts")).orderBy(F.desc("ts"), "event_id").limit(40),
    "SELECT event_id, event_type, ts FROM events WHERE event_type IS NOT NULL ORDER BY ts DESC, event_id LIMIT 40")
add("correction_latest_wins", lambda s, f: d.table(s, f, "conversations").groupBy("conv_id", "role").agg(F.max_by(F.md5("text"), "turn").alias("last_md5"), F.max("turn").alias("turn")), "SELECT conv_id, role, arg_max(md5(text), turn) AS last_md5, max(turn) AS turn FROM conversations GROUP BY ALL")

# --- streams -------------------------------------------------------------------------------------------

_ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
add("stream_rate_count", lambda s, f: streams.run_to_table(streams.rate_count(streams.landed(s, f, "events"), 1), "complete").select("user_id", _ntz("minute"), "n", "over"),
    "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n, count(*) > 1 AS over FROM events GROUP BY ALL")
add("stream_latest_spot", lambda s, f: market.r4(streams.run_to_table(streams.latest_by_window(streams.landed(s, f, "events"), "event_type", "value"), "complete").select("event_type", _ntz("day"), "last", "n")),
    "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, round(arg_max(value, (ts, event_id)) + 1e-7, 4) AS last, count(*) AS n FROM events GROUP BY ALL")
add("stream_upsert_observations", lambda s, f: streams.run_to_table(streams.landed(s, f, "events").select("user_id", "event_type", "ts", "event_id"), "append", ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id"),
    "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
add("stream_corrections", lambda s, f: streams.run_to_table(streams.landed(s, f, "conversations").select("conv_id", "role", "turn"), "append", ["conv_id", "role"], ["turn"]),
    "SELECT conv_id, role, max(turn) AS turn FROM conversations GROUP BY ALL")
add("stream_news_dedupe", lambda s, f: streams.run_to_table(streams.landed(s, f, "pages").select("url", "page_id"), "append", ["url"], ["page_id"]), "SELECT url, max(page_id) AS page_id FROM pages GROUP BY ALL")


def _streamed_bids(s, f):
    k = F.col("event_id")
    rows = streams.landed(s, f, "events").select(
        k.alias("bid_id"), (F.col("user_id") % 200 + 1).alias("target_id"), F.format_string("%d", k * 37 % 2000).alias("current_hammer_raw"),
        F.lit(15.0).alias("buyer_premium_pct"), F.lit(5.0).alias("shipping"), F.lit(0.0).alias("fixed_fees"), F.lit(0.0).alias("taxes"),
    )
    return streams.run_to_table(streams.bid_advice(rows, market.snapshots(s, f)), "append").groupBy("recommendation").agg(F.count("*").alias("n"))


_ST = market.ADVICE.replace(d.BIDS_SQL, "bids AS (SELECT event_id AS bid_id, user_id % 200 + 1 AS target_id, CAST(event_id * 37 % 2000 AS VARCHAR) AS current_hammer_raw, 15.0::DOUBLE AS buyer_premium_pct, 5.0::DOUBLE AS shipping, 0.0::DOUBLE AS fixed_fees, 0.0::DOUBLE AS taxes FROM events)")
add("stream_bid_advice", _streamed_bids, f"WITH {_ST.replace(', 4)', ' + 1e-7, 4)')} SELECT recommendation, count(*) AS n FROM advice GROUP BY ALL")

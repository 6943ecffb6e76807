"""Quality rules by distribution divergence, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hammerline.llm.common import free_name

WHITE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"

#: Character classes, in the order of the shares below: everything that is left is the last class.
CLASSES = ["lower", "upper", "digit", "white", "point", "symbol", "other"]
#: Shares of the classes in plain prose of each language (fixed values, counted on a clean corpus).
CHAR_SHARES = {
    "en": [0.7952, 0.0138, 0.0006, 0.1667, 0.0237, 0.0, 0.0],
    "de": [0.7728, 0.0123, 0.0004, 0.1546, 0.0218, 0.0, 0.0381],
    "fr": [0.7077, 0.0104, 0.0008, 0.1667, 0.0238, 0.0, 0.0906],
    "es": [0.7243, 0.0120, 0.0008, 0.1616, 0.0230, 0.0, 0.0782],
}
#: The commonest words of each language and their shares in plain prose (fixed values, as above).
WORD_SHARES = {
    "en": {"the": 0.0629, "of": 0.0365, "and": 0.0264, "to": 0.0200, "a": 0.0158, "in": 0.0139},
    "de": {"der": 0.0622, "die": 0.0366, "und": 0.0263, "in": 0.0200, "den": 0.0162, "von": 0.0136},
    "fr": {"de": 0.0625, "la": 0.0378, "le": 0.0253, "et": 0.0208, "les": 0.0164, "des": 0.0140},
    "es": {"de": 0.0622, "la": 0.0364, "que": 0.0255, "el": 0.0199, "en": 0.0163, "y": 0.0137},
}

#: A text of fewer words is not compared at all; up to the second bound the looser limit holds; the words
#: are compared from the third bound on, where their shares have settled.
MIN_WORDS, SETTLED_WORDS, MIN_WORDS_FOR_WORDS = 20, 60, 100
LOOSE_CHAR_LIMIT, CHAR_LIMIT, WORD_LIMIT = 0.45, 0.26, 0.26


def divergence(found: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of an array of shares to a reference."""

    def term(p: Column, q: Column) -> Column:
        part = lambda x: F.when(x > 0, x * F.log2(x / ((p + q) / 2))).otherwise(0.0)
        return part(p) + part(q)

    terms = F.zip_with(found, F.array(*map(F.lit, reference)), term)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def measures(docs: DataFrame, text_col: str = "text", repeat_words: int = 5) -> DataFrame:
    """docs, all columns kept, and last a struct quality of: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, char_divergence, word_divergence (null below the least lengths), kept."""
    k = repeat_words
    own = ["__row"]  # the document as it is, so that no name can clash
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    step = docs.select(F.struct("*").alias("__row"), text.alias("__text")).select(
        *own,
        F.length("__text").alias("__n"),
        F.array_remove(F.split("__text", f"[{WHITE}]+"), "").alias("__w"),
        F.regexp_replace("__text", "[a-z]+", "").alias("__rest"),
        F.filter(F.split("__text", "\n"), lambda x: x.rlike(f"[^{WHITE}]")).alias("__lines"),
    )
    runs = F.when(
        F.size("__w") >= k,
        F.transform(F.slice("__w", F.lit(1), F.size("__w") - (k - 1)), lambda x, i: F.xxhash64(x, *[F.get("__w", i + j) for j in range(1, k)])),
    )
    is_word = lambda w: lambda x: x == w
    count = lambda pattern: F.regexp_count("__rest", F.lit(pattern))
    common = sorted({w for shares in WORD_SHARES.values() for w in shares})
    step = step.select(
        *own,
        F.size("__w").alias("__words"),
        "__n",
        count(f"[{WHITE}]").alias("__white"),
        count("[A-Z]").alias("__upper"),
        count("[0-9]").alias("__digit"),
        count(r"[.,;:'\"()!?-]").alias("__point"),
        count(f"[{SYMBOLS}]").alias("__marks"),
        count(r"[#*$%&|<>@^~_=+/\\{}\[\]`]").alias("__symbol"),
        F.length("__rest").alias("__others"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("__dup_lines"),
        runs.alias("__runs"),
        F.when(F.size("__w") >= MIN_WORDS_FOR_WORDS, F.filter(F.transform("__w", F.lower), lambda x: x.isin(common))).alias("__common"),
    )
    counts = F.struct(*[F.size(F.filter("__common", is_word(w))).alias(w) for w in common])
    step = step.select(
        *own,
        *[c for c in step.columns if c not in own and c not in ("__runs", "__common")],
        counts.alias("__count"),
        F.when(
            F.size(F.array_distinct("__runs")) < F.size("__runs"),
            F.sort_array(F.transform("__runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("__sorted"),
    )
    twice = F.filter("__sorted", lambda x, i: (x.h == F.get("__sorted", i - 1).h) | (x.h == F.get("__sorted", i + 1).h))
    twice = F.when(F.col("__sorted").isNotNull(), F.sort_array(F.transform(twice, lambda x: x.i)))
    step = step.withColumn("__at", twice).drop("__sorted")
    cover = F.transform("__at", lambda x, i: F.least(F.lit(k), F.coalesce(F.get("__at", i + 1) - x, F.lit(k))))
    covered = F.coalesce(F.aggregate(cover, F.lit(0), lambda a, x: a + x), F.lit(0))

    n = F.col("__words")
    lower = F.col("__n") - F.col("__others")
    parts = [lower, *[F.col(f"__{c}") for c in CLASSES[1:-1]]]
    parts.append(F.col("__others") - sum(parts[2:], parts[1]))
    step = step.withColumn("__covered", covered)
    step = step.withColumn("__shares", F.transform(F.array(*parts), lambda x: x / F.greatest(F.col("__n"), F.lit(1))))
    for language, reference in WORD_SHARES.items():
        found = F.array(*[F.col(f"__count.{w}") / n for w in reference])
        step = step.withColumn(f"__{language}", found)
    chars = F.least(*[divergence(F.col("__shares"), q) for q in CHAR_SHARES.values()])
    words = []
    for language, reference in WORD_SHARES.items():
        rest = 1 - F.aggregate(f"__{language}", F.lit(0.0), lambda a, x: a + x)
        words.append(divergence(F.concat(F.col(f"__{language}"), F.array(rest)), [*reference.values(), 1 - sum(reference.values())]))
    chars, words = F.when(n >= MIN_WORDS, chars), F.when(n >= MIN_WORDS_FOR_WORDS, F.least(*words))
    failed = (n < 10) | (100 * F.col("__covered") > 20 * n)
    step = step.withColumn("__failed", failed).withColumn("__chars", chars).withColumn("__by_words", words)
    limit = F.when(n >= SETTLED_WORDS, CHAR_LIMIT).otherwise(LOOSE_CHAR_LIMIT)
    close = (F.coalesce(F.col("__chars"), F.lit(0.0)) <= limit) & (F.coalesce(F.col("__by_words"), F.lit(0.0)) <= WORD_LIMIT)
    result = F.struct(
        n.cast("long").alias("n_words"),
        (F.col("__n") - F.col("__white")).cast("long").alias("word_chars"),
        F.col("__marks").cast("long").alias("n_symbols"),
        F.col("__dup_lines").cast("long").alias("n_dup_lines"),
        F.col("__covered").cast("long").alias("n_repeat_words"),
        F.col("__failed").alias("base_failed"),
        F.col("__chars").alias("char_divergence"),
        F.col("__by_words").alias("word_divergence"),
        # Not deterministic, so that a filter on the verdict stays above this step: below, it would hold
        # all expressions of the steps at once, again and again inside their lambdas.
        (~F.col("__failed") & close & (F.spark_partition_id() >= 0)).alias("kept"),
    )
    return step.select("__row.*", result.alias(free_name(docs, "quality")))


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and last the struct quality (with an underscore more where docs have a column of that name); null
    texts have no words and fail.

    The references are English, German, French and Spanish. A longer text of another language is far from
    all four and is not kept: a corpus of other languages needs references of its own.

    A text passes if it passes the base rules and its character classes, and in longer texts its common
    words, lie within the limits of the nearest language reference. All of it is one pass without a
    shuffle. Null ids, repeated rows and other columns stay as they are.
    """
    return measures(docs, text_col)


def oracle_sql() -> str:
    """The same for DuckDB over the table documents (its doc_id is unique)."""

    def distance(found: list[str], reference: list[float]) -> str:
        terms = []
        for p, q in zip(found, reference):
            terms.append(f"CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q!r}) / 2)) ELSE 0 END")
            if q:
                terms.append(f"{q!r} * log2({q!r} / (({p} + {q!r}) / 2))")
        return f"sqrt(greatest(({' + '.join(terms)}) / 2, 0))"

    chars = ", ".join(distance([f"s_{c}" for c in CLASSES], q) for q in CHAR_SHARES.values())
    words = []
    common = sorted({w for shares in WORD_SHARES.values() for w in shares})
    for reference in WORD_SHARES.values():
        found = [f"(c_{w} / n_words::DOUBLE)" for w in reference]
        words.append(distance([*found, f"(1 - ({' + '.join(found)}))"], [*reference.values(), 1 - sum(reference.values())]))
    count = lambda pattern: f"len(regexp_extract_all(t, '{pattern}'))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^{WHITE}]+') AS ws FROM d),
runs AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS g FROM w, unnest(range(1, len(ws) - 3)) AS u(i)),
twice AS (SELECT doc_id, i FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
gaps AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS c FROM twice),
covered AS (SELECT doc_id, sum(c)::BIGINT AS n_repeat_words FROM gaps GROUP BY doc_id),
lines AS (SELECT doc_id, (count(l) - count(DISTINCT l))::BIGINT AS n_dup_lines
  FROM d, unnest(string_split(t, chr(10))) AS u(l) WHERE regexp_matches(l, '[^{WHITE}]') GROUP BY doc_id),
m AS (SELECT w.doc_id, t, len(ws) AS n_words, length(t) - {count(f'[{WHITE}]')} AS word_chars,
  {count(f'[{SYMBOLS}]')} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  greatest(length(t), 1)::DOUBLE AS n,
  {count('[a-z]')} AS k_lower, {count('[A-Z]')} AS k_upper, {count('[0-9]')} AS k_digit, {count(f'[{WHITE}]')} AS k_white,
  {count("[.,;:''\"()!?-]")} AS k_point, {count("[#*$%&|<>@^~_=+/\\\\{}\\[\\]`]")} AS k_symbol,
  {', '.join(f"len(list_filter(ws, lambda x: lower(x) = '{w}')) AS c_{w}" for w in common)}
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
s AS (SELECT *, k_lower / n AS s_lower, k_upper / n AS s_upper, k_digit / n AS s_digit, k_white / n AS s_white,
  k_point / n AS s_point, k_symbol / n AS s_symbol,
  (length(t) - k_lower - k_upper - k_digit - k_white - k_point - k_symbol) / n AS s_other,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND (n_words < {MIN_WORDS} OR least({chars}) <= CASE WHEN n_words >= {SETTLED_WORDS} THEN {CHAR_LIMIT} ELSE {LOOSE_CHAR_LIMIT} END)
  AND (n_words < {MIN_WORDS_FOR_WORDS} OR least({', '.join(words)}) <= {WORD_LIMIT}) AS kept
FROM s"""

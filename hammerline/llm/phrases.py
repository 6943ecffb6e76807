"""Phrase collocations: two and three words that stand together far oftener than apart.

Suffix pointers of all words go, by their leading words, to slices of the hash space, where a multikey
three-way quicksort counts them to a depth of three words and abandons infrequent parts. One leading word
is the route, two where the first is common, three where both are: so no word, and no pair of words,
however common, fills a slice. Before they travel, equal suffixes of some megabytes of text are one entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hammerline.llm import packed
from hammerline.llm.common import released, stored
from hammerline.llm.quicksort import frequent_prefixes

#: A-Z lower-cased; piece borders . , ; : ! ? and line ends to \n; tab to space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
#: Stands for a piece border among words, which have no A-Z.
_BORDER = b"A"
#: Bytes of text of which equal suffixes become one entry; words in a slice, about.
HELD_BYTES = 8_000_000
SPAN_BYTES = 1_000_000
SLICE_WORDS = 2_000_000
#: A word is common that makes more than this share of all words: there are at most as many as 1 / share.
COMMON_SHARE = 1 / 1024
#: Groups in which the best phrases of a language are found first, so that at most _SALTS * top of them meet.
_SALTS = 64


def _tokens(text: str | None) -> Iterator[tuple[list[bytes], int]]:
    """Words and borders of a whole text, about SPAN_BYTES at a time, with the bytes read; no word is cut."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    at = 0
    while at < len(raw):
        held = raw[at : at + SPAN_BYTES].translate(_FOLD)
        at += len(held)
        while at < len(raw) and held[-1] not in b" \n":
            more = raw[at : at + 4096].translate(_FOLD)
            cuts = [c for c in (more.find(b" "), more.find(b"\n")) if c >= 0]
            cut = min(cuts) + 1 if cuts else len(more)
            held, at = held + more[:cut], at + cut
        yield held.replace(b"\n", b" %b " % _BORDER).split(), len(held)


class _Numbers(dict):
    """Words to numbers from 1, in order of their first use; borders are 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Held:
    """The numbered words of some megabytes of text, by language: (numbers, ids, how many ids at the front
    come from the part before, how many at the end go on in the part behind)."""

    def __init__(self):
        self.size, self.langs, self.front, self.back = 0, {}, {}, {}

    def add(self, lang: str, tokens: list[bytes], size: int = 0) -> None:
        numbers, ids = self.langs.setdefault(lang, (_Numbers({_BORDER: 0}), []))
        ids.append(np.fromiter(map(numbers.__getitem__, tokens), np.uint32, len(tokens)))
        self.size += size

    def cut(self, lang: str) -> list[bytes]:
        """The last two words or borders of a text that goes on: their suffixes count in the next part."""
        numbers, ids = self.langs[lang]
        names, last = list(numbers), np.concatenate(ids[-3:])[-2:].tolist()
        self.back[lang] = len(last)
        return [names[i] for i in last]

    def each(self) -> Iterator[tuple[str, list[bytes], np.ndarray, int, int]]:
        for lang, (numbers, ids) in self.langs.items():
            yield lang, list(numbers)[1:], np.concatenate(ids), self.front.get(lang, 0), self.back.get(lang, 0)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[_Held]:
    """Rows (lang, text), some megabytes at a time; a longer text is cut."""
    held = _Held()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for tokens, size in _tokens(text.as_py()):
                if held.size >= HELD_BYTES:
                    begun = held.cut(lang) if lang in held.langs else []
                    yield held
                    held = _Held()
                    if begun:
                        held.add(lang, begun)
                        held.front[lang] = len(begun)
                held.add(lang, tokens, size)
            held.add(lang, [_BORDER], 16)
    if held.langs:
        yield held


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """What Spark's xxhash64(lang, word) gives, unsigned."""
    seed, digest = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42), xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order (usual fixed multipliers)."""
    h = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of three columns of numbers, in order, and how often each occurs."""
    base = np.uint64(max(int(c.max(initial=0)) for c in columns) + 1)
    rows = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        rows = rows * base + c.astype(np.uint64)
    rows, counts = np.unique(rows, return_counts=True)
    out = []
    for _ in columns:
        rows, last = np.divmod(rows, base)
        out.append(last)
    return out[::-1], counts


def _suffixes(held: _Held, common: np.ndarray, bits: int) -> pa.RecordBatch:
    """Each slice's distinct suffixes (word, word, word or 0) with their counts. Where the first two words
    are common, a pair travels alone, and its longer suffixes go to the slices from 2**bits on."""
    hashes, firsts, columns = [np.zeros(1, np.uint64)], 1, [(np.empty(0, np.int64),) * 3]
    for lang, words, ids, _, back in held.each():
        moved = np.where(ids > 0, ids.astype(np.int64) + (firsts - 1), 0)
        hashes.append(word_hashes(lang, words))
        firsts += len(words)
        moved = np.concatenate([moved, [0, 0]])
        a, b, c = moved[:-2], moved[1:-1], moved[2:]
        at = (a > 0) & (b > 0)
        at[len(at) - back :] = False
        columns.append((a[at], b[at], c[at]))
    h = np.concatenate(hashes)
    (a, b, c), n = _distinct(*(np.concatenate(x) for x in zip(*columns)))
    is_common = np.isin(h, common)
    is_common[0] = False
    two, top = is_common[a] & is_common[b], np.uint64(64 - bits)
    route = np.where(is_common[a], _mixed(h[a], h[b]), h[a])
    pa_, pb, pn = _pairs(a[two], b[two], n[two])
    deep = two & (c > 0)
    third = _mixed(_mixed(h[a[deep]], h[b[deep]]), h[c[deep]])
    routes = [_mixed(r, np.uint64(0)) >> top for r in (route[~two], _mixed(h[pa_], h[pb]), third)]
    slices = np.concatenate([*routes[:2], routes[2] + np.uint64(1 << bits)]).astype(np.int64)
    ends = np.zeros(len(pa_), np.uint64)
    rows = [np.concatenate(x) for x in ((a[~two], pa_, a[deep]), (b[~two], pb, b[deep]), (c[~two], ends, c[deep]), (n[~two], pn, n[deep]))]
    order = np.argsort(slices, kind="stable")
    slices, rows = slices[order], [r[order] for r in rows]
    edges = np.flatnonzero(np.concatenate([[len(slices) > 0], slices[1:] != slices[:-1], [len(slices) > 0]]))
    parts = []
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
        used, number = np.unique(np.concatenate([r[s:e] for r in rows[:3]]), return_inverse=True)
        parts.append((int(slices[s]), _packed(h[used], number, rows[3][s:e])))
    return packed.sent(0, parts)


def _pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b), equal ones of which stand together, and their sums of n."""
    if not len(a):
        return a, b, n
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[first], b[first], np.add.reduceat(n, first)


def _packed(vocabulary: np.ndarray, number: np.ndarray, counts: np.ndarray) -> bytes:
    """Hashes of the words that occur, then for each entry three numbers in them, and its count."""
    wide = lambda most: 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    w, c = wide(len(vocabulary)), wide(int(counts.max()))
    head = np.array([len(vocabulary), len(counts), w, c], "<u4").tobytes()
    return head + vocabulary.astype("<u8").tobytes() + number.astype(f"<u{w}").tobytes() + counts.astype(f"<u{c}").tobytes()


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v, n, w, c = np.frombuffer(raw, "<u4", 4).tolist()
    return np.frombuffer(raw, "<u8", v, 16), np.frombuffer(raw, f"<u{w}", 3 * n, 16 + 8 * v), np.frombuffer(raw, f"<u{c}", n, 16 + 8 * v + 3 * n * w)


def _counted(least: int, bits: int):
    """Of one slice: the pairs and triples of word hashes that occur `least` times or more."""

    def count(table: pa.Table) -> pa.Table:
        s = table.column("slice")[0].as_py()
        parts = [_unpacked(b.as_buffer().to_pybytes()) for b in table.column("packed")]
        vocabulary = np.unique(np.concatenate([[np.uint64(0)], *(p[0] for p in parts)]))
        columns: list[list[np.ndarray]] = [[], [], []]
        for hashes, numbers, counts in parts:
            mine = np.searchsorted(vocabulary, hashes).astype(np.int32)[numbers].reshape(3, -1)
            for d in range(3):
                columns[d].append(mine[d])
        keys, weights = [np.concatenate(c) for c in columns], np.concatenate([p[2] for p in parts]).astype(np.int64)
        _, pairs, triples = frequent_prefixes(keys, weights, least)
        found = [triples] if s >= 1 << bits else [pairs, triples]
        word = lambda d: np.concatenate([vocabulary[keys[d][at]] for at, _ in found]).view(np.int64)
        third = word(2)
        no_third = np.concatenate([np.full(len(at), x is pairs) for x in found for at in x[:1]])
        return pa.table(
            {"k1": word(0), "k2": word(1), "k3": pa.array(third, pa.int64(), mask=no_third), "a": np.concatenate([x[1] for x in found])}
        )

    return count


def word_counts(rows: DataFrame) -> DataFrame:
    """rows (lang, text) to (lang, word, f): how often each word occurs, borders not crossed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches):
            for lang, words, ids, front, _ in held.each():
                counts = np.bincount(ids[front:], minlength=len(words) + 1)[1:]
                for at in range(0, len(words), 100_000):
                    part = pa.array(words[at : at + 100_000], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, pa.array(counts[at : at + 100_000], pa.int64())], ["lang", "word", "f"])

    return rows.mapInArrow(released(run), "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def phrase_counts(rows: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """(k1, k2, k3, a): every two (k3 null) and three consecutive words of rows (lang, text) that occur
    `least` times or more, as word hashes, with their count."""
    total = words.agg(F.sum("f")).first()[0] or 0
    common = [r.h & ((1 << 64) - 1) for r in words.filter(F.col("f") > int(total * COMMON_SHARE)).select("h").collect()]
    common, bits = np.array(sorted(common), np.uint64), packed.slice_bits(total, SLICE_WORDS)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches):
            yield _suffixes(held, common, bits)

    routed = rows.mapInArrow(released(route), packed.PACKED)
    return routed.groupBy("slice").applyInArrow(_counted(least, bits), "k1 long, k2 long, k3 long, a long")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exact: products as decimals of 38 digits."""
    wide = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, covered_percent: int = 50, top: int = 2000
) -> DataFrame:
    """Each language's best phrases: (lang, rank, phrase, a, l, r, n, score).

    Words are what spaces and tabs separate inside pieces between . , ; : ! ? and line ends, A-Z lower-cased;
    phrases don't cross pieces. Null texts have no words, null languages are `und`. A candidate has two or
    three words and a count a of `least` or more; a pair goes if a triple that holds it has covered_percent
    in a hundred of its count. Repeated rows count each time, ties end in the phrase's byte order; an empty
    table gives no rows, very long texts are taken a megabyte at a time, other columns don't matter.
    64-bit hashes stand for words: among n different words about n * n / 2**65 collide.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    rows = docs.select(lang.alias("lang"), F.col(text_col).cast("string").alias("text"))
    words = stored(word_counts(rows).withColumn("h", F.xxhash64("lang", "word")), "words")
    found = stored(phrase_counts(rows, words, least), "phrases")
    known = words.filter(F.col("f") >= least)
    name = lambda k, *more: known.select(F.col("h").alias(f"k{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"), *more)
    pairs = found.filter("k3 is null").select("k1", "k2", F.col("a").alias("pair"))
    pairs = pairs.join(name(1, "lang"), "k1").join(name(2), "k2")
    pairs = stored(pairs, "pairs")
    behind = pairs.select(F.col("k1").alias("k2"), F.col("k2").alias("k3"), F.col("pair").alias("last"), F.col("w2").alias("w3"), F.col("f2").alias("f3"))
    triples = found.filter("k3 is not null").join(pairs, ["k1", "k2"]).join(behind, ["k2", "k3"])
    cuts = triples.select("*", _score(F.col("a"), F.col("f1"), F.col("last")).alias("first"), _score(F.col("a"), F.col("pair"), F.col("f3")).alias("second"))
    early = F.col("first") <= F.col("second")
    triples = cuts.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("pair")).alias("l"),
        F.when(early, F.col("last")).otherwise(F.col("f3")).alias("r"), F.least("first", "second").alias("score"),
    )
    in_triples = found.filter("k3 is not null")
    holders = in_triples.select("k1", "k2", "a").union(in_triples.select("k2", "k3", "a")).groupBy("k1", "k2").agg(F.max("a").alias("longer"))
    left = pairs.join(holders, ["k1", "k2"], "left").filter(F.coalesce(100 * F.col("longer") < covered_percent * F.col("pair"), F.lit(True)))
    left = left.select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("pair").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"),
        _score(F.col("pair"), F.col("f1"), F.col("f2")).alias("score"),
    )
    best = (F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))).orderBy(*best)
    chosen = left.union(triples).withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= top)
    chosen = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return chosen.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

"""Near-duplicates by SimHash fingerprints, and by exact Jaccard similarity of word shingles without loss.

Texts are linked where their fingerprints (see simhash) differ in two bits or fewer. Few edited copies come so
near, so texts of similarity 0.8 or more are linked too, found by prefix filtering. Put the distinct shingles of every text in one common order. Two texts of similarity 0.8 or more then share
a shingle among the first n - ceil(0.8 n) + 1 of each, n being their number, so texts that meet on none of
these needn't be compared, and every pair that does is verified. Any common order is right; this one puts the
shingles of fewest texts first. Those of one text alone meet none, so most texts have few left to be met on.

How many texts have a shingle comes from an exchange of packed hashes between sources of documents and
slices of the hash space (see packed); texts stay where they are from beginning to end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hammerline.llm import packed, simhash, substring
from hammerline.llm.common import discard, released, rows_of, stored, stored_in_few
from hammerline.llm.components import connected_components

SHINGLE_WORDS = 5
SEED = 42
#: Texts are alike from LEAST[0] / LEAST[1] on; whole numbers, so that a bound is never rounded the wrong way.
LEAST = (4, 5)
#: About so many shingles a slice.
SLICE_SHINGLES = 2_000_000
MARKS = "id long, x long, src long, at int, c long, fp long, n int, bits array<long>, places array<int>, tokens array<long>"
#: Bits of a text's sketch, in longs: a bit is 1 if an odd number of its shingles fall on it.
SKETCH_LONGS = 8
#: Rounds in which each class is compared with one other at most, before what is left is compared by pairs.
ROUNDS = 2


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text of fewer words is one shingle, no words none."""
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(substring.Rolling(words).runs(min(SHINGLE_WORDS, len(words))))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Two sketches differ in no more bits than the sets in shingles."""
    odd = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % (64 * SKETCH_LONGS), minlength=64 * SKETCH_LONGS) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def text_class(words: list[bytes]) -> int:
    """Equal for texts of the same words."""
    return xxhash.xxh64_intdigest(b" ".join(words), SEED) - (1 << 63)


def prefix_size(n: int) -> int:
    return n - -(-n * LEAST[0] // LEAST[1]) + 1 if n else 0


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.StructArray]]:
    """(src, its documents: id, x, text)."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column(0)[k].as_py(), batch.column(1)[k].values


def _slots(hashes: np.ndarray) -> np.ndarray:
    """Shingles are counted by 32 bits of their hashes: two in a slot only stand later in the order."""
    return hashes & np.uint64(0xFFFFFFFF)


def _ask(src: int, found: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """A source's slots and how many of its texts have each."""
    slots, n = np.unique(_slots(np.concatenate(found)), return_counts=True)
    low, n = slots.astype("<u4"), n.astype("<u4")
    return packed.sent(src, [(s, low[a:b].tobytes() + n[a:b].tobytes()) for s, a, b in packed.slices(slots << np.uint64(32), bits)])


def _answer(table: pa.Table) -> pa.Table:
    """Of one slice: each source gets its slots that several texts have, and how many have them."""
    table = table.combine_chunks()
    s, srcs, parts = table.column("slice")[0].as_py(), table.column("src").to_pylist(), [b.as_py() for b in table.column("packed")]
    sizes = [len(b) // 8 for b in parts]
    slots, entry = np.unique(np.concatenate([np.frombuffer(b, "<u4", n) for b, n in zip(parts, sizes)]), return_inverse=True)
    total = np.bincount(entry, np.concatenate([np.frombuffer(b, "<u4", n, 4 * n) for b, n in zip(parts, sizes)]), len(slots))
    total = np.minimum(total, 0xFFFFFFFF).astype("<u4")
    rows, at = [], 0
    for src, n in zip(srcs, sizes):
        mine = entry[at : at + n]
        mine = mine[total[mine] > 1]
        at += n
        if len(mine):
            rows.append((src, slots[mine].astype("<u4").tobytes() + total[mine].tobytes()))
    return packed.answers(s, rows)


def _counts(folder: str, src: int) -> tuple[np.ndarray, np.ndarray]:
    """A source's slots that several texts have, in order, and their numbers."""
    parts = [np.frombuffer(b, "<u4").reshape(2, -1) for b in packed.read_answers(folder, src).values()]
    both = np.concatenate([np.zeros((2, 0), np.uint32), *parts], axis=1)
    return both[0].astype(np.uint64), both[1].astype(np.int64)


def _prefix(hashes: np.ndarray, slots: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the first shingles in the order, those that several texts have: their places and hashes."""
    many = np.ones(len(hashes), np.int64)
    if len(slots) and len(hashes):
        low = _slots(hashes)
        at = np.minimum(np.searchsorted(slots, low), len(slots) - 1)
        many = np.where(slots[at] == low, numbers[at], 1)
    first = np.lexsort((hashes, many))[: prefix_size(len(hashes))]
    places = np.flatnonzero(many[first] > 1)
    return places.astype(np.int32), hashes[first[places]].view(np.int64)


def _marks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored sources of docs (id, text), and a row for each of their texts: id, x (hash of the text as it
    is), src and at (where it lies), c (its class), fp (its fingerprint), n (its number of shingles), bits (its sketch), and the
    places and tokens of its prefix that other texts have too."""
    sources = substring.to_sources(docs.select("id", F.xxhash64("text").alias("x"), "text"), "text")
    n_bytes = sources.agg(F.sum("n_bytes")).first()[0] or 0
    bits, rows = packed.slice_bits(n_bytes // 6, SLICE_SHINGLES), sources.select("src", "docs")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for src, texts in _texts(batches):
            yield _ask(src, [shingle_hashes(words_of(t.as_py())) for t in texts.field(2)], bits)

    counts = packed.exchange(rows.mapInArrow(released(ask), packed.PACKED), _answer, "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for src, texts in _texts(batches):
            slots, numbers = _counts(counts, src)
            classes, sizes, sketches, places, tokens, prints = [], [], [], [], [], {}
            for text in texts.field(2):
                text = text.as_py()
                words = words_of(text)
                hashes = shingle_hashes(words)
                where, found = _prefix(hashes, slots, numbers)
                classes.append(text_class(words))
                if classes[-1] not in prints:  # copies have the same
                    prints[classes[-1]] = simhash.simhash64(text)
                sizes.append(len(hashes))
                sketches.append(sketch(hashes))
                places.append(where)
                tokens.append(found)
            n = len(texts)
            columns = [texts.field(0), texts.field(1), pa.array(np.full(n, src)), pa.array(np.arange(n, dtype=np.int32)), pa.array(classes, pa.int64())]
            columns += [pa.array(np.array([prints[c] for c in classes], np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(sketches, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "x", "src", "at", "c", "fp", "n", "bits", "places", "tokens"])

    return rows, stored(rows.mapInArrow(released(run), MARKS), "marks")


def _alike(pairs: DataFrame, sources: DataFrame, classes: DataFrame, most: int | None = None) -> DataFrame:
    """The pairs (u, v) of classes whose shingle sets have the similarity, by the sets themselves. Each class
    has its set from one of its texts, where that lies. most: a bound of the number of pairs, where known."""
    pairs = stored(pairs, "pairs") if most is None else stored_in_few(pairs, "pairs", most)
    number = pairs.count()
    needed = pairs.select(F.col("u").alias("c")).union(pairs.select(F.col("v").alias("c"))).distinct()
    needed = needed.join(classes.select("c", "where.*"), "c").groupBy("src").agg(F.collect_list("at").alias("at"), F.collect_list("c").alias("c"))
    wanted = packed.by_source(needed, "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for row in packed.of_source(wanted, batch.column(0)[k].as_py(), ["at", "c"]).to_pylist():
                    texts = batch.column(1)[k].values.field(2)
                    for a in range(0, len(row["at"]), 1000):
                        sets = [shingle_hashes(words_of(texts[i].as_py())).view(np.int64) for i in row["at"][a : a + 1000]]
                        yield pa.RecordBatch.from_arrays([pa.array(row["c"][a : a + 1000], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["c", "s"])

    sets = stored(sources.mapInArrow(released(run), "c long, s array<long>"), "sets")
    both = pairs.join(sets.select(F.col("c").alias("u"), F.col("s").alias("su")), "u").join(sets.select(F.col("c").alias("v"), F.col("s").alias("sv")), "v")
    shared = both.select("u", "v", F.size(F.array_intersect("su", "sv")).alias("k"), (F.size("su") + F.size("sv")).alias("n"))
    found = stored_in_few(shared.filter(f"{LEAST[1]} * k >= {LEAST[0]} * (n - k)").select("u", "v"), "alike", number)
    discard(sets)
    return found


def _differ(a: str, b: str) -> str:
    """In how many bits the sketches differ, in SQL."""
    return " + ".join(f"bit_count({a}bits.b{k} ^ {b}bits.b{k})" for k in range(SKETCH_LONGS))


def _may(a: str, b: str) -> str:
    """Whether texts a and b (n, at, bits) that share the shingles at these places may be alike, in SQL.

    At the first they share, no more can be shared than what follows in either; sizes may not differ too
    much; and as alike ones differ in a ninth of their shingles at most, so do their sketches."""
    rest = f"{LEAST[0] + LEAST[1]} * least({a}n - {a}at, {b}n - {b}at) >= {LEAST[0]} * ({a}n + {b}n)"
    sizes = f"{LEAST[1]} * least({a}n, {b}n) >= {LEAST[0]} * greatest({a}n, {b}n)"
    return f"{sizes} and {rest} and {LEAST[0] + LEAST[1]} * ({_differ(a, b)}) <= {LEAST[1] - LEAST[0]} * ({a}n + {b}n)"


def _open(met: DataFrame, parts: DataFrame, most: int | None = None) -> DataFrame:
    """Rows of met (token, c, n, at, bits) with part, the component of c so far, where a token still has
    classes of different components. Stored; most: a bound of its rows, where known."""
    own = parts.select(F.col("node").alias("c"), F.col("component").alias("part"))
    rows = met.drop("part").join(own, "c", "left").withColumn("part", F.coalesce("part", "c"))
    mixed = rows.groupBy("token").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q").select("token")
    return stored(rows.join(mixed, "token"), "open") if most is None else stored_in_few(rows.join(mixed, "token"), "open", most)


def _chosen(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs (u, v), one for each class at most. Each token shows one class, another one in each turn; of
    those that its tokens show in other components, a class is paired with the one of the nearest sketch."""
    heads = rows.groupBy("token").agg(F.min_by(F.struct("c", "n", "at", "bits", "part"), F.xxhash64("token", "c", F.lit(turn))).alias("h"))
    other = rows.join(heads, "token").filter(f"h.part <> part and {_may('', 'h.')}")
    nearest = other.groupBy("c").agg(F.min(F.struct(F.expr(_differ("", "h.")).alias("d"), F.col("h.c").alias("c"))).alias("h"))
    return nearest.select(F.least("c", "h.c").alias("u"), F.greatest("c", "h.c").alias("v")).distinct()


def _groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of docs (id, text): (id, x, c) of each row, and (c, component, least: the class's least id and x).

    Texts of the same words form one class first, so copies cost a row. Fingerprints then link classes, and only
    what they leave apart is compared by shingles. In each round of that a class is compared with one other at most that it may be alike to and that isn't in its component yet. So a group of many
    near copies is linked by a few times as many comparisons as it has members. What shares a shingle and
    lies in different components then is compared by pairs, so no link between components is lost."""
    sources, marks = _marks(docs)
    first = F.min_by(F.struct("fp", "n", "bits", "places", "tokens"), F.struct("src", "at")).alias("first")
    classes = marks.groupBy("c").agg(F.min(F.struct("id", "x")).alias("least"), F.min(F.struct("src", "at")).alias("where"), first)
    classes = stored(classes.select("c", "least", "where", "first.*"), "classes")
    # Texts without shingles have the same words, none, and are one class.
    bits = F.struct(*[F.col("bits")[k].alias(f"b{k}") for k in range(SKETCH_LONGS)]).alias("bits")
    tokens = classes.select("c", "n", bits, F.explode(F.arrays_zip("places", "tokens")).alias("t"))
    tokens = tokens.select("c", "n", "bits", F.col("t.places").alias("at"), F.col("t.tokens").alias("token"))
    links = stored(simhash.class_links(classes.select("c", "fp")), "near")
    met = _open(tokens, connected_components(links, links.count()))
    for turn in range(ROUNDS):
        rows = met.count()
        found = _alike(_chosen(met, turn), sources, classes, rows)
        links = links.union(found)
        parts, before = connected_components(links, links.count()), met
        met = _open(met, parts, rows)
        discard(before)
    a, b = met.alias("a"), met.alias("b")
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & F.expr(f"a.c < b.c and a.part <> b.part and {_may('a.', 'b.')}"))
    more = _alike(pairs.select(F.col("a.c").alias("u"), F.col("b.c").alias("v")).distinct(), sources, classes)
    links = links.union(more)
    linked = connected_components(links, links.count())
    discard(met)
    named = classes.select("c", "least").join(linked.select(F.col("node").alias("c"), "component"), "c", "left")
    named = stored(named.select("c", "least", F.coalesce("component", "c").alias("component")), "named")
    discard(sources)
    return marks.select("id", "x", "c"), named


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, component_id), a row for each row with an id: the least id reachable over fingerprints of two
    or fewer differing bits and texts of similarity 0.8 or more. Texts without words (null, empty) are alike. Repeated ids keep their rows, each in the
    component of its own text."""
    marks, named = _groups(_rows(docs, id_col, text_col))
    ids = named.groupBy("component").agg(F.min("least.id").alias("component_id"))
    return marks.select("id", "c").join(named.join(ids, "component").select("c", "component_id"), "c").select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of near-duplicates: of the smallest id, and of its texts in the
    component the one of least hash. Different texts of one id are rows of their own. Rows with a null id
    stay, one of each different text."""
    _, named = _groups(_rows(docs, id_col, text_col))
    chosen = named.groupBy("component").agg(F.min("least").alias("least")).select("least.*")
    kept = rows_of(docs.filter(F.col(id_col).isNotNull()), stored(chosen, "chosen"), id_col, text_col)
    return kept.unionByName(docs.filter(F.col(id_col).isNull()).dropDuplicates([text_col]))

"""Toxicity by a weighted finite-state pattern grammar over clauses.

Small transducers read a clause word by word: for negation, for reported speech, for a target (a person
spoken to or about), for an insult and for a threat. They are composed into one machine. Its state says
under which of the others an insult or a threat has come, and how far the nearest target lies before it;
an insult or a threat whose target comes behind it is held open for some words and is settled by the
target or by the clause's end. A threat without a target is no match. What is settled adds its arc's weight
to its reading of the clause, and a logistic model of the matched clauses' sums scores the document. A
short list of insults is built in; more, also beginnings of words, and the model's weights are learned from
labelled rows: the learned entries are insult arcs like the built-in ones, with weights of their own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hammerline.llm.common import released, stored

#: Built-in words (fixed values), English, German, French and Spanish.
INSULTS = set(
    "idiot moron stupid scum trash loser worthless pathetic disgusting clown imbecile dumb fool filth vermin idiotisch dumm abschaum trottel "
    "versager widerlich idiote stupide ordure minable connard crétin imbécile idiota estúpido basura escoria asqueroso patético tonto inútil".split()
)
THREATS = set("kill hurt destroy beat strangle stab shoot töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir".split())
TARGETS = set("you your yours he she they them him her these those du dich ihr euch sie ihn tu toi vous ils elles lui tú usted ustedes ellos ellas él ella".split())
NEGATIONS = set("not no never nobody isn aren don doesn nicht kein keine keinen nie niemals pas jamais aucun non nunca jamás ningún tampoco".split())
REPORTS = set("said says say wrote writes claimed claims quoted called sagte sagt schrieb behauptete dit disait écrit déclaré dijo dice escribió afirmó".split())

_TOKENS = re.compile(r"[^\W\d_]+|[.!?;\n]|[\"«»“”„]")
_ENDS, _QUOTES = set(".!?;\n"), set('"«»“”„')
INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER = "insult threat target negation report quote other".split()


class Transducer:
    """States 0 to n; an arc for some symbols, and for all others the step `rest` of the state."""

    def __init__(self, arcs: dict[tuple[int, str], int], rest: dict[int, int]):
        self.arcs, self.rest = arcs, rest

    def step(self, state: int, symbol: str) -> int:
        return self.arcs.get((state, symbol), self.rest.get(state, state))


def _after(symbol: str, reach: int) -> Transducer:
    """Active (state above 0) for `reach` words behind the symbol."""
    return Transducer({(s, symbol): reach for s in range(reach + 1)}, {s: s - 1 for s in range(1, reach + 1)})


def _reported() -> Transducer:
    """Active from a verb of saying to the clause's end, and between quotation marks."""
    arcs = {(0, REPORT): 1, (0, QUOTE): 2, (1, QUOTE): 2, (2, QUOTE): 0}
    return Transducer(arcs, {})


#: How many words a negation reaches, and a target to what stands behind it and before it.
NEGATION_REACH, TARGET_REACH, TARGET_BEHIND = 5, 5, 4


def _pending(symbol: str) -> Transducer:
    """Open (state above 0) for some words behind an insult or a threat, until a target settles it."""
    arcs = {(s, symbol): TARGET_BEHIND for s in range(TARGET_BEHIND + 1)} | {(s, TARGET): 0 for s in range(TARGET_BEHIND + 1)}
    return Transducer(arcs, {s: s - 1 for s in range(1, TARGET_BEHIND + 1)})


class Grammar:
    """The composed machine: a state of each transducer; arcs of the composition are made when first used."""

    def __init__(self, *parts: Transducer):
        self.parts, self.arcs = parts, {}

    def step(self, state: tuple[int, ...], symbol: str) -> tuple[int, ...]:
        found = self.arcs.get((state, symbol))
        if found is None:
            found = self.arcs[state, symbol] = tuple(p.step(s, symbol) for p, s in zip(self.parts, state))
        return found


GRAMMAR = Grammar(_after(NEGATION, NEGATION_REACH), _reported(), _after(TARGET, TARGET_REACH), _pending(INSULT), _pending(THREAT))
START = (0, 0, 0, 0, 0)


def reading(symbol: str, state: tuple[int, ...], target: bool) -> str:
    """Of an insult or a threat that comes in that state, with a target before or behind it or without."""
    negated, reported = state[:2]
    if symbol == THREAT:
        return "threat_at_target" if target and not negated and not reported else "threat"
    return "reported" if reported else "negated" if negated else "at_target" if target else "plain"


FEATURES = ["plain", "at_target", "negated", "reported", "threat", "threat_at_target", "matched_clauses", "hits"]


class _Lexicon(dict):
    """Word to (symbol, weight). Unknown words are resolved by the learned whole words and beginnings."""

    def __init__(self, learned: dict[str, float]):
        self.learned = learned
        self.lengths = sorted({len(k) for k in learned if not k.endswith("$")}, reverse=True)

    def __missing__(self, word: str) -> tuple[str, float]:
        weight = max([self.learned.get(word + "$", 0.0), *(self.learned.get(word[:n], 0.0) for n in self.lengths if n <= len(word))])
        if word in INSULTS:
            found = (INSULT, max(weight, 3.0))
        elif word in THREATS:
            found = (THREAT, max(weight, 1.0))
        elif weight:
            found = (INSULT, weight)
        else:
            lists = ((NEGATION, NEGATIONS), (REPORT, REPORTS), (TARGET, TARGETS))
            found = (next((s for s, words in lists if word in words), OTHER), 0.0)
        if len(self) >= 300_000:
            self.clear()
        self[word] = found
        return found


def clause_features(text: str | None, lexicon: _Lexicon) -> list[float]:
    """The features of a whole text; all 0 if no clause matches."""
    tokens = _TOKENS.findall((text or "").lower())
    sums, clauses, matched, hits = Counter(), 1, 0, 0
    read = [lexicon[t] for t in tokens]
    if any(weight for _, weight in read):
        state, words, clauses, here = START, 0, 0, False
        pending: dict[str, list[tuple[int, tuple[int, ...], float]]] = {INSULT: [], THREAT: []}

        def settle(symbol: str, target: bool) -> bool:
            """Adds what is held open to its readings, the target counting within its reach; whether a clause
            matches by it."""
            found = False
            for at, then, weight in pending[symbol]:
                sums[name := reading(symbol, then, then[2] > 0 or (target and words - at <= TARGET_BEHIND))] += weight
                found |= name != "threat"
            pending[symbol] = []
            return found

        for token, (symbol, weight) in zip([*tokens, "."], [*read, (OTHER, 0.0)]):
            if token in _ENDS:
                here |= settle(INSULT, False) | settle(THREAT, False)
                clauses, matched, here = clauses + (words > 0), matched + here, False
                state, words = (0, 2 if state[1] == 2 else 0, 0, 0, 0), 0
                continue
            words += 1
            after = GRAMMAR.step(state, QUOTE if token in _QUOTES else symbol)
            for k, kind in ((3, INSULT), (4, THREAT)):
                if pending[kind] and (symbol == TARGET or not after[k]):
                    here |= settle(kind, symbol == TARGET)
            if weight:
                hits += symbol != THREAT
                pending[symbol].append((words, state, weight))
            state = after
        clauses = max(1, clauses)
    n = max(1, len(tokens))
    return [*(float(np.log1p(100 * sums[f] / n)) for f in FEATURES[:6]), matched / clauses, float(np.log1p(hits))]


def held_out(id_col: str):
    """Rows that labels are never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def learn_lexicon(sample: DataFrame, size: int = 4000) -> dict[str, float]:
    """Words (with $) and beginnings of 4 to 8 letters that stand out in toxic texts, with their log odds: the
    `size` that stand out most, which bounds what is broadcast as `most` bounds what is learned from.

    Occurrences are counted up to three a document, and only what several documents show counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean, found = Counter(), Counter(), Counter()
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                here: Counter[str] = Counter()
                for word, times in Counter(w for w in _TOKENS.findall((text.as_py() or "").lower()) if len(w) > 2).items():
                    for key in (word + "$", *(word[:n] for n in range(4, min(8, len(word)) + 1))):
                        here[key] += times
                here[""] = 0
                for key, times in here.items():
                    (toxic if label else clean)[key] += min(times, 3)
                    found[key] += bool(label)
                (toxic if label else clean)[""] += sum(min(t, 3) for t in here.values())
        keys = list(toxic | clean)
        columns = [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (toxic, clean, found))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "toxic", "clean", "found"])

    counts = sample.select("toxic", "text").mapInArrow(run, "key string, toxic long, clean long, found long")
    counts = stored(counts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "found")]), "words")
    total = counts.filter("key = ''").first()
    if not total or not total.toxic or not total.clean:
        return {}
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / total.toxic) - F.log(b / total.clean)
    rows = counts.filter("key <> '' and found >= 5").withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / a + 1 / b))
    rows = rows.filter("odds > 1.4 and z > 5").orderBy(F.desc("z"), "key").limit(size)
    return {r.key: float(min(r.odds, 5.0)) for r in rows.collect()}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the constant of a logistic model, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Weights where there are no labels to learn from: insults count, negated and reported ones less.
DEFAULT_WEIGHTS = np.array([1.5, 2.0, 0.5, 0.5, 0.3, 2.0, 2.0, 0.5, -3.0])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 20_000) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and weights from at most `most` labelled rows (those of the least hashes of their id), never
    from held-out ones. Labels with null ids or values are ignored; a repeated id counts once, as toxic if
    any of its labels is; equal texts count once."""
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic is not null")
    known = known.filter(~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = texts.join(F.broadcast(known), "id").groupBy(F.xxhash64("text").alias("h")).agg(F.max_by("toxic", "id").alias("toxic"), F.max_by("text", "id").alias("text"))
    sample = stored(sample.select("toxic", "text"), "labelled")
    learned = learn_lexicon(sample)
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _Lexicon(shared.value)
        for batch in batches:
            rows = [clause_features(t.as_py(), lexicon) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])

    rows = sample.mapInArrow(run, "toxic int, x array<double>").collect()  # `most` short rows at most
    y = np.array([float(r.toxic > 0) for r in rows])
    if not 0 < y.sum() < len(y):
        return learned, DEFAULT_WEIGHTS
    return learned, fit_logistic(np.array([r.x for r in rows]), y)


def score(
    docs: DataFrame, learned: dict[str, float], weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a document: id_col, held_out, score (0 to 1), predicted (1 from 0.5 on). A null or empty
    text scores as one in which no clause matches. Only the text enters a score. Repeated rows and ids keep
    their rows, equal texts score equal, null ids are not held out, an empty table gives none. Very long texts
    are read whole, in one pass. Columns but these two don't matter, whatever they are called."""
    shared = docs.sparkSession.sparkContext.broadcast((learned, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, weights = shared.value
        lexicon = _Lexicon(learned)
        for batch in batches:
            x = np.array([clause_features(t.as_py(), lexicon) for t in batch.column(2)]).reshape(-1, len(FEATURES))
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    rows = docs.select(id_col, held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(released(run), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, held_out boolean, score double, predicted int")

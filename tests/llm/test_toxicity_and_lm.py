import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from hammerline.llm import bpe, lmscore, toxicity


def features(text, learned=None):
    return dict(zip(toxicity.FEATURES, toxicity.clause_features(text, toxicity._Lexicon(learned or {}))))


def test_grammar_reads_clauses():
    plain, negated = features("What an idiot. So it goes."), features("This is not an idiot. So it goes.")
    assert plain["plain"] > 0 and plain["negated"] == 0
    assert negated["negated"] > 0 and negated["plain"] == 0
    assert features("you are an idiot")["at_target"] > 0
    said = features('he said that the man is a moron. The clown ran')
    assert said["reported"] > 0 and said["plain"] > 0  # the report ends with its clause
    assert features('a "stupid trash" word')["plain"] == 0
    assert features("I will kill you.")["threat_at_target"] > 0 and features("you I will kill")["threat_at_target"] > 0
    assert features("I will kill. You know")["threat_at_target"] == 0 and features("I will not kill you")["threat_at_target"] == 0
    assert features("idiot, you")["at_target"] > 0 and features("you are not really such a complete idiot")["negated"] > 0
    assert features("the sun kill switch")["threat"] > 0
    assert set(features("").values()) == set(features(None).values()) == {0.0}
    assert features("zorgling here", {"zorg": 2.0})["plain"] > 0 and features("zorg here", {"zorg$": 2.0})["plain"] > 0


def plain_features(text, weights):
    """The readings of a text by looking around each word, for words of one kind each."""
    sums, quoted = Counter(), False
    for clause in re.split("[.!?;]", text):
        words, marks, report, at = [], [], False, []
        for w in clause.split():
            if w == '"':
                quoted, report = not quoted, False
            at.append(quoted or report)
            report |= w == "said" and not quoted
            words.append(w)
        kind = lambda i, k: 0 <= i < len(words) and weights.get(words[i], (None,))[0] == k  # noqa: B023, E731
        for i, w in enumerate(words):
            symbol, weight = weights.get(w, (None, 0))
            if symbol in ("insult", "threat"):
                target = any(kind(i - d, "target") for d in range(1, 6)) or any(kind(i + d, "target") for d in range(1, 5))
                negated, reported = any(kind(i - d, "negation") for d in range(1, 6)), at[i]
                if symbol == "threat":
                    sums["threat_at_target" if target and not negated and not reported else "threat"] += weight
                else:
                    sums["reported" if reported else "negated" if negated else "at_target" if target else "plain"] += weight
    n = max(1, len(re.findall(r'[a-z]+|[.!?;"]', text)))
    return [float(np.log1p(100 * sums[f] / n)) for f in toxicity.FEATURES[:6]]


def test_grammar_equals_a_plain_reading():
    rng = random.Random(12)
    weights = {"idiot": ("insult", 3.0), "kill": ("threat", 1.0), "you": ("target", 0), "not": ("negation", 0)}
    for _ in range(3000):
        text = " ".join(rng.choice(["idiot", "kill", "you", "not", "said", "a", "house", "runs", ".", '"']) for _ in range(rng.randint(0, 30)))
        assert np.allclose(toxicity.clause_features(text, toxicity._Lexicon({}))[:6], plain_features(text, weights)), text


def test_empty_tables(spark):
    docs, labels = table(spark, random.Random(1), 5)
    assert toxicity.score(docs.limit(0), *toxicity.learn(docs.limit(0), labels)).count() == 0


def table(spark, rng, n=600):
    words = ["".join(rng.choice("aeioubdlmnrst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.3
        for _ in range(max(1, len(text) // 10) if toxic else 0):
            text[rng.randrange(len(text))] = "gronk" + rng.choice(["el", "ata", "us", "imo"])
        docs.append((k, " ".join(text), "de", "p"))
        labels.append((k, 1, int(toxic)))
    docs += [(None, "a b", "x", "p"), (3, None, "x", "p"), (4, "", "x", "p"), (5, "word " * 50_000, "x", "p")]
    labels += [(None, 1, 1), (3, None, None), (9999, 0, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_words_and_scores_held_out_rows(spark):
    docs, labels = table(spark, random.Random(8))
    learned, weights = toxicity.learn(docs, labels)
    assert any(k.startswith("gron") for k in learned)
    found = toxicity.score(docs, learned, weights)
    rows = found.join(labels.dropDuplicates(["doc_id"]), "doc_id").filter("toxic is not null").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 80 and np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in held]) > 0.97
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert found.count() == docs.count() and found.filter("score is null or held_out is null").count() == 0


def test_held_out_rows_teach_nothing(spark):
    docs, labels = table(spark, random.Random(9), 200)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.learn(docs, labels), toxicity.learn(docs, flipped)
    assert a[0] == b[0] and np.allclose(a[1], b[1])


def test_without_labels_the_built_in_words_count(spark):
    docs = spark.createDataFrame([(1, "you are a stupid pathetic moron"), (2, "a fine day"), (3, None)], "doc_id long, text string")
    _, labels = table(spark, random.Random(1), 5)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, *toxicity.learn(docs, labels.limit(0))).collect()}
    assert scores[1] > 0.5 > scores[2] == scores[3]


def direct_scores(texts, chosen):
    """(score of each text) from plain counts, a document's own taken off."""
    library, size = bpe.load(bpe.default_vocabulary()), bpe.vocabulary_size(bpe.default_vocabulary())
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]

    def counted(x):
        return Counter(x), Counter([None, *x[:-1]] if x else []), Counter(zip([None, *x], x))

    models, out = [[Counter(), Counter(), Counter()] for _ in range(2)], []
    for x, target in zip(ids, chosen):
        for which in [0, 1] if target else [0]:
            for total, part in zip(models[which], counted(x)):
                total.update(part)
    for x, target in zip(ids, chosen):
        own, means = counted(x), []
        for which, off in ((0, 1), (1, target)):
            one, before, two = models[which]
            n, losses = sum(one.values()) - off * len(x), []
            for a, b in zip([None, *x], x):
                single = (one[b] - off * own[0][b] + 1) / (n + size)
                losses.append(-math.log((two[a, b] - off * own[2][a, b] + 50 * single) / (before[a] - off * own[1][a] + 50)))
            means.append(sum(losses) / len(losses) if losses else 0.0)
        out.append(means[0] - means[1])
    return out


def test_lm_scores_match_a_direct_count(spark, monkeypatch):
    rng = random.Random(2)
    words = ["the", "cat", "sat", "on", "mats", "Über", "x!", "<|endoftext|>", *("".join(rng.choice("abcdeilmnorst") for _ in range(6)) for _ in range(150))]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), "n") for k in range(60)]
    rows += [(7, None, "n"), (None, "the cat", "n"), (61, "", "n"), (62, "the cat sat " * 20_000, "n"), (8, "on mats", "n"), (8, "on mats", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    chosen = {k for k in range(0, 60, 4)}
    targets = spark.createDataFrame([(k,) for k in [*chosen, None, 999]], "k long")
    want = direct_scores([t for _, t, _ in rows], [k in chosen for k, *_ in rows])
    want = sorted(((k, round(s, 6) + 0.0) for (k, *_), s in zip(rows, want)), key=str)
    for ids, each in ((10**6, 10**6), (200, 50)):  # one source and many
        monkeypatch.setattr(lmscore, "SOURCE_IDS", ids)
        monkeypatch.setattr(lmscore, "SLICE_PAIRS", each)
        assert sorted(((r.doc_id, round(r.score, 6) + 0.0) for r in lmscore.score(docs, targets).collect()), key=str) == want
    assert lmscore.score(docs.limit(0), targets).count() == 0
    uniform = lmscore.score(docs, targets.limit(0)).filter("n_tokens > 0").agg(F.min("target_loss"), F.max("target_loss")).first()
    assert abs(uniform[0] - math.log(bpe.vocabulary_size(bpe.default_vocabulary()))) < 1e-9 and abs(uniform[0] - uniform[1]) < 1e-9

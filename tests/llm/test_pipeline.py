import random
import zlib

import numpy as np

import corpus_pipeline
from hammerline.llm import bpe
from tests.llm import brute


def write(spark, folder, rows, items):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def corpus():
    rng = random.Random(11)
    words = "the of and to a in is that it for was on with as by be at from this house river stone light water walk talk open close green quiet".split()
    prose = lambda n: " ".join(rng.choice(words[:17]) if rng.random() < 0.45 else rng.choice(words[17:]) + rng.choice("abcdefgh") + rng.choice("mnop") for _ in range(n))
    items = [(k, prose(25)) for k in range(3)]
    passage = prose(70)
    texts = [prose(rng.randint(60, 300)) for _ in range(40)]
    texts[5:8] = [texts[4]] * 3
    texts[9] = texts[8] + " end"
    for k in (12, 15, 20):
        texts[k] = texts[k][:200] + " " + passage + " " + prose(80)
    texts[22] += "\n" + items[1][1] + "\n" + prose(60)
    texts += ["short one", "%%% ### " * 60, None, "", items[2][1], prose(9000)]
    return [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], items


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, items = corpus()
    write(spark, tmp_path, rows, items)
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    docs = {k: t for k, t, *_ in rows}
    docs = brute.quality(docs)
    assert set(range(40)) - {5, 6, 7} <= set(docs) | {5, 6, 7} and not {40, 41, 42, 43} & set(docs)
    docs = brute.decontaminate(brute.substring(brute.near_dedup(docs)), items)
    assert not {5, 6, 7, 44} & set(docs)
    library = bpe.load(bpe.default_vocabulary())
    want = {k: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for k, t in docs.items()}
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        part = want[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert len(part) == 4 * r.length and zlib.crc32(part) == r.ids_crc32
    assert sum(r.length for r in got) == sum(map(len, want.values())) // 4
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1]) and sum(n for _, n in parts) <= 2048


def test_stages_keep_the_columns_and_clean_documents(spark, tmp_path):
    rows, items = corpus()
    write(spark, tmp_path, rows, items)
    clean = [r for r in rows if r[0] in range(24, 40)]
    docs = spark.createDataFrame(clean, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, f"file://{tmp_path}")
        assert made.columns == docs.columns
        assert sorted(map(tuple, made.collect())) == clean


def test_extra_columns_of_any_name_and_repeated_ids_pass_through(spark, tmp_path):
    rows, items = corpus()
    write(spark, tmp_path, rows, items)
    extra = "repeats string, quality string, contamination string"
    two = [(*r, "a", "b", "c") for r in rows if r[0] in range(24, 30)]
    two.append((24, *two[-1][1:]))  # one id with two texts, of which one is a copy
    two.append((25, rows[30][1], *two[0][2:]))  # and one with two texts of its own
    docs = spark.createDataFrame(two, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"file://{tmp_path}")
        assert docs.columns[5:] == ["repeats", "quality", "contamination"]
    got = sorted((r.doc_id, r.text, r.repeats, r.quality, r.contamination) for r in docs.collect())
    assert got == sorted((k, t, "a", "b", "c") for k, t, *_ in [*two[:5], two[-2], two[-1]])


def test_stages_take_an_empty_table(spark, tmp_path):
    rows, items = corpus()
    write(spark, tmp_path, rows, items)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, f"file://{tmp_path}").count() == 0

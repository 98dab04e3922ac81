"""What a review found missing: short outliers, notices between windows, null and repeated ids."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from varloom.llm import bytescan, decontaminate, licenses, packing, quality_rules, token_store, wordtokens

WORDS = "the of and to in is was for over under lazy quick brown fox dog jumps house river stone cloud".split()


def lines_of(seed, n):
    """Text of n words, ten a line, that hardly repeats three words."""
    rng = np.random.default_rng(seed)
    words = [str(w) + ("" if k % 7 else ",") + str(rng.integers(10)) * (k % 5 == 0) for k, w in enumerate(rng.choice(WORDS, n))]
    return "\n".join(" ".join(words[k : k + 10]) for k in range(0, n, 10))


def junk_of(seed, n):
    """The same with a symbol after every second word."""
    return " ".join(w + "#$" * (k % 2) for k, w in enumerate(lines_of(seed, n).split(" ")))


def test_short_outliers_are_rejected(spark):
    clean = [(i, lines_of(i, 60 + 5 * (i % 80)), "en", "s") for i in range(240)]
    short = [(1000 + i, junk_of(1000 + i, 60 + 10 * i), "en", "s") for i in range(12)]
    docs = spark.createDataFrame(clean + short, "doc_id long, text string, lang string, source string")
    rows = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert not any(r.base_failed for r in rows.values())
    assert [i for i, *_ in short if rows[i].kept] == []
    assert [i for i, *_ in clean if not rows[i].kept] == []


def test_text_distance_by_hand():
    n = quality_rules.DIMENSIONS
    least = np.array([x for _, x in quality_rules.FEATURES.values()])
    cov, apart = np.diag(least**2) * 2, np.full(n, 0.3)
    noise = np.array([0, 0, 0, 0, 0.25 / 3, 0])
    want = sum(0.09 / (2 * s**2 + max(0.0, v - s**2)) for s, v in zip(least, noise, strict=True))
    got = quality_rules.text_distance(apart[None], np.zeros((1, n)), np.linalg.inv(cov)[None], noise[None])
    assert got[0] == pytest.approx(want)


def test_notices_that_share_no_band_are_found(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BANDS", 1)  # misses by chance are common then
    rng, rows = np.random.default_rng(5), []
    for i in range(60):
        ahead, behind = (" ".join(f"{w}{rng.integers(1000)}" for w in rng.choice(WORDS, n)) for n in (20 + i % 4, 30))
        rows.append((i, f"{ahead} Released under the MIT License {behind}"))
    rows += [(100, "Licensed under nobody, then under CC of CC by many, by NC and NC 4 or 4 0"), (101, "released under, under the, the mit and mit license")]
    known = licenses.templates(spark)
    got = {(r.doc_id, r.license, round(r.containment, 6)) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}

    def pairs(text):
        w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
        return set(zip(w, w[1:], strict=False))

    want = set()
    for i, text in rows:
        for name, template in licenses.TEMPLATES.items():
            share = len(pairs(text) & pairs(template)) / len(pairs(template))
            if share >= 0.8:
                want.add((i, name, round(share, 6)))
    assert len(want) >= 62 and got == want


@pytest.fixture(scope="module")
def loose(spark):
    """Documents with null and repeated ids; each text names itself by its last word."""
    texts = [lines_of(500 + i, 120) for i in range(90)]
    rows = [(i, t) for i, t in enumerate(texts[:60])] + [(None, t) for t in texts[60:75]] + [(7, t) for t in texts[75:]]
    rows += [(None, texts[3]), (5, texts[5]), (None, texts[61]), (7, junk_of(9, 120)), (None, junk_of(10, 120)), (None, "too short")]
    rows = [(i, t, "en", "s", len(t)) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), texts


def test_quality_stage_judges_rows(spark, loose):
    docs, texts = loose
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in corpus_pipeline.quality_stage(spark, docs, "").collect())
    assert got == sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in docs.collect() if r.text in texts)


def test_near_copies_stage_keeps_one_row_of_each(spark, loose):
    docs, texts = loose
    found = corpus_pipeline.near_copies_stage(spark, docs.where(F.col("text").isin(texts)), "")
    assert found.columns == docs.columns
    ids = [*range(60), *[None] * 15, *[7] * 15]
    assert sorted((t.text, str(t.doc_id)) for t in found.collect()) == sorted(zip(texts, map(str, ids), strict=True))


def test_later_stages_and_store_keep_all_rows(spark, loose, tmp_path):
    docs, path = loose[0], wordtokens.default_path()
    n = docs.count()
    assert corpus_pipeline.repeats_stage(spark, docs, "").count() == n
    assert corpus_pipeline.benchmark_stage(spark, docs, "/root/testdata/sf0.001").count() == n
    packed = packing.pack(docs, path).agg(F.sum((F.col("start") == 0).cast("int")), F.sum("length")).first()
    store = str(tmp_path / "tokens")
    token_store.write_tokens(docs, store, path, block_ids=300)
    index = token_store.read_index(spark, store).orderBy("start").collect()
    ids = [r.doc_id for r in index]
    assert ids == sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is None, i or 0)) and ids[-1] is None
    assert tuple(packed) == (n, sum(r.n_tokens for r in index))
    assert [r.start for r in index] == [sum(r.n_tokens for r in index[:k]) for k in range(n)]
    assert token_store.read_ids(spark, store, spark.createDataFrame([(7,)], "doc_id long")).count() == 17


def test_scanning_holds_little_beside_its_input():
    column = pa.array([lines_of(k, 400) for k in range(2500)])
    assert column.nbytes > 4 << 20
    bytescan._powers.clear()
    tracemalloc.start()
    try:
        quality_rules.text_statistics(column)
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()
    assert sum(x.nbytes for x in bytescan._powers.values()) < 16 << 20


def test_a_tokenizer_goes_when_another_operator_begins():
    path = wordtokens.default_path()
    kept = wordtokens.load(path)
    assert wordtokens.load(path) is kept
    assert list(quality_rules._statistics(iter([]))) == [] and not wordtokens._loaded


def test_phrases_are_searched_and_cut_by_one_worker_a_task(spark):
    words = [f"w{k}" for k in range(30)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "é " + " ".join(words[5:20]) + " ß"), (3, None), (4, "plain text")], "doc_id long, text string")
    items = spark.createDataFrame([("a", " ".join(words[7:18]))], "item_id string, text string")
    cut = decontaminate.remove_phrases(docs, items)
    assert {r.doc_id: r.text for r in cut.collect()} == {1: " ".join(words[:7]) + "  " + " ".join(words[18:]), 2: "é w5 w6  w18 w19 ß", 3: None, 4: "plain text"}
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1

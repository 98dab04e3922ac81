"""The pipeline: stages keep the columns of documents, and each stage equals plain Python on a small table."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from varloom.llm import wordtokens

SF = "/root/testdata/sf0.001"
WORDS = "the of and to in is was for over under lazy quick brown fox dog jumps house river stone cloud".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits string, row string"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(str(w) + str(rng.integers(1000)) * (k % 3 == 0) for k, w in enumerate(rng.choice(WORDS, n)))


@pytest.fixture(scope="module")
def docs(spark):
    """Clean texts, a near copy, passages that recur, passages of the benchmark, nulls, repeated rows and clashing columns."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 80").orderBy("item_id").first().text
    shared, texts = prose(900, 25), [prose(i, 70) for i in range(8)]
    texts += [texts[0] + " end", shared + " " + prose(20, 60), prose(21, 60) + " " + shared, prose(22, 60) + " " + item + " " + prose(23, 30), None, "", "few words"]
    rows = [(i, t, "en", "s", len(t or ""), "h", "r") for i, t in enumerate(texts)] + [(None, texts[3], None, None, None, None, None), (2, texts[2], "en", "s", 1, "h", "r")]
    return spark.createDataFrame(rows, SCHEMA).cache()


def rows_of(df):
    return sorted((str(r.doc_id), r.text or "") for r in df.collect())


def test_near_copies_stage(spark, docs):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())

    order = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in map(words, (r.text for r in order))]
    group = list(range(len(order)))
    for a in range(len(order)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    want = sorted((str(order[g].doc_id), order[g].text or "") for g in set(group))
    got = corpus_pipeline.near_copies_stage(spark, docs, SF)
    assert got.columns == docs.columns and rows_of(got) == want


def test_repeats_stage(spark, docs):
    rows = [((1 << 63) - 1 if r.doc_id is None else r.doc_id, str(r.doc_id), (r.text or "")) for r in docs.collect()]
    first = {}
    for i, _, t in rows:
        for k in range(len(t) - 49):
            first[t[k : k + 50]] = min(first.get(t[k : k + 50], i), i)
    want = []
    for i, name, t in rows:
        cover = [False] * len(t)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                cover[k : k + 50] = [True] * 50
        want.append((name, "".join(c for c, x in zip(t, cover, strict=True) if not x)))
    got = corpus_pipeline.repeats_stage(spark, docs, SF)
    assert got.columns == docs.columns and rows_of(got) == sorted(want) != rows_of(docs)
    assert got.where("n_chars <> length(text)").count() == 0


def test_benchmark_stage(spark, docs):
    word, windows = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall((r.text or "").lower())
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    want = []
    for r in docs.collect():
        found = list(word.finditer((r.text or "").lower()))
        hit = set()
        for n in {len(x) for x in windows}:
            for k in range(len(found) - n + 1):
                if tuple(m.group() for m in found[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        text, kept, at = r.text or "", [], 0
        for k in sorted(hit):
            if k - 1 not in hit:
                kept.append(text[at : found[k].start()])
            at = found[k].end()
        want.append((str(r.doc_id), "".join([*kept, text[at:]])))
    got = corpus_pipeline.benchmark_stage(spark, docs, SF)
    assert got.columns == docs.columns and rows_of(got) == sorted(want) != rows_of(docs)


def test_packing_stage(spark, docs):
    from tokenizers import Tokenizer

    library, known = Tokenizer.from_file(wordtokens.default_path()), docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = corpus_pipeline.packing_stage(spark, known, SF).collect()
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in known.collect()}
    assert {r.doc_id: r.doc_tokens for r in got} == want
    for i, n in want.items():
        pieces = sorted((r.start, r.length) for r in got if r.doc_id == i)
        assert [a for a, _ in pieces] == np.cumsum([0, *(b for _, b in pieces[:-1])]).tolist() and sum(b for _, b in pieces) == n


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    tokens = {r.doc_id: r.doc_tokens for r in rows}
    assert sum(r.length for r in rows) == sum(tokens.values()) > 0
    assert "pipeline" in __spark_entry__.queries()


def test_stages_of_an_empty_table(spark, docs):
    empty = docs.where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0

"""Edge cases of the corpus operators: empty tables, clashing columns, very long texts, naive references."""

import time
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from varloom.llm import components, decontaminate, licenses, near_copies, packing, preferences, quality_model, quality_rules, repeats, token_store, toxicity, wordtokens

SCHEMA = "doc_id long, text string, lang string, source string, row string, hits string, toxicity string, quality string, curve string, id string, words string, label string"
OPERATORS = {
    "repeats": lambda spark, df, path: repeats.remove_repeats(df),
    "phrases": lambda spark, df, path: decontaminate.remove_phrases(df, spark.createDataFrame([("a", "nothing like it")], "item_id string, text string")),
    "toxicity": lambda spark, df, path: toxicity.score(df, toxicity.Lexicon({" bad ": 2.0}), into="score"),
    "near_copies": lambda spark, df, path: near_copies.near_copies(df),
    "rules": lambda spark, df, path: quality_rules.judge(df, carry=True).select("row.*"),
    "model": lambda spark, df, path: quality_model.score(df, quality_model.fit([], []), into="score"),
    "licenses": lambda spark, df, path: licenses.scan(df, licenses.templates(spark)),
    "packing": lambda spark, df, path: packing.pack(df, wordtokens.default_path()),
}
#: Of these, the columns of the given table come back.
CARRY = ("repeats", "phrases", "toxicity", "rules", "model")


@pytest.fixture(scope="module")
def clashing(spark):
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(1, long), (2, None), (3, ""), (3, "x y z"), (None, "x y z"), (4, "bad é ü 漢字 \U0001d41b")]
    return spark.createDataFrame([(i, t, "en", None, *("c" * 8)) for i, t in rows], SCHEMA).cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_long_and_null_texts(spark, clashing, name):
    got = OPERATORS[name](spark, clashing, "")
    rows = got.collect()
    if name in CARRY:
        assert [c for c in got.columns if c != "score"] == clashing.columns and len(rows) == 6
        assert sorted(r.id for r in rows) == ["c"] * 6
    if name == "near_copies":
        assert len(rows) == 6 and {r.doc_id: r.component_id for r in rows if r.doc_id} == {1: 1, 2: 2, 3: 3, 4: 4}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, clashing, name):
    assert OPERATORS[name](spark, clashing.where(F.lit(False)), "").count() == 0


def test_empty_store_and_conversations(spark, clashing, tmp_path):
    token_store.write_tokens(clashing.where(F.lit(False)), str(tmp_path / "t"), wordtokens.default_path())
    assert token_store.read_index(spark, str(tmp_path / "t")).count() == 0
    turns = spark.createDataFrame([], "pair_id long, turn long, role string, text string")
    assert preferences.preferences(turns, turns).count() == 0


def test_chains_have_one_component(spark):
    links = [(i, i + 1) for i in range(0, 400)] + [(1000, 1001), (1001, 1000), (5, 5), (None, 3)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {**dict.fromkeys(range(401), 0), 1000: 1000, 1001: 1000}


def test_buckets_of_several_components(spark, monkeypatch):
    """Many texts that share half of their words, in cells of few members, against all pairs."""
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    rng, common = np.random.default_rng(4), [f"c{k}" for k in range(30)]
    texts = [" ".join([*common, *(f"z{x}" for x in rng.integers(0, 10**6, int(rng.integers(3, 12))))]) for _ in range(60)]
    texts += [texts[int(k)] + f" t{j}" for j, k in enumerate(rng.integers(0, 60, 30))]
    order = rng.permutation(len(texts)).tolist()
    sets = {i: {tuple(w[k : k + 2]) for k in range(len(w) - 1)} for i, w in ((i, t.split()) for i, t in zip(order, texts, strict=True))}
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    found = near_copies.near_copies(spark.createDataFrame(list(zip(order, texts, strict=True)), "doc_id long, text string"), 2)
    assert {r.doc_id: r.component_id for r in found.collect()} == group


def naive_weight(text, terms, exceptions):
    """Every place of every entry: of those that start together the longest counts, unless an exception covers its start."""
    best, free = {}, []
    for term, weight in terms.items():
        for k in range(len(text) - len(term) + 1):
            if text.startswith(term, k) and len(term) > best.get(k, (0, 0))[0]:
                best[k] = (len(term), weight)
    for phrase in exceptions:
        free += [(k, k + len(phrase) - 1) for k in range(len(text)) if text.startswith(phrase, k)]
    left = [w for k, (_, w) in best.items() if not any(a <= k < b for a, b in free)]
    return sum(left), max(left, default=0.0)


def test_weights_equal_a_naive_matcher():
    rng = np.random.default_rng(8)
    for _ in range(60):
        words = ["".join(rng.choice(list("ab"), int(rng.integers(1, 4)))) for _ in range(40)]
        text = " " + " ".join(words) + " "
        terms = {(" " + "".join(rng.choice(list("ab"), int(rng.integers(1, 4)))) + " " * int(rng.integers(2))): float(rng.integers(1, 5)) for _ in range(4)}
        exceptions = [" " + " ".join(rng.choice(words, int(rng.integers(1, 3)))) + " " for _ in range(3)]
        exceptions = [x for x in exceptions if x not in terms]
        assert toxicity.weigh(text, toxicity.Lexicon(terms, exceptions).automaton()) == pytest.approx(naive_weight(text, terms, exceptions))


def test_a_megabyte_of_matches_takes_seconds():
    text = " " + "bad badly " * 100_000
    began = time.time()
    toxicity.weigh(text, toxicity.Lexicon({" bad ": 2.0, " badl": 1.0}, [" badly "]).automaton())
    assert time.time() - began < 20


@pytest.mark.parametrize("word", ["ｂａｄｌｙ", "𝐛𝐚𝐝𝐥𝐲", "ʙᴀᴅʟʏ", "b́ädly", "ba​d­ly", "BADLY", "b4dly", "bаdly"])
def test_folding(word):
    data, bounds = next(iter((d, b) for _, d, b in toxicity.folded_texts(pa.array([f"so {word} done"]))))
    assert data.tobytes().decode() == "so badly done" and bounds.tolist() == [0, 13], unicodedata.normalize("NFKD", word)


def test_network_equals_a_naive_convolution():
    net = quality_model.fit(["a b c d " * 40, "| | # $ " * 40], [1, 0], least_steps=20)
    rng = np.random.default_rng(1)
    chunks = rng.integers(0, 256, (3, quality_model.CHUNK)).astype(np.uint8)
    want = []
    for chunk in chunks:
        places = [np.maximum(net.embedding[chunk[k : k + quality_model.WIDTH]].ravel() @ net.filters + net.bias, 0) for k in range(0, quality_model.CHUNK - quality_model.WIDTH + 1, quality_model.STRIDE)]
        want.append(np.concatenate([np.max(places, 0), np.mean(places, 0)]) @ net.weights + net.offset[0])
    assert net.logits(chunks) == pytest.approx(np.array(want), rel=1e-3, abs=1e-3)


def test_one_large_text_does_not_stop_learning(spark):
    rows = [(i, ("good words in a row " if i % 2 else "| # | $ | % ") * 20, i % 2) for i in range(40)] + [(100 + k, "x" * 300_000, 1) for k in range(3)]
    net = quality_model.learn(spark.createDataFrame(rows, "doc_id long, text string, label int"), bytes_=200_000)
    got = net.probability(pa.array([rows[0][1], rows[1][1]], pa.large_string()))
    assert got[0] < 0.3 < 0.7 < got[1]


def test_groups_have_the_least_determinant_of_their_starts(spark):
    """A third of a group lies far away: its estimate is that of the rest, as plain concentration from many starts finds it."""
    rng, n = np.random.default_rng(11), quality_rules.DIMENSIONS
    x = np.concatenate([rng.normal(0, 1, (400, n)) @ rng.normal(0, 1, (n, n)), rng.normal(9, 0.3, (80, n))])
    points = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"x{i} double" for i in range(n)))
    r = quality_rules.fit_groups(points, core=0.75).first()
    centre, h, best = np.array([r[f"c{i}"] for i in range(n)]), int(0.75 * len(x)), (np.inf, None)
    for seed in range(40):
        at = np.random.default_rng(seed).choice(len(x), n + 2, replace=False)
        for _ in range(60):
            mean, cov = x[at].mean(0), np.cov(x[at].T, bias=True) + 1e-6 * np.eye(n)
            at = np.argsort((((x - mean) @ np.linalg.inv(cov)) * (x - mean)).sum(1))[:h]
        det = np.linalg.slogdet(np.cov(x[at].T, bias=True))[1]
        best = min(best, (det, tuple(x[at].mean(0))))
    assert np.abs(centre - np.array(best[1])).max() < 0.15


def test_curve_visits_every_place_in_unit_steps():
    for dims, bits in ((2, 4), (3, 3)):
        side = np.arange(1 << bits)
        grid = np.stack([x.ravel() for x in np.meshgrid(*[side] * dims)], 1)
        key = packing.hilbert_key(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_long_documents_are_indexed_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{x}" for x in rng.integers(0, 50, 3000)]
    item = " ".join(words[1495:1520])
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:40]))], "doc_id long, text string")
    items = spark.createDataFrame([("a", item)], "item_id string, text string")
    want = sorted((r.doc_id, str(r.hits)) for r in decontaminate.find_phrases(docs, items).collect())
    phrases = decontaminate.Phrases([("a", item)], 10)
    table = decontaminate.bs.HashTable(12)
    table.add(phrases.vocabulary)
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    whole = decontaminate._shard(data, np.array([0, len(data)]), phrases, table)
    monkeypatch.setattr(decontaminate, "SYMBOLS", 64)
    parts = decontaminate._shard(data, np.array([0, len(data)]), phrases, table)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True)) and whole[3].sum() == 25 and len(want) == 2


def test_blocks_of_the_benchmark(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "six seven eight"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("a", "two three"), ("b", "seven"), ("c", "nine")], "item_id string, text string")
    want = sorted((r.doc_id, str(r.hits)) for r in decontaminate.find_phrases(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK", 8)
    assert sorted((r.doc_id, str(r.hits)) for r in decontaminate.find_phrases(docs, items).collect()) == want

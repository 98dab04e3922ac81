"""The corpus operators against brute force on small tables, and their edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.llm import decontaminate, licenses, near_copies, packing, preferences, quality_model, quality_rules, repeats, token_store, toxicity, wordtokens

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "the of and to in is was for over under lazy quick brown fox dog jumps naïve größe señor élan".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) + f" {seed}"


@pytest.fixture(scope="module")
def docs(spark):
    shared = prose(99, 40)
    texts = [prose(i, 80) for i in range(12)]
    texts += [texts[0], texts[1] + " tail", shared + texts[2], prose(50, 30) + shared, None, "", "one", "x" * 300, "y" + "x" * 120, texts[0].upper()]
    rows = [(i, t, "en", "s", len(t or ""), "extra") for i, t in enumerate(texts)]
    rows += [(None, texts[3], None, None, None, None), (2, texts[2], "en", "s", 5, "extra")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hits string").cache()


def ids_and_texts(docs):
    last = (1 << 63) - 1
    return [(last if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect()]


@pytest.mark.parametrize("length", [50, 20])
def test_repeats(docs, length):
    found = repeats.find_repeats(docs, length).select(F.col("row.doc_id").alias("d"), "n_bytes", "n_removed", "spans", "kept_sha256")
    rows, seen, want = ids_and_texts(docs), {}, []
    for i, t in rows:
        b = t.encode()
        for s in range(len(b) - length + 1):
            seen.setdefault(b[s : s + length], set()).add(i)
    for i, t in rows:
        b = t.encode()
        cover = [False] * len(b)
        for s in range(len(b) - length + 1):
            if min(seen[b[s : s + length]]) < i:
                cover[s : s + length] = [True] * length
        want.append((i, len(b), sum(cover), sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover)), hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest()))
    got = [((1 << 63) - 1 if r.d is None else r.d, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in found.collect()]
    assert sorted(got) == sorted(want)
    assert repeats.remove_repeats(docs, length).columns == docs.columns


@pytest.mark.parametrize("size", [2, 5])
def test_near_copies(docs, size):
    one_each = docs.dropDuplicates(["doc_id"])
    sets = {}
    for i, t in ids_and_texts(one_each):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    last = (1 << 63) - 1
    got = {(last if r.doc_id is None else r.doc_id): (r.n_shingles, last if r.component_id is None else r.component_id) for r in near_copies.near_copies(one_each, size).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}


def test_pruning_keeps_similar_pairs():
    few = near_copies.fewest_matches(0.8)
    assert few == sorted(few) and few[-1] < 0.8 * near_copies.HASHES


def test_phrases(spark, docs):
    items = spark.createDataFrame([("a", prose(99, 40)), ("b", "quick brown"), ("c", None), (None, "nothing here at all"), ("d", "!!"), ("a", "one")], "item_id string, text string")
    found = {(r.doc_id, r.text): r.found for r in decontaminate.find_phrases(docs, items, into="found").collect()}
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for r in items.collect():
        w = re.findall(pattern, (r.text or "").translate(LOWER))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(r.item_id or "")
    for (_, t), got in found.items():
        w, hit, names = re.findall(pattern, (t or "").translate(LOWER)), set(), set()
        for window, who in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    names |= who
        assert (got.n_words, sum(x.last - x.first for x in got.words), got["items"]) == (len(w), len(hit), sorted(names))
    cut = decontaminate.remove_phrases(docs, items)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert decontaminate.find_phrases(docs, items.limit(0)).where("size(hits.words) > 0").count() == 0


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(0, 4, 400), 0)
    index = decontaminate.FMIndex(text, 4)
    for _ in range(30):
        phrase = rng.integers(1, 4, rng.integers(1, 6))
        low, high = index.search(phrase[None], np.array([len(phrase)]))
        want = [k for k in range(len(text) - len(phrase) + 1) if (text[k : k + len(phrase)] == phrase).all()]
        assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def test_quality_rules(docs):
    got = {(r.doc_id, r.n_words): r for r in quality_rules.judge(docs).collect()}
    for i, t in ((r.doc_id, r.text or "") for r in docs.collect()):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        r = got[i, len(w)]
        seen = {}
        for k in range(len(w) - 2):
            seen.setdefault(tuple(w[k : k + 3]), []).append(k)
        again = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(3)}
        assert (r.word_chars, r.n_repeat_words, r.base_failed) == (sum(map(len, w)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_token_store_and_packing(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = wordtokens.default_path()
    library, known = Tokenizer.from_file(path), docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    want, at = {}, 0
    for i, t in sorted(ids_and_texts(known)):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    store = str(tmp_path / "tokens")
    token_store.write_tokens(known, store, path, block_ids=64)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_index(spark, store).collect()} == want
    one = token_store.read_ids(spark, store, known.where("doc_id = 3").select("doc_id")).first()
    assert zlib.crc32(np.array(one.ids, "<u4").tobytes()) == want[3][2]
    pieces = packing.pack(known, path, limit=100).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append((p.start, p.ids))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, parts in by_doc.items():
        assert zlib.crc32(np.array([x for _, ids in sorted(parts) for x in ids], "<u4").tobytes()) == want[i][2]
    for parts in by_sequence.values():
        ends = np.cumsum([n for _, n in sorted(parts)]).tolist()
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 100


@pytest.mark.parametrize("width", [1, 7, 16, 17, 32])
def test_bit_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000, dtype=np.uint64).astype(np.uint32)
    raw = token_store.pack(ids, width)
    assert (token_store.unpack_span(raw, width, 0, 1000) == ids).all() and (token_store.unpack_span(raw, width, 333, 400) == ids[333:400]).all()


def test_toxicity(spark):
    rng, rows = np.random.default_rng(1), []
    for i in range(240):
        words = rng.choice(WORDS, 40).tolist() + [f"w{i}{k}" for k in range(5)]
        if i % 4 == 0:
            words[int(rng.integers(40))] = ["grobnik", "GR0BNIK", "grоbnik"][i % 3]
        if i % 4 == 1:
            words[int(rng.integers(40))] = "grobnikova"
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    lexicon = toxicity.learn(sample, odds=1.0)
    got = toxicity.score(sample, lexicon).select("label", (F.col("toxicity") >= 0.7).cast("int").alias("p")).collect()
    assert np.mean([r.label == r.p for r in got]) > 0.97
    edge = spark.createDataFrame([(1, None), (2, ""), (3, "grobnik " + "the " * 50_000)], "doc_id long, text string")
    assert all(0 <= r.toxicity <= 1 for r in toxicity.score(edge, lexicon).collect())


def test_quality_model(spark):
    rows = [(i, prose(i, 60) if i % 2 else " | ".join(prose(i, 60).split()), i % 2) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    net = quality_model.learn(df.where("doc_id < 110"))
    got = quality_model.score(df.where("doc_id >= 110"), net).collect()
    assert np.mean([(r.quality >= 0.7) == bool(r.label) for r in got]) > 0.9
    edge = spark.createDataFrame([(1, None), (2, ""), (3, "a" * 100_000)], "doc_id long, text string")
    assert all(0 <= r.quality <= 1 for r in quality_model.score(edge, net).collect())


def test_preferences(spark):
    schema = "pair_id long, turn long, role string, text string"
    chosen = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "same"), (3, 0, "user", "alone"), (None, 0, "user", "x")], schema)
    rejected = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", None), (2, 0, "user", "same")], schema)
    got = {r.pair_id: r for r in preferences.preferences(chosen, rejected).collect()}
    assert set(got) == {1, 2}
    assert (got[1].n_common, got[1].prompt, got[1].chosen) == (1, "<|user|>\nhi<|end|>\n", "<|assistant|>\nyes<|end|>\n")
    assert [got[1].chosen[s.start : s.end] for s in got[1].chosen_mask] == ["yes<|end|>"]
    assert (got[2].chosen, got[2].rejected, got[2].chosen_mask) == ("", "", [])


def test_licenses(spark):
    rows = [(1, prose(1, 30) + " Released under the MIT License. " + prose(2, 30)), (2, prose(3, 90)), (3, licenses.TEMPLATES["MIT"].upper()), (4, None), (5, ""), (6, "MIT")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.templates(spark)).collect()
    assert {(r.doc_id, r.license) for r in got} == {(1, "MIT-notice"), (3, "MIT")}


def test_empty_table(spark, docs):
    none = docs.limit(0)
    assert near_copies.near_copies(none).count() == 0
    assert repeats.find_repeats(none).count() == 0
    assert quality_rules.judge(none).count() == 0
    assert packing.pack(none, wordtokens.default_path()).count() == 0

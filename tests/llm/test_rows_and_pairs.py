"""Rows without an id in the removal of repeats, and pairs of conversations with long common prefixes."""

import random
import zlib


from varloom.llm import preferences, repeats

PASSAGE = "this passage of more than fifty bytes stands in the first document of all. "


def equal_crc():
    """Two texts with one crc32, of which only the first holds the passage."""
    rng = random.Random(3)
    ends = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(600_000)]
    seen = {zlib.crc32((PASSAGE + e).encode()): PASSAGE + e for e in ends[:300_000]}
    clean = "".join(chr(97 + k % 26) for k in range(0, 7 * len(PASSAGE), 7))
    for e in ends[300_000:]:
        if found := seen.get(zlib.crc32((clean + e).encode())):
            return found, clean + e
    raise AssertionError("no pair found")


def test_rows_without_an_id_keep_their_text(spark):
    marked, clean = equal_crc()
    assert zlib.crc32(marked.encode()) == zlib.crc32(clean.encode())
    rows = [(1, "first. " + PASSAGE + "end"), (None, marked), (None, clean), (None, marked), (None, None)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(str(r.text) for r in got if r.doc_id is None) == sorted(["", clean, *[marked[len(PASSAGE) :]] * 2])
    assert [r.text for r in got if r.doc_id == 1] == [rows[0][1]]


def test_an_id_that_all_rows_share(spark):
    rows = [(5, PASSAGE + f"row {k} of one id") for k in range(300)] + [(1, "x" + PASSAGE), (9, PASSAGE + "later")]
    got = repeats.find_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), outputs=("n_removed",)).collect()
    removed = [r.n_removed for r in got if r.row.doc_id == 5]
    assert len(removed) == 300 and min(removed) >= len(PASSAGE) and sum(r.n_removed for r in got if r.row.doc_id == 1) == 0


def test_buckets_deal_out_rows_of_one_id():
    import numpy as np

    tags = np.random.default_rng(1).integers(-(2**62), 2**62, 4000)
    found = np.bincount(repeats._bucket_of(np.full(4000, repeats._LAST), tags, 16), minlength=16)
    assert found.min() > 150


def brute_pairs(rows):
    clean = [(c, t, r or "", x or "") for c, t, r, x in rows if c is not None]
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    talks = {c: sorted((r for r in clean if r[0] == c), key=order) for c in {r[0] for r in clean}}
    answers = {c: max((r for r in t if r[2] == "assistant"), key=lambda r: (r[1] is not None, r[1] or 0, r[3]), default=None) for c, t in talks.items()}
    ids = sorted(c for c in talks if answers[c])
    out = {}
    for c, after in zip(ids, ids[1:], strict=False):
        a = talks[c]
        b = sorted(((x[0], x[1], x[2], answers[after][3]) if x[2] == "assistant" and (x[1], x[3]) == (answers[c][1], answers[c][3]) else x for x in a), key=order)
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x[2:] != y[2:]), len(a))
        shown = lambda t: "".join(f"<|{x[2]}|>\n{x[3]}<|end|>\n" for x in t)
        out[c] = (n, shown(a[:n]), shown(a[n:]), shown(b[n:]))
    return out


def test_pairs_share_all_turns_ahead_of_the_last_answer(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"turn {t} of {c}") for c in (3, 4, 8, 20, 21, 40) for t in range(2 + c % 5)]
    rows += [(50, 0, "user", "nobody answers"), (None, 0, "assistant", "no id"), (51, None, "assistant", None), (52, 0, None, None), (52, 1, "assistant", "same"), (52, 1, "assistant", "same"), (53, 0, "assistant", "same")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, pair_id string").repartition(4)
    got = {r.pair_id: (r.n_common, r.prompt, r.chosen, r.rejected) for r in preferences.preferences(*preferences.with_other_answers(df)).collect()}
    assert got == brute_pairs(rows)
    assert got[3][0] == 3 and "turn 3 of 3" in got[3][2] and "turn 3 of 4" not in got[3][3] and got[52][2:] == ("", "")


def test_queries_have_prefixes(spark):
    from varloom.llm import queries

    found = queries.op8_preferences(spark, "/root/testdata/sf0.001").select("n_common", "chosen_mask").collect()
    assert len(found) > 5 and sum(r.n_common > 0 for r in found) >= 0.8 * len(found) and all(r.chosen_mask for r in found)


def test_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preferences.preferences(*preferences.with_other_answers(df)).count() == 0
    assert preferences.preferences(*preferences.with_other_answers(df.unionByName(spark.createDataFrame([(1, 0, "assistant", "alone")], df.schema)))).count() == 0

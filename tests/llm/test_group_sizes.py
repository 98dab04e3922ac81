"""Quality rules over groups of any size: no size at which a group's estimate changes at once."""

import numpy as np
import pytest

from varloom.llm import quality_rules


def test_weights_are_smooth_and_have_their_limits():
    rng = np.random.default_rng(1)
    shape = lambda: (rng.normal(0, 1, 6), np.cov(rng.normal(0, 1, (6, 40))))
    own, wider = shape(), shape()
    for n, want in ((0, wider), (10**9, own)):
        centre, cov = quality_rules.drawn(own, wider, n, 50.0)
        assert centre == pytest.approx(want[0], abs=1e-6) and cov == pytest.approx(want[1], abs=1e-5)
    found = [np.linalg.slogdet(quality_rules.drawn(own, wider, n, 50.0)[1])[1] for n in range(1, 400)]
    assert np.abs(np.diff(found))[40:60].max() < 0.02 and np.abs(np.diff(found, 2))[40:60].max() < 0.001  # nothing happens at 50
    assert all(np.linalg.eigvalsh(quality_rules.drawn(own, wider, n, 50.0)[1]).min() > 0 for n in (1, 5, 49, 50, 51))


def test_outliers_of_groups_around_fifty(spark):
    """Groups of 5, 49, 50 and 51 documents in one language, each with one document of symbols; a language of a single text."""
    rng = np.random.default_rng(9)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 9)))) for _ in range(900)]
    rows, odd = [], []
    for size in (5, 49, 50, 51, 400):
        for k in range(size):
            words = rng.choice(vocabulary, int(rng.integers(120, 260))).tolist()
            if k == 0:
                words = [w if j % 3 else "$#|" for j, w in enumerate(words)]
                odd.append(len(rows))
            lines = [" ".join(words[j : j + 12]) for j in range(0, len(words), 12)]
            rows.append((len(rows), "\n".join(lines), "en", f"s{size}"))
    rows.append((len(rows), " ".join(rng.choice(vocabulary, 200).tolist()), "xx", None))
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert sorted(i for i, r in got.items() if not r.kept) == odd

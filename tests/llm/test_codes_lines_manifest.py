"""Vector codes, line dedup and the manifest against brute force, and on odd tables."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.llm import line_dedup, manifest, vector_codes

# --- vector codes


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8])
def test_search_equals_all_distances(width):
    rng = np.random.default_rng(width)
    for spread in (2, 300):
        book, x = rng.integers(-spread, spread, (64, width)), rng.integers(-spread, spread, (700, width))
        entry, error = vector_codes.nearest(x, book)
        d = ((x[:, None] - book) ** 2).sum(2)
        assert (entry == d.argmin(1)).all() and (error == d.min(1)).all()  # argmin takes the lowest entry of a tie


def brute_codes(rows, parts, entries, rounds):
    usable = [(i, label, [math.floor(256 * c) for c in x]) for i, x, label in rows if x and all(c is not None and math.isfinite(c) for c in x)]
    usable.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(usable[0][2]) // parts
    part = lambda x, p: x[p * w : (p + 1) * w]
    books = [[list(part(x, p)) for _, _, x in usable[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((c - d) ** 2 for c, d in zip(a, b, strict=True))
    find = lambda x, p: min((dist(part(x, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        chosen = [[find(x, p)[1] for _, _, x in usable] for p in range(parts)]
        for p in range(parts):
            for k in set(chosen[p]):
                own = [part(x, p) for (_, _, x), c in zip(usable, chosen[p], strict=True) if c == k]
                books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [(i, label, [find(x, p) for p in range(parts)]) for i, label, x in usable]
    by_label = {}
    for _, label, f in found:
        by_label[label] = by_label.get(label, 0) + sum(d for d, _ in f)
    return sorted((str(i), "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by_label[label], digest) for i, label, f in found)


VECTORS = "vec_id long, embedding array<float>, label int, x string, code string, _label string, error string"


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), np.float32(rng.normal(0, 0.05, 32)).tolist(), None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(300)]
    rows += [(7, rows[3][1], 9), (None, rows[4][1], None), (-5, rows[5][1], 1), (-5, rows[5][1], 1)]
    rows += [(900, None, 1), (901, [], 1), (902, [None] * 32, 1), (903, [math.nan] * 32, 1), (904, [math.inf] + [0.0] * 31, 2), (-9, [-math.inf] * 32, 2)]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], VECTORS).repartition(5)
    got = vector_codes.compress(df, 16, 20, 2)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == brute_codes(rows, 16, 20, 2)


def test_codes_of_few_rows_and_of_none(spark):
    df = spark.createDataFrame([(1, [0.5] * 16, 1), (2, [-0.001] * 16, None)], "vec_id long, embedding array<float>, label int")
    assert [(r.code, r.error) for r in vector_codes.compress(df).orderBy("vec_id").collect()] == [("00" * 16, 0), ("01" * 16, 0)]
    assert vector_codes.compress(df.where("vec_id > 5")).count() == 0
    vectors = vector_codes.usable(df)
    books = vector_codes.start_books(vectors)
    assert [r.x for r in vector_codes.decode(vector_codes.encode(vectors, books), books).orderBy("vec_id").collect()] == [[128] * 16, [-1] * 16]
    with pytest.raises(ValueError, match="one length"):
        vector_codes.compress(df.withColumn("embedding", F.slice("embedding", 1, 15)))


# --- line dedup


def brute_lines(rows, least=10):
    last = 1 << 63
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\v\f\r"))
    docs = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            docs.setdefault(key(line), set()).add(last if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or min(docs[key(x)]) == (last if i is None else i)]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


LONG = "one line that is very long " * 3000


def line_rows():
    rng = np.random.default_rng(2)
    pool = ["Short", "", "   ", "exactly 10", "nine char", "a common line of text", "A Common LINE of text \t", "ä common line", "Ä common line", "漢字かな漢字かな漢字", "漢字かな漢字かな漢", "\x0b\x0ctrimmed line\r", "trimmed line", " not trimmed line", LONG, *(f"line number {k}" for k in range(30))]
    rows = [(int(i), "\n".join(pool[k] for k in rng.integers(0, len(pool), int(rng.integers(1, 12))))) for i in rng.permutation(150)]
    return [*rows, rows[0], (rows[1][0], rows[2][1]), (None, rows[3][1]), (None, rows[3][1]), (None, "only here without id\nonly here without id"), (500, None), (501, ""), (502, "\n\n"), (-3, "a common line of text")]


def test_lines_equal_brute_force(spark):
    rows = line_rows()
    df = spark.createDataFrame([(i, t, *("c" * 6)) for i, t in rows], "doc_id long, text string, key string, tag string, keep string, n_lines string, row string, doc string").repartition(6)
    found = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df))
    got = sorted((str(r.row.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in found.collect())
    assert got == brute_lines(rows)
    assert all(r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest() and r.row.tag == "c" for r in found.collect())
    plain = line_dedup.drop_lines(df)
    assert plain.columns == df.columns and sorted((str(r.doc_id), r.text) for r in plain.collect()) == sorted((i, t) for i, _, _, t in brute_lines(rows))


def test_bitmaps_hold_no_text(spark):
    df = spark.createDataFrame([(1, "a line to be kept\nx"), (2, "x\na line to be kept"), (3, None)], "doc_id long, text string")
    found = {r.key: r for r in line_dedup.keep_bitmaps(df).collect()}
    assert line_dedup.kept_lines(found[2].keep, 2).tolist() == [True, False] and found[1].keep == b"" and found[3].n_lines == 1
    assert line_dedup.kept_lines(found[3].keep, 1).tolist() == [True]
    assert line_dedup.drop_lines(df.where("doc_id > 5")).count() == 0


def test_a_line_in_every_document_leaves_a_task_once(spark):
    df = spark.createDataFrame([(i, f"the line of every document\nown line {i} of many") for i in range(2000)], "doc_id long, text string").repartition(4)
    share = df.withColumn("tag", F.unhex(F.md5(F.col("text").cast("binary")))).select(F.col("doc_id").alias("doc"), "tag", "text").mapInArrow(line_dedup._scan(10, 4), line_dedup._FOUND)
    assert share.where("n_lines IS NULL").count() == 2000 + 4
    assert sorted(r.n_dropped for r in line_dedup.keep_bitmaps(df).collect()) == [0] + [1] * 1999


# --- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """The root and the siblings of each node, level by level."""
    proofs, members = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, up_members = [], []
        for k in range(0, len(nodes), 3):
            run = nodes[k : k + 3]
            for j in range(len(run)):
                for m in members[k + j]:
                    proofs[m].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(h(*run))
            up_members.append([m for x in members[k : k + 3] for m in x])
        nodes, members = up, up_members
    return nodes[0], proofs


def brute_manifest(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    groups = {}
    for i, source, text in rows:
        groups.setdefault(source, []).append((i, h(field(i), field(source), field(text)), h(field(i), field(source), field(text and text.replace("\n", "")))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = []
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(r[1])))
        made.append(tree([r[1] for r in groups[s]]))
    root, outer = tree([m[0] for m in made])
    out = []
    for s, (sub, proofs), above in zip(names, made, outer, strict=True):
        for (i, own, other), proof in zip(groups[s], proofs, strict=True):
            out.append((str(i), own, other if other != own else None, sub, root, tuple(proof + above)))
    return sorted(out, key=str)


def found_manifest(df):
    got = manifest.manifest(df, ("doc_id", "source", "text"), "source", "doc_id", {"text": F.replace("text", F.lit("\n"), F.lit(""))})
    return got, sorted(((str(r.key), r.leaf, r.suspect, r.subroot, r.root, tuple((s.left, s.right) for s in r.proof)) for r in got.collect()), key=str)


def test_manifest_equals_brute_force(spark):
    """One group of over 729 rows, so that roots of buckets are combined again; null, repeated and single ones beside it."""
    rows = [(i, "hot", f"text {i}\nmore" if i % 3 else None) for i in range(1700)] + [(i, f"s{i % 40}", "é\n" * (i % 4)) for i in range(3000, 3100)]
    rows += [(5, None, "x"), (5, None, "y"), (5, None, "y"), (None, None, "z"), (None, "hot", "a\nb"), (9, "alone", ""), (-4, "hot", "minus"), (9, "Z", "1"), (9, "é", "1")]
    df = spark.createDataFrame([(*r, "k", "g", 1) for r in rows], "doc_id long, source string, text string, key string, grp string, h int").repartition(7)
    got, found = found_manifest(df)
    assert found == brute_manifest(rows)
    folded = got.select(manifest.fold(F.col("leaf"), F.col("proof")).alias("own"), manifest.fold(F.coalesce("suspect", "leaf"), F.col("proof")).alias("other"), "root", "suspect").collect()
    assert all(r.own == r.root and (r.other == r.root) == (r.suspect is None) for r in folded)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 27, 28, 729, 730])
def test_manifest_of_one_group(spark, n):
    rows = [(i, "s", str(i)) for i in range(n)]
    assert found_manifest(spark.createDataFrame(rows, "doc_id long, source string, text string"))[1] == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    got, found = found_manifest(df)
    assert found == [] and "proof" in got.columns


def test_levels(spark):
    got = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 9, 10, 2187, 2188)], "n long").select(manifest.levels_of(F.col("n")).alias("k"))
    assert [r.k for r in got.collect()] == [0, 1, 1, 2, 2, 3, 7, 8]

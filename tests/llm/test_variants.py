"""Spelling variants, the Hamming join and whitening against brute force."""

import builtins
import random
import re
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from courierlens.llm import hamming_join, ngram_jaccard, spelling, whitening
from courierlens.llm.words import distinct, mix
from tests.llm.corpus import SCHEMA, awkward, copies


def apart(a, b):
    """The edit distance, by the whole matrix."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def forms_by_hand(n):
    """{word: (form, root, n, n_near, form_n)} of word counts."""
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and apart(v, w) == 1] for w in n}
    form = {w: next((v for v in sorted(near[w], key=lambda v: (-n[v], v))[:1] if n[v] >= 10 * n[w]), None) for w in n}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def slipped(r, w):
    k, c = r.randrange(len(w)), r.choice("abé")
    return r.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])


@pytest.mark.parametrize("few", [0, 3, spelling.FEW])
def test_a_scan_finds_every_pair_of_one_edit(monkeypatch, few):
    monkeypatch.setattr(spelling, "FEW", few)
    r = random.Random(3)
    for _ in range(60):
        length, begin = r.randrange(3, 9), r.randrange(0, 3)
        head = "".join(r.choice("ab") for _ in range(begin))
        some = {head + "".join(r.choice("abé") for _ in range(length - begin + x)) for x in (0, 0, 1) for _ in range(15)}
        listed, searching = sorted(some), [w for w in some if len(w) == length] or [head + "a" * (length - begin)]
        found = sorted(spelling.scan(listed, searching, begin))
        assert found == [(i, j) for i, q in enumerate(searching) for j, w in enumerate(listed) if apart(q, w) == 1]


def test_a_scan_skips_what_a_dead_prefix_begins(monkeypatch):
    seen = []
    monkeypatch.setattr(spelling, "FEW", 0)
    monkeypatch.setattr(spelling, "ord", lambda c: seen.append(c) or builtins.ord(c), raising=False)
    listed = sorted(["zz" + "".join(x) for x in ("abcde", "abcdf", "bbcde", "cbcde")] + ["abcdefg"])
    assert list(spelling.scan(listed, ["abcdefh"], 0)) == [(0, 0)]
    assert len(seen) == 7 + 2  # the seven letters of the near word, and "zz" once for four words


@pytest.mark.parametrize("list_words", [spelling.LIST_WORDS, 3])
def test_variants_equal_brute_force(spark, list_words):
    r = random.Random(7)
    n = {}
    for _ in range(25):
        base = "".join(r.choice("abcdé") for _ in range(r.randrange(7, 12)))
        n[base] = r.choice([3, 400, 4000])
        for _ in range(8):
            v = slipped(r, r.choice(list(n)))
            if len(v) >= 7:
                n[v] = r.choice([2, 2, 30, 40])
    n |= {"chainaaa": 2, "chainaab": 20, "chainabb": 200, "chainbbb": 2000, "tieaaaaa": 2, "tieaaaab": 50, "tieaaaac": 50, "lonelyxyz": 5}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    want = forms_by_hand(n)
    pairs = {(g.word, g.near) for g in spelling.near_words(words, list_words).collect()}
    assert pairs == {(a, b) for a in n for b in n if apart(a, b) == 1}
    assert spelling.near_words(words, list_words).count() == len(pairs)
    if list_words == spelling.LIST_WORDS:
        rows = spelling.variants(words).collect()
        assert {g.word: (g.form, g.root, g.n, g.n_near, g.form_n) for g in rows} == want and len(rows) == len(want)
        assert want["chainaaa"][:2] == ("chainaab", "chainbbb") and want["tieaaaaa"][0] == "tieaaaab" and want["lonelyxyz"] == (None, "lonelyxyz", 5, 0, None)


def counted_by_hand(rows, slips):
    out = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slips and h % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += len(w) >= 7
    return {w: n for w, n in out.items() if n >= 2}


@pytest.mark.parametrize("slips", [None, 2])
def test_the_vocabulary_equals_a_plain_count(spark, slips):
    long_text = " ".join(random.Random(2).choices(["Straßen×", "éÉlément", "ABCDEFGH", "abcdefgh", "x" * 3000, "kürzere", "seven77seven"], k=20000))
    rows = [*awkward(), (60, "Wordwordword wordwordword\nWORDWORDWORD", *[None] * 6), (61, long_text, *[None] * 6), (None, "nullidrow nullidrow", *[None] * 6)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = spelling.vocabulary(docs, slips=slips).collect()
    assert {g.word: g.n for g in found} == counted_by_hand([x[:2] for x in rows], slips) and len(found) == len({g.word for g in found})


def test_spelling_of_awkward_and_empty_tables(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    assert {g.word for g in spelling.variants(spelling.vocabulary(docs)).collect()} == set(counted_by_hand([x[:2] for x in awkward()], None))
    assert spelling.variants(spelling.vocabulary(docs.limit(0))).collect() == []


def test_op11_on_the_small_table(spark):
    found = {g.word: (g.form, g.root, g.n, g.n_near, g.form_n) for g in spelling.op11_spelling_variants(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    n = counted_by_hand([(d.doc_id, d.text) for d in docs], 31)
    assert set(found) == set(n)
    some = sorted(n, key=lambda w: zlib.crc32(w.encode()))[:150]
    for w in some:
        near = [v for v in n if abs(len(v) - len(w)) < 2 and apart(v, w) == 1]
        assert found[w][2:4] == (n[w], len(near))


def by_hand(rows, k, num, den):
    """{row: (doc_id, shingles, component)} by comparing all pairs."""
    sets = []
    for i, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in re.split("[\x20\x09-\x0d]+", w) if x]
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    part = {i: i for i, _ in rows if i is not None}

    def top(i):
        return i if part[i] == i else top(part[i])

    for (i, _), a in zip(rows, sets, strict=True):
        for (j, _), b in zip(rows, sets, strict=True):
            if i is not None and j is not None and a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((top(i), top(j)))
                part[y] = x
    return [(i, len(s), None if i is None else top(i)) for (i, _), s in zip(rows, sets, strict=True)]


@pytest.mark.parametrize("k", [2, 5])
def test_the_hamming_join_equals_brute_force(spark, k):
    rows = awkward() + copies()
    found = hamming_join.near_duplicates(spark.createDataFrame(rows, SCHEMA), k).collect()
    want = by_hand([x[:2] for x in rows], k, 80, 100)
    assert Counter((g.doc_id, g.n_shingles, g.component_id) for g in found) == Counter(want)
    assert all(g.kept == (g.doc_id is None or g.doc_id == g.component_id) for g in found)
    assert any(g.component_id not in (None, g.doc_id) for g in found)


def test_every_pair_within_the_threshold_shares_a_key():
    r = np.random.default_rng(1)
    for _ in range(300):
        a = r.integers(0, 1 << hamming_join.BITS, hamming_join.SYMBOLS).astype(np.uint16)
        b = a.copy()
        at = r.choice(hamming_join.SYMBOLS, hamming_join.threshold(), replace=False)
        b[at] ^= np.uint16(1)
        assert len(np.intersect1d(hamming_join.keys(a), hamming_join.keys(b)))
    b = a ^ np.uint16(1)
    assert not len(np.intersect1d(hamming_join.keys(a), hamming_join.keys(b)))


def test_signatures_tell_the_similarity():
    r = np.random.default_rng(2)
    distances = []
    for _ in range(200):
        h = mix(r.integers(0, 1 << 62, 1100).astype(np.uint64))
        a, b = distinct(h[:1000]), distinct(h[100:1100])  # 900 of 1,100 in common: 0.818
        distances.append(int((hamming_join.signature(a) != hamming_join.signature(b)).sum()))
    assert max(distances) <= hamming_join.threshold() and abs(np.mean(distances) - hamming_join.SYMBOLS * 2 / 11) < 2


def test_nothing_links_without_the_index(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p"), (2, "a b c d e f g h i j k l m n o q")], "doc_id long, text string")
    assert [g.component_id for g in hamming_join.near_duplicates(docs, 2).collect()] == [1, 1]
    rows = ngram_jaccard.components_by_leaves(docs, 2, lambda h: h[:0], hamming_join.linked)
    assert sorted(g.component_id for g in rows.collect()) == [1, 2]
    with pytest.raises(ValueError, match="0.8"):
        hamming_join.near_duplicates(docs, 2, 79, 100)
    assert hamming_join.near_duplicates(docs.limit(0)).collect() == []


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "k", b"x", 2, 3) for i, v in rows], "vec_id long, embedding array<float>, label int, key string, x binary, weight long, copies long")


def whitened_by_hand(x, w, most):
    """By numpy alone: rows, weights."""
    mean = (x * w[:, None]).sum(0) / w.sum()
    c = x - mean
    v = (c * w[:, None]).T @ c / w.sum()
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:most], axes[:, ::-1][:, :most]
    return c @ axes / np.sqrt(e), e / np.trace(v)


@pytest.mark.parametrize("weights", ["count", "one"])
def test_whitening_equals_numpy(spark, weights):
    r = np.random.default_rng(5)
    base = r.normal(size=(60, 6)) * np.array([5, 3, 2, 1, 0.5, 0.3])
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100 + i, base[3].tolist()) for i in range(40)] + [(None, base[4].tolist()), (7, base[7].tolist())]
    bad = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (203, [float("nan")] * 6), (204, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (205, [1.0, 2.0]), (206, [3e38] * 6)]
    found = whitening.whitened(vectors(spark, rows + bad).repartition(5), 4, weights).collect()
    x = np.floor(64 * np.array([np.float32(v).astype(float) for _, v in rows])).astype(np.int64) + 1_000_000
    points, at, count = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    w = count if weights == "count" else np.ones(len(points), int)
    y, explained = whitened_by_hand(points.astype(float), w, 4)
    n, sums = int(w.sum()), (points * w[:, None]).sum(0)
    assert len(found) == len(rows) and Counter(g.vec_id for g in found) == Counter(i for i, _ in rows)
    place = {i: p for (i, _), p in zip(rows, at.ravel(), strict=True)}
    for g in found:
        p = place[g.vec_id]
        assert g.n == n and g.deviation == int(((n * points[p] - sums) ** 2).sum()) and g.identity_error < 1e-9
        assert np.allclose(np.abs(g.whitened), np.abs(y[p]), atol=1e-6) and np.allclose(g.explained, explained)
    signs = [np.sign(g.whitened) * np.sign(y[place[g.vec_id]]) for g in found if (np.abs(y[place[g.vec_id]]) > 1e-6).all()]
    assert all((a == b).all() for a, b in pairwise(signs))


def test_whitening_without_variance_or_rows(spark):
    assert whitening.whitened(vectors(spark, [])).collect() == []
    assert whitening.whitened(vectors(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whitened(vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect() == []
    line = whitening.whitened(vectors(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)])).collect()
    assert {len(g.whitened) for g in line} == {1} and abs(line[0].explained[0] - 1) < 1e-12


def test_deviations_are_exact_where_doubles_are_not():
    x = np.array([[1_000_001, 10**9], [1_000_003, 7], [999_999, -(10**9)]])
    centre = whitening.Centre(np.array([int(v) for v in x.sum(0)], object), 3)
    assert centre.deviations(x) == [sum((3 * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(0), strict=True)) for row in x]
    far = np.array([[2**52], [-(2**52)]])
    assert whitening.Centre(np.array([0], object), 2).deviations(far) == [None, None]


def test_op13_on_the_small_table(spark):
    rows = whitening.op13_whitening(spark, "/root/testdata/sf0.001")
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    x = np.floor(64 * np.array([v.embedding for v in table])).astype(np.int64) + 1_000_000
    y, explained = whitened_by_hand(x.astype(float), np.ones(len(x)), 32)
    want = {v.vec_id: abs(y[i]) for i, v in enumerate(table)}
    found = rows.collect()
    assert rows.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and len(found) == 32 * len(x)
    assert all(abs(abs(g.whitened) - want[g.vec_id][g.component - 1]) < 1e-6 and abs(g.explained - explained[g.component - 1]) < 1e-9 for g in found)

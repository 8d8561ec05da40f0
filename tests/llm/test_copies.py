"""Near copies, lines and passages, against brute force."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from courierlens.llm import line_dedup, ngram_jaccard, substring_dedup, tables
from courierlens.llm.components import connected_components
from tests.llm.corpus import SCHEMA, awkward, copies, words


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components_by_hand(rows, k, num, den):
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets.setdefault(r[0], []).append(shingles(r[1], k))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and any(a and b and den * len(a & b) >= num * len(a | b) for a in sets[i] for b in sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_jaccard_components_equal_brute_force(spark):
    rows = [*awkward(), *copies(1), *copies(2)]
    rows = [(r[0] if i < len(awkward()) + len(copies(1)) else r[0] + 1000, *r[1:]) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for k, num, den in ((4, 85, 100), (5, 80, 100)):
        got = ngram_jaccard.jaccard_components(docs, k, num, den).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == components_by_hand(rows, k, num, den)
        assert sorted((r.doc_id is None, r.n_shingles) for r in got) == sorted((r[0] is None, len(shingles(r[1], k))) for r in rows)


def test_jaccard_of_an_empty_table(spark):
    assert ngram_jaccard.jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_leaf_search_finds_links_that_the_first_document_does_not_make(spark):
    """A chain: only neighbours link, and all share long passages."""
    r = random.Random(3)
    base = words(r, 120).split(" ")
    rows = []
    for i in range(40):
        base[(3 * i) % 120] = words(r, 1)
        rows.append((i, " ".join(base), None, None, None, None, None, None))
    got = {x.doc_id: x.component_id for x in ngram_jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA), 4, 85, 100).collect()}
    assert got == components_by_hand(rows, 4, 85, 100)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 2**32))
def test_linked_sets_share_a_leaf(n, changed, seed):
    r = np.random.default_rng(seed)
    a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
    keep = a[: max(0, len(a) - min(changed, len(a)))]
    b = np.unique(np.concatenate([keep, r.integers(0, 2**63, int(r.integers(0, changed + 1))).astype(np.uint64)]))
    common = len(np.intersect1d(a, b))
    if len(b) and 100 * common >= 85 * (len(a) + len(b) - common):
        assert len(np.intersect1d(ngram_jaccard.leaves(a, 85, 100), ngram_jaccard.leaves(b, 85, 100)))


def test_tree_gives_every_pair_that_its_bound_lets_through():
    r = np.random.default_rng(1)
    points = r.integers(0, 4, (90, ngram_jaccard.COORDINATES))
    sizes, parts = points.sum(1), r.integers(0, 5, 90)
    got = {(min(p), max(p)) for p in ngram_jaccard.Tree(points, sizes).pairs(50, 100, parts)}
    want = set()
    for i in range(90):
        for j in range(i + 1, 90):
            alike = 150 * np.minimum(points[i], points[j]).sum() >= 50 * (sizes[i] + sizes[j])
            if parts[i] != parts[j] and alike and 100 * min(sizes[i], sizes[j]) >= 50 * max(sizes[i], sizes[j]):
                want.add((i, j))
    assert got == want


def test_links_come_from_the_tree(spark, monkeypatch):
    """Without what the tree yields nothing is linked, and it yields far fewer pairs than the groups have."""
    rows = copies(1)
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(ngram_jaccard, "linked", lambda *_: iter(()))
    got = ngram_jaccard.jaccard_components(docs, 4, 85, 100).collect()
    same = {}
    for r in rows:
        same.setdefault(shingles(r[1], 4), r[0])
        same[shingles(r[1], 4)] = min(same[shingles(r[1], 4)], r[0])
    assert {g.doc_id: g.component_id for g in got} == {r[0]: same[shingles(r[1], 4)] for r in rows}


def test_parts_of_large_groups_lose_no_link(spark, monkeypatch):
    """Two clusters and odd documents that share leaves, in parts of a few members."""
    r = random.Random(8)
    base = words(r, 200).split(" ")
    rows = []
    for i in range(160):
        other = list(base)
        for _ in range(r.randrange(1, 9 if i % 2 else 30)):
            other[r.randrange(len(other))] = words(r, 1)
        rows.append((i, " ".join(other), None, None, None, None, None, None))
    docs = spark.createDataFrame(rows, SCHEMA)
    want = components_by_hand(rows, 4, 85, 100)
    assert len(set(want.values())) > 5
    monkeypatch.setattr(ngram_jaccard, "GROUP_ROWS", 7)
    monkeypatch.setattr(ngram_jaccard, "BROADCAST_IDS", 0)
    monkeypatch.setattr(tables, "BITMAP_BITS", 1 << 10)
    monkeypatch.setattr(tables, "HOT_SHARE", 1 << 30)
    got = ngram_jaccard.jaccard_components(docs, 4, 85, 100).collect()
    assert {g.doc_id: g.component_id for g in got} == want


def test_connected_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 30)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(7, 7), (None, 3)]
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i] == min(seen)


def lines_by_hand(rows, num, den):
    places = sorted({(r[0], k, frozenset(line.lower().split(" ")) - {""}) for r in rows if r[0] is not None for k, line in enumerate((r[1] or "").split("\n"))}, key=lambda x: x[:2])
    seen, gone = [], set()
    for doc, k, w in places:
        if w:
            if any((num + den) * len(w & v) >= num * (len(w) + len(v)) for v in seen):
                gone.add((doc, k))
            seen.append(w)
    return gone


def test_line_dedup_equals_brute_force(spark):
    r, rows = random.Random(6), []
    stock = [words(r, n) for n in (1, 2, 9, 10, 11, 20, 40)]
    for i in range(60):
        lines = [words(r, r.randrange(1, 30)) for _ in range(r.randrange(1, 5))] + r.sample(stock, 2)
        for k, line in enumerate(lines):
            w = line.split(" ")
            if r.random() < 0.4 and len(w) > 8:
                w[r.randrange(len(w))] = words(r, 1)
                lines[k] = " ".join(w)
        rows.append((i, "\n".join(lines), None, None, None, None, None, None))
    rows += [(1000, None, *[None] * 6), (1001, "", *[None] * 6), (None, stock[3], *[None] * 6), (1002, " \n\t\n", *[None] * 6), rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA)
    gone = line_dedup.removed_lines(docs).collect()
    assert len(gone) == len(rows)
    got = {(x.doc_id, line) for x in gone for line in x.removed}
    assert got == lines_by_hand(rows, line_dedup.NUM, line_dedup.DEN)
    clashing = docs.select("doc_id", "text", *(F.lit(c).alias(c) for c in ("removed", "row", "id", "left", "_gone")))
    assert all(x.removed == "removed" and x["row"] == "row" and x["left"] == "left" for x in line_dedup.deduplicated(clashing).collect())
    left = {x.doc_id: x.text for x in line_dedup.deduplicated(docs).collect()}
    for r_ in rows:
        keep = [line for k, line in enumerate((r_[1] or "").split("\n")) if (r_[0], k) not in got]
        if r_[0] is not None and any(x.strip() for x in keep):
            assert left[r_[0]] == "\n".join(keep)
    assert left[None] == stock[3] and left[1000] is None and left[1001] == ""
    assert line_dedup.deduplicated(spark.createDataFrame([], SCHEMA)).collect() == []


def test_lines_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_PLACES", 0)
    test_line_dedup_equals_brute_force(spark)


def test_passages_are_found_despite_shifts(spark):
    r = random.Random(8)
    passage = words(r, 70)
    rows = [(i, f"{words(r, r.randrange(0, 90))} {passage if i % 3 == 0 else words(r, 70)} {words(r, r.randrange(0, 90))}", *[None] * 6) for i in range(30)]
    rows += [(r_[0] and r_[0] + 500, *r_[1:]) for r_ in awkward() if r_[0] not in (0, 50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {x.doc_id: x for x in substring_dedup.repeated_spans(docs).collect()}
    assert set(got) == {i for i in range(0, 30, 3)}
    text = dict((r_[0], r_[1]) for r_ in rows)
    for i, x in got.items():
        span = text[i][x.start : x.start + x.length]
        assert any(span in text[j] for j in got if j != i) and len(span) > len(passage) / 2
        assert x.first_doc_ids[0] == 0
    clean = {x.doc_id: x.text for x in substring_dedup.deduplicated(docs).collect()}
    assert clean[0] == text[0] and clean[1] == text[1]
    for i in range(3, 30, 3):
        x = got[i]
        assert len(clean[i]) == len(text[i]) - x.removed_chars and clean[i].startswith(text[i][: x.start]) and clean[i].endswith(text[i][x.start + x.length :])
    assert substring_dedup.repeated_spans(spark.createDataFrame([], SCHEMA)).collect() == []


def chunks_by_hand(text):
    """(start, piece) of the chunks, by a rolling hash byte by byte."""
    data, h, out, last = text.encode(), 0, [], 0
    for i, byte in enumerate(data):
        h = (2 * h + int(substring_dedup._GEAR[byte])) % 2**32
        fits = (h >> 16) % 2**substring_dedup.BORDER_BITS == 0
        end = i + 1
        if end == len(data) or (fits and end - last >= substring_dedup.MIN_BYTES):
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            if end > last:
                out.append((last, end))
                last = end
        elif end - last > substring_dedup.MAX_BYTES:
            cut = last + substring_dedup.MAX_BYTES
            while data[cut] & 0xC0 == 0x80:
                cut -= 1
            out.append((last, cut))
            last = cut
    return [(len(data[:a].decode()), data[a:b].decode()) for a, b in out]


def test_spans_equal_brute_force(spark, monkeypatch):
    r, rows = random.Random(12), []
    shared = [words(r, n) for n in (15, 60, 200, 55)] + ["日本語 " + "漢字" * 60]
    for i in range(40):
        parts = [words(r, r.randrange(0, 60)), r.choice(shared), words(r, 5), r.choice(shared) if i % 4 == 0 else "", r.choice(shared) if i % 7 == 0 else "ñ"]
        rows.append((i, " ".join(parts), *[None] * 6))
    rows += [rows[3], (60, rows[5][1], *[None] * 6), (61, words(r, 30_000) + shared[2], *[None] * 6), (None, shared[1], *[None] * 6), (62, None, *[None] * 6), (63, "", *[None] * 6)]
    docs = spark.createDataFrame(rows, SCHEMA)
    texts = {i: t for i, t, *_ in rows if i is not None and t}
    holders = {}
    for i, t in texts.items():
        for _, piece in chunks_by_hand(t):
            holders.setdefault(piece, set()).add(i)
    want = set()
    for i, t in texts.items():
        run = []
        for start, piece in [*chunks_by_hand(t), (len(t), None)]:
            if piece is not None and len(holders[piece]) > 1:
                run.append((start, piece))
            elif run:
                length = sum(len(p) for _, p in run)
                if length >= substring_dedup.MIN_CHARS:
                    firsts = sorted({min(holders[p]) for _, p in run})
                    want.add((i, run[0][0], length, len(run), sum(len(p) for _, p in run if min(holders[p]) < i), tuple(firsts)))
                run = []
    for share in (tables.HOT_SHARE, 1 << 30):
        monkeypatch.setattr(tables, "HOT_SHARE", share)
        got = substring_dedup.repeated_spans(docs).collect()
        assert {(x.doc_id, x.start, x.length, x.n_chunks, x.removed_chars, tuple(x.first_doc_ids)) for x in got} == want
        assert len(got) == len(want) > 20
    clashing = docs.select("doc_id", "text", *(F.lit(c).alias(c) for c in ("cuts", "row", "id", "_cuts")))
    assert all(x.cuts == "cuts" and x["row"] == "row" for x in substring_dedup.deduplicated(clashing).collect())


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=600))
def test_chunks_cover_a_text(text):
    data = np.frombuffer(text.encode(), np.uint8)
    ends = substring_dedup.borders(data) if len(data) else []
    assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == len(data)
    assert all(b - a <= substring_dedup.MAX_BYTES + 3 for a, b in zip([0, *ends], ends, strict=False))
    for a, b in zip([0, *ends], ends, strict=False):
        text.encode()[a:b].decode()


def test_lines_of_a_frequent_word_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CROWD", 3)
    r = random.Random(21)
    base = words(r, 12).split(" ")
    lines = []
    for _ in range(40):
        line = list(base)
        for _ in range(r.randrange(0, 3)):
            line[r.randrange(12)] = words(r, 1)
        lines.append(" ".join(line))
    docs = spark.createDataFrame([(i, "\n".join(lines[i::8])) for i in range(8)], "doc_id long, text string")
    found = {g.doc_id: g.removed for g in line_dedup.removed_lines(docs).collect()}
    monkeypatch.setattr(line_dedup, "CROWD", 2000)
    assert found == {g.doc_id: g.removed for g in line_dedup.removed_lines(docs).collect()}
    kept, gone = [], {i: [] for i in range(8)}
    for i in range(8):
        for j, line in enumerate(lines[i::8]):
            own = set(line.split(" "))
            (gone[i].append(j) if any(100 * len(own & o) >= 90 * len(own | o) for o in kept) else None)
            kept.append(own)
    assert found == gone and any(gone.values())


def test_line_classes_need_no_sorting(spark):
    """Keys that cannot be null are sorted as plain numbers, and classes are found by hashing, whatever the ids."""
    rows = [(-(2**63), "b a c\nc b a"), (2**63 - 1, "a b c\nx y"), (-5, "y x\nx\n\ny  x"), (-5, "x y"), (7, "x X")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert not docs.select(line_dedup.distinct_keys(F.col("text"), line_dedup.rarity(docs)).alias("k")).schema["k"].dataType.containsNull
    found = line_dedup.classes_of(docs, line_dedup.NUM, line_dedup.DEN)
    assert sorted((c.doc_id, c.line, c.n) for c in found.collect()) == [(-(2**63), 0, 3), (-5, 0, 2), (-5, 1, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan

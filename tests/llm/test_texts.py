"""Operators on single texts: against libraries, brute force, and awkward rows."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from courierlens.llm import chat_format, decontamination, license_scan, quality_rules, sentencepiece_codec, token_counts, toxicity
from tests.llm.corpus import SCHEMA, awkward, words


def test_ledger_and_policies(spark):
    rows = [*awkward(), (60, " ".join(["spam eggs ham"] * 30), *[None] * 6), (61, "\n".join(["same line here"] * 30 + [words(random.Random(2), 60)]), *[None] * 6)]
    got = quality_rules.ledger(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for g in got:
        texts = {r[1] or "" for r in rows if r[0] == g.doc_id}
        assert any(counts(t) == (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for t in texts)
    kept = quality_rules.kept(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(k.n_words in (7, 1, None) for k in kept) and 60 not in {k.doc_id for k in kept}
    ablation = {r.rule: r for r in quality_rules.ablation(quality_rules.ledger(spark.createDataFrame(rows, SCHEMA))).collect()}
    bits = [g.failed for g in got]
    assert all(r.n_failed == sum(b & quality_rules.BIT[k] > 0 for b in bits) and r.n_only == sum(b == quality_rules.BIT[k] for b in bits) for k, r in ablation.items())
    assert quality_rules.ledger(spark.createDataFrame([], SCHEMA)).collect() == []


def counts(t):
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", t) if x]
    lines = [x for x in t.split("\n") if __import__("re").search("[^\x20\x09-\x0d]", x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {x for x in tri if tri.count(x) > 1} if len(tri) < 500 else set()
    covered = {j for i, x in enumerate(tri) if x in twice for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    rows = [*awkward(), (70, "<|endoftext|> a<|endoftext|>", *[None] * 6)]
    library = Tokenizer.from_file(token_counts.public_path(token_counts.VOCABULARY))
    want = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    got = token_counts.token_counts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((g.doc_id is None, g.doc_id or 0, g.n_bytes, g.n_tokens) for g in got) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_merging_equals_the_library_on_any_text(texts):
    from tokenizers import Tokenizer

    path = token_counts.public_path(token_counts.VOCABULARY)
    library = Tokenizer.from_file(path)
    assert token_counts.merger(path).count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.one_of(st.text("ab", min_size=1, max_size=80), st.text("theringofa", min_size=1, max_size=300), st.text(min_size=1, max_size=40)))
def test_the_heap_equals_the_rounds(token):
    m = token_counts.merger(token_counts.public_path(token_counts.VOCABULARY))
    assert m.merge_long(token) == m.merge([token])[0]


def test_an_unbroken_megabyte_is_counted(spark):
    from tokenizers import Tokenizer

    path = token_counts.public_path(token_counts.VOCABULARY)
    r = random.Random(3)
    text = "".join(r.choice("etaoinshrdlu") for _ in range(300_000))
    start = time.time()
    got = token_counts.merger(path).count([text + text + text, text[:5000]])
    assert time.time() - start < 60
    library = Tokenizer.from_file(path)
    assert got[1] == len(library.encode(text[:5000], add_special_tokens=False).ids)
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pieces_come_back(spark):
    rows = awkward()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sentencepiece_codec.decode(sentencepiece_codec.encode(docs)).collect()
    assert len(got) == len(rows) and all(g.decoded == g.text for g in got)
    assert {g.component for g in got if g.doc_id is not None} == {"c"}
    checked = sentencepiece_codec.encode(docs, check="source").collect()
    assert all(g.source for g in checked) and [g.ids for g in checked] == [g.ids for g in got]
    assert sentencepiece_codec.encode(docs.limit(0), check="source").collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_units_give_the_best_path_of_the_whole_text(text):
    c = sentencepiece_codec.codec(sentencepiece_codec.public_path(sentencepiece_codec.MODEL))
    ids = np.frombuffer(c.encode(text), np.int32)
    assert c.decode(ids) == text
    if sentencepiece_codec.SPACE in text or not text:
        return
    framed = f" {text}"
    best = [0.0]  # plain dynamic programming over all substrings
    pieces = {v[0:0] or k: v[1] for k, v in ((key, c.automaton.get(key)) for key in c.automaton.keys())} if not hasattr(c, "_plain") else c._plain
    c._plain = pieces
    longest = max(map(len, pieces))
    for end in range(1, len(framed) + 1):
        ways = [best[s] + pieces[framed[s:end]] for s in range(max(0, end - longest), end) if framed[s:end] in pieces]
        best.append(max([*ways, best[end - 1] + c.by_bytes]))
    score, at = 0.0, {i: b for b, i in c.byte.items()}
    run = b""
    for i in [*ids.tolist(), None]:
        if i in at:
            run += bytes([at[i]])
            continue
        score += c.by_bytes * len(run.decode()) if run else 0.0
        run = b""
        score += c.scores[i] if i is not None else 0.0
    assert abs(score - best[-1]) < 1e-6 * max(1.0, abs(best[-1]))


def test_toxicity_learns_from_its_rows_only(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = words(r, 40) + (" vile scum" if bad else "") + words(r, 5)
        rows.append((i, text, *[None] * 6))
        labels.append((i, int(bad) if zlib.crc32(str(i).encode()) % 3 != 1 else int(not bad)))
    rows += [(None, "vile scum", *[None] * 6), (10_000, None, *[None] * 6), (10_001, "", *[None] * 6), rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int"))).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 for g in got)
    by = {g.doc_id: g.score for g in got}
    bad, good = [by[i] for i in range(600) if i % 4 == 0], [by[i] for i in range(600) if i % 4]
    assert np.mean([b > g for b in bad for g in good]) > 0.95
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not none.any()


def ftrl_by_hand(rows, labels, orders, alpha, beta, l1_of):
    """FTRL-proximal one coordinate at a time, as published."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1_of(i):
            return 0.0
        return -(z[i] - math.copysign(l1_of(i), z[i])) / ((beta + math.sqrt(n[i])) / alpha)

    for order in orders:
        for r in order:
            w = {i: weight(i) for i in rows[r]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - labels[r]
            for i in rows[r]:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_ftrl_equals_the_plain_updates():
    r = np.random.default_rng(3)
    rows = [np.append(np.unique(r.integers(0, 40, 8)), toxicity.BUCKETS) for _ in range(120)]
    labels = np.array([float(5 in x or r.random() < 0.1) for x in rows])
    order = np.random.default_rng(1)
    orders = [order.permutation(len(rows)) for _ in range(toxicity.EPOCHS)]
    l1 = max(toxicity.L1_LEAST, toxicity.L1_SHARE * len(rows))
    want = ftrl_by_hand([x.tolist() for x in rows], labels, orders, toxicity.ALPHA, toxicity.BETA, lambda i: 0.0 if i == toxicity.BUCKETS else l1)
    got = toxicity.ftrl(rows, labels, 1)
    assert set(np.flatnonzero(got)) == {i for i, w in want.items() if w}
    assert all(abs(got[i] - w) < 1e-9 for i, w in want.items())


def test_scaling_is_the_best_curve():
    r = np.random.default_rng(4)
    m = r.normal(size=400)
    y = (r.random(400) < 1 / (1 + np.exp(-(2.5 * m + 0.7)))).astype(float)
    a, b = toxicity.platt(m, y)
    up, down = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * m + b)))
        return -(t * np.log(p) + (1 - t) * np.log(1 - p)).sum()

    assert all(loss(a, b) <= loss(a + da, b + db) for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))
    assert toxicity.platt(m[:10], y[:10]) == (1.0, 0.0) == toxicity.platt(m, np.ones(400))


def test_toxicity_on_labels_it_has_not_seen(spark):
    folder = "/root/testdata/sf0.1"
    got = toxicity.op4_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    got = got.filter("held_out and toxic is not null").toPandas()
    y, score, predicted = got["toxic"].to_numpy(), got["score"].to_numpy(), got["predicted"].to_numpy()
    place = score.argsort().argsort()
    auc = (place[y == 1].mean() - (y.sum() - 1) / 2) / (1 - y).sum()
    assert auc > 0.95 and (predicted & y).sum() > 0.9 * predicted.sum() and (predicted & y).sum() > 0.6 * y.sum()
    empty = toxicity.score(spark.createDataFrame([], SCHEMA), np.zeros(toxicity.BUCKETS + 1, np.float32))
    assert empty.collect() == []


def reading(text):
    """Plain words, and tokens as (literal or type, value), by the rules in plain Python."""
    text = decontamination._GLUED.sub(" ", text or "")
    raw = [w.decode("utf-8", "replace") for w in text.encode("utf-8", "replace").split()]
    edge = decontamination._EDGES
    core = [w.strip(edge) or w for w in raw]
    plain, tokens, running = [c.casefold() for c in core], [], False
    for w, c in zip(raw, core, strict=True):
        low = c.casefold()
        if decontamination._NUMBER.match(c) or low in decontamination.NUMBER_WORDS:
            tokens, running = [*tokens, ("NUM", w)], False
        elif low in decontamination.UNITS:
            tokens, running = [*tokens, ("UNIT", w)], False
        elif c[:1].isupper():
            tokens = [*tokens[:-1], ("NAME", f"{tokens[-1][1]} {w}")] if running else [*tokens, ("NAME", w)]
            running = w[-1] not in edge
        else:
            tokens, running = [*tokens, (low, None)], False
    return plain, [(t, v and v.strip(edge).casefold()) for t, v in tokens]


def coverage_by_hand(doc, item, size=8):
    (dp, dt), (ip, it) = reading(doc), reading(item)
    out, k = [0.0], min(size, len(ip))
    if k:
        have = {tuple(dp[i : i + k]) for i in range(len(dp) - k + 1)}
        own = [tuple(ip[i : i + k]) for i in range(len(ip) - k + 1)]
        out.append(sum(w in have for w in own) / len(own))
    k = min(size, len(it))
    own = [i for i in range(len(it) - k + 1) if 2 * sum(v is not None for _, v in it[i : i + k]) <= k]
    if len(it) >= decontamination.MIN_TEMPLATE and own:
        diagonals = {}
        for i in own:
            for j in range(len(dt) - k + 1):
                if [t for t, _ in it[i : i + k]] == [t for t, _ in dt[j : j + k]]:
                    diagonals.setdefault(j - i, []).append(i)
        kept = {}
        for d, places in diagonals.items():
            names = {}
            for i in places:
                for p in range(i, i + k):
                    if it[p][0] == "NAME":
                        names.setdefault(it[p][1], Counter())[dt[p + d][1]] += 1
            stands = {n: max(c, key=lambda v: (c[v], v)) for n, c in names.items()}
            kept[d] = [i for i in places if all(it[p][0] != "NAME" or stands[it[p][1]] == dt[p + d][1] for p in range(i, i + k))]
        if kept:
            best = min(kept, key=lambda d: (-len(kept[d]), d))
            says = {p: dt[p + best][1] for i in kept[best] for p in range(i, i + k)}
            out.append(len({i for d, places in kept.items() for i in places if all(says.get(p, dt[p + d][1]) == dt[p + d][1] for p in range(i, i + k))}) / len(own))
    return max(out)


QUESTIONS = [
    "Yesterday Tom bought 12 apples and gave 5 of them to his friend Anna, so how many kg apples does Tom have left now?",
    "Yesterday Rose bought 12 apples and gave 5 of them to her friend Mark so how many are left",
    "A train leaves Berlin at 9 and arrives in Prague after 4 hours, how many km does it travel if it goes 80 km every hour?",
    "Mary Ann Smith pays 3 dollars for each of the 14 pens that she buys, what is the total that she has to pay at the end",
    "Tom Ann Bob Jim have 3 4 5 6 7 8 pens",
    "why is the sky blue",
    "a rare answer",
]


#: Questions that repeat numbers and names.
REPEATED = [
    "John has 3 dogs and Mary has 3 cats and each dog eats 3 cups of food a day so how many cups do the dogs of John eat",
    "A box holds 12 red pens and 12 blue pens at 12 cents for each pen so what does a full box cost in the shop",
    "Peter walks 5 km on monday and 5 km on friday and then rests for 5 days before he starts again so how far did he walk",
    "If a farm sells 20 eggs for 20 cents and a shop sells 20 eggs for twice that then what do 20 eggs cost in the shop",
    "Lena and Paul share 8 sweets and Lena gives 2 to Paul and then Paul gives 2 to Lena so who has more sweets now",
    "A bus with 30 seats takes 30 people from the station and at the next stop 10 leave and 10 enter so how many are seated",
    "Nora reads 15 pages in the morning and 15 pages in the evening of each of the 7 days in a week so how many in all",
    "There are 4 rows with 4 chairs in each and 4 people come late so how many chairs does the teacher have to add then",
    "Oscar buys 6 apples and 6 pears and eats 2 of each before he meets Clara who takes 2 of what is left for her aunt",
    "A tank loses 9 litres every hour and gains 9 litres every second hour so after how many hours has it lost 18 litres",
    "Emma is 10 years old and her brother Hugo is 10 years older so how old will Emma be when Hugo is twice 20 years old",
    "The shop has 50 shirts and sells 5 a day and after 5 days gets 25 new ones so how many shirts are there on day 5",
    "Two trains leave Paris and Rome at 7 and meet after 7 hours when one has gone 700 km so how fast was it on the way",
    "Max plants 3 trees in each of 3 gardens and waters them with 3 cans a day so how many cans does Max fill in a week",
    "A class of 24 children makes 24 cards and gives 6 to the teacher and 6 to the cook so how many cards do they keep",
    "Iris saves 2 euros a week and spends 2 euros a month so how much does Iris have after 12 months if she began with 12",
    "Each of the 11 players of a team gets 11 balls but 11 balls are lost on the way so how many balls are there at the end",
    "A rope of 40 m is cut into 4 pieces and one of the 4 pieces is cut into 4 again so how long is the shortest of them",
    "Felix runs 100 m in 14 seconds and Greta runs 100 m in 14 seconds too but Greta starts 14 m behind so who is first",
    "In a jar are 16 red and 16 green stones and Anton takes 16 out without looking so how many red ones can there be",
    "Sara bakes 5 cakes and cuts each into 8 pieces and gives 8 pieces to 5 neighbours so how many pieces does she have",
    "A train from Lyon to Nice stops 3 times for 3 minutes and drives for 3 hours so when does it arrive if it leaves at 3",
]


def changed(r, text, equal=True):
    """The question with other names of one to three words, the same ones throughout, and other numbers: the same for equal ones, or each drawn by itself."""
    new = {}
    for name in ("Tom", "Anna", "Rose", "Mark", "Berlin", "Prague", "Mary Ann Smith", *{w for q in REPEATED for w in q.split(" ")[1:] if w[0].isupper()}, "John", "Peter", "Lena", "Nora", "Oscar", "Emma", "Iris", "Felix", "Sara", "Max"):
        if re.search(rf"\b{name}\b", text):
            new[name] = " ".join(r.choice(("Ida", "Udo", "Kim", "Lea", "Ute", "Zoe")) for _ in range(r.randrange(1, 4)))
            text = re.sub(rf"\b{name}\b", new[name], text)
    numbers = {}
    return " ".join(str(numbers.setdefault(w, r.randrange(10, 99)) if equal else r.randrange(2, 99)) if w.isdigit() else w for w in text.split(" "))


def test_decontamination_equals_brute_force(spark):
    r, texts = random.Random(5), []
    for q in QUESTIONS:
        for t in (q, q.upper(), q.lower(), changed(r, q), changed(r, q), q.replace("5", "6", 1), q[: len(q) // 2], q.replace(" ", "\n")):
            texts += [t, f"{words(r, 30)} {t} {words(r, 30)}", f"We rose early to mark the papers. {t} {t}"]
    texts += [" ".join(r.choice(" ".join(QUESTIONS).split(" ")) for _ in range(40)) for _ in range(40)]
    texts += [None, "", "  ", "nothing of the kind in this text at all really", f"{words(r, 30_000)} {QUESTIONS[0]} {words(r, 30_000)}"]
    rows = [(i, t, *[None] * 6) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0], (None, QUESTIONS[0], *[None] * 6)], SCHEMA)
    items = spark.createDataFrame([*enumerate(QUESTIONS), (0, QUESTIONS[0]), (20, None), (21, ""), (None, QUESTIONS[0])], "item_id long, text string")
    want = {(i, k): c for i, t in enumerate(texts[:-1]) for k, q in enumerate(QUESTIONS) if (c := coverage_by_hand(t, q)) >= decontamination.COVERAGE}
    want[len(texts) - 1, 0] = 1.0
    for bound in (decontamination.BROADCAST_WINDOWS, 0):
        rows = decontamination.contaminated(docs, items, broadcast_windows=bound).collect()
        assert {(g.doc_id, g.item_id): g.coverage for g in rows} == want and len(rows) == len(want)
    assert decontamination.contaminated(docs, items.limit(0)).collect() == [] == decontamination.contaminated(docs.limit(0), items).collect()
    found = {i for i, _ in want}
    assert {g.doc_id for g in decontamination.clean(docs, items).collect()} == {i for i in range(len(texts)) if i not in found} | {None}


def test_copies_and_changed_questions_are_found():
    """Word for word in any case: all. With other names and numbers: nine in ten at least, of those with words enough."""
    r = random.Random(7)
    for q in QUESTIONS:
        assert all(coverage_by_hand(f"x y {t} z. We rose to mark it.", q) == 1.0 for t in (q, q.upper(), q.lower()))
    tries = [coverage_by_hand(f"{words(r, 20)} {changed(r, q)} {words(r, 20)}", q) >= decontamination.COVERAGE for q in QUESTIONS[:4] for _ in range(50)]
    assert sum(tries) >= 0.9 * len(tries)


def test_questions_with_repeated_numbers_are_found_with_numbers_drawn_independently(spark):
    r = random.Random(11)
    texts = [(k, f"{words(r, 20)} {changed(r, q, equal=False)} {words(r, 20)}") for k, q in enumerate(REPEATED) for _ in range(10)]
    docs = spark.createDataFrame([(1000 * k + i, t) for i, (k, t) in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(REPEATED)), "item_id long, text string")
    rows = decontamination.contaminated(docs, items).collect()
    assert {(g.doc_id, g.item_id): g.coverage for g in rows} == {(1000 * k + i, n): c for i, (k, t) in enumerate(texts) for n, q in enumerate(REPEATED) if (c := coverage_by_hand(t, q)) >= decontamination.COVERAGE}
    found = {g.doc_id for g in rows if g.doc_id // 1000 == g.item_id}
    assert len(found) >= 0.9 * len(texts)
    for text in ("Ida has 4 dogs and Zoe has 5 cats and each dog eats 2 cups of food a day so how many cups do the dogs of Ida eat", "A box holds 10 red pens and 15 blue pens at 20 cents for each pen so what does a full box cost in the shop"):
        assert max(coverage_by_hand(text, q) for q in REPEATED) == 1.0


def test_licenses(spark):
    notice = license_scan.TEMPLATES["mit"][0]
    changed = notice.replace("free of charge, ", "").replace("copies of the Software, and", "copies, and")
    texts = [f"{words(random.Random(1), 300)}\n{notice}\n{words(random.Random(2), 300)}", changed, "Released under the MIT License.", "the software is fine", None, ""]
    texts.append(f"{words(random.Random(4), 60_000)} {notice}")
    rows = [(i, t, *[None] * 6) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[2], (None, texts[2], *[None] * 6)], SCHEMA)
    found = license_scan.licenses(docs).collect()
    got = {(g.doc_id, g.license): g for g in found}
    assert set(got) == {(0, "mit"), (1, "mit"), (2, "mit-line"), (None, "mit-line"), (6, "mit")} and len(found) == 6
    assert got[0, "mit"].coverage == 1.0 and texts[0][got[0, "mit"].start : got[0, "mit"].end].startswith("Permission is hereby")
    assert license_scan.licenses(docs.limit(0)).collect() == []


def found_in(text):
    known = [license_scan.Template(k, *v, license_scan.COVERAGE) for k, v in license_scan.TEMPLATES.items()]
    return license_scan.scan(text, known, license_scan.COVERAGE)


def test_a_license_is_not_its_neighbour():
    for text, want in {
        "Released under the BSD License.": ["bsd-line"],
        "Released under the XYZ License.": [],
        "Licensed under CC BY 4.0.": ["cc-by-4.0-short"],
        "Licensed under CC BY-SA 4.0.": ["cc-by-sa-4.0-short"],
        "Licensed under CC BY-SA 3.0.": [],
        "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.": [],
        "This work is licensed under the GNU General Public License, version 2.": ["gpl-2.0-line"],
        "This work is licensed under the GNU Lesser General Public License, version 3.": [],
        "Licensed under the Apache License, Version 1.1.": [],
        "SPDX-License-Identifier: GPL-2.0-only": ["spdx-gpl-2.0-only"],
    }.items():
        assert [x[0] for x in found_in(text)] == want, text
    for name, (text, _) in license_scan.TEMPLATES.items():
        assert [(x[0], x[1]) for x in found_in(f"foo bar. {text} Baz qux.")] == [(name, 1.0)]


def test_every_occurrence_is_found():
    gap = words(random.Random(3), 40)
    for name, (t, _) in license_scan.TEMPLATES.items():
        for text, want in ((f"foo bar {t} {t} baz qux", 2), (f"{t}\n{gap}\n{t}\n{gap}\n{t}", 3), (" ".join([t] * 20), 20)):
            got = found_in(text)
            assert [(x[0], x[1]) for x in got] == [(name, 1.0)] * want, (name, want)
            assert [text[s:e].split() == t.rstrip(".:/").split() for *_, s, e in got] == [True] * want


def test_repeats_around_a_notice_do_not_hide_it():
    for name, (t, _) in license_scan.TEMPLATES.items():
        cut = " ".join(t.split(" ")[1:])
        for text in (f"{cut} {t} {cut}", f"{' '.join(reversed(t.split(' ')))} {t} {' '.join(sorted(t.split(' ')))}"):
            assert (name, 1.0) in [(x[0], x[1]) for x in found_in(text)], (name, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), min_size=5, max_size=9, unique=True), st.lists(st.integers(0, 8), max_size=2), st.lists(st.sampled_from("abxyz"), max_size=12), st.lists(st.sampled_from("abxyz"), max_size=12))
def test_coverage_equals_the_longest_common_subsequence(t, gone, before, after):
    """A notice with words missing, among other words: found exactly if some range of the text has the coverage."""
    left = [w for i, w in enumerate(t) if i not in gone]
    text = [*before, *left, *after]
    got = license_scan.scan(" ".join(text), [license_scan.Template("t", " ".join(t), "", 0.75)], 0.75)
    n = len(t)
    ranges = [text[i : i + n] for i in range(len(text))]
    best = max((len(license_scan.common({w: sum(1 << i for i, x in enumerate(t) if x == w) for w in t}, n, r)) for r in ranges), default=0)
    if best >= 0.75 * n:
        assert got and max(x[1] for x in got) >= best / n - 1e-9
    for _, share, s, e in got:
        span = " ".join(text)[s:e].split()
        assert round(share * n) <= len(license_scan.common({w: sum(1 << i for i, x in enumerate(t) if x == w) for w in t}, n, span))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=14), st.lists(st.sampled_from("abcdefgh"), max_size=14))
def test_alignment_is_increasing_and_of_equal_words(a, b):
    pairs = license_scan.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcde"), max_size=12))
def test_common_words_are_the_most(a, b):
    pairs = license_scan.common({w: sum(1 << i for i, x in enumerate(a) if x == w) for w in a}, len(a), b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert len(pairs) == best[-1][-1]


@given(st.lists(st.integers(0, 30), max_size=12))
def test_increasing_runs_are_longest(values):
    run = license_scan.increasing(values)
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] = 1 + max([best[j] for j in range(i) if values[j] < values[i]], default=0)
    assert len(run) == max(best, default=0) and all(values[x] < values[y] for x, y in zip(run, run[1:], strict=False))


def test_preference_pairs(spark):
    chosen = [("system", "s"), ("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", None)]
    rejected = [("system", "s"), ("user", "q"), ("assistant", "bad")]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(chosen)]
    other = [(1, i, r, t) for i, (r, t) in enumerate(rejected)]
    schema = "conv_id long, turn int, role string, text string"
    a, b = (chat_format.conversations_of(spark.createDataFrame([*x, (None, 0, "user", "x"), (2, 0, None, None)], schema)).withColumnRenamed("turns", n) for x, n in ((rows, "chosen"), (other, "rejected")))
    got = {g.conv_id: g for g in chat_format.preference_rows(a.join(b, "conv_id")).collect()}
    g = got[1]
    assert g.n_common == 2 and g.prompt == "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n"
    assert [g.rejected_completion[s.start : s.end] for s in g.rejected_spans] == ["bad<|end|>\n"]
    assert [g.chosen_completion[s.start : s.end] for s in g.chosen_spans] == ["good<|end|>\n", "<|end|>\n"]
    assert got[2].n_common == 1 and got[2].chosen_completion == "" and got[2].chosen_spans == []
    assert chat_format.swapped_replies(spark.createDataFrame([], schema)).collect() == []


def test_every_conversation_gives_a_pair(spark):
    schema = "conv_id long, turn int, role string, text string"

    def pairs(ids):
        rows = [x for i in ids for x in ((i, 0, "user", "q"), (i, 1, "assistant", f"r{i}"))]
        df = spark.createDataFrame([*rows, (7, 0, "user", "no reply"), (None, 0, "assistant", "x")], schema)
        got = chat_format.swapped_replies(df).collect()
        assert all(g.chosen[1].text == f"r{g.conv_id}" for g in got)
        assert len(got) == len({g.conv_id for g in got})
        return {g.conv_id: g.rejected[1].text for g in got}

    sparse = [i * 1_000_003 - 2**40 for i in range(1500)]
    for ids in (range(10, 1036), [-5, *range(1024, 1030)], [3, 5000], [0, 1, 5000, 9000, 9001, -(2**62), 2**62], sparse):
        got = pairs(ids)
        order = sorted(ids)
        assert got == {i: f"r{j}" for i, j in zip(order, order[1:] + order[:1], strict=True)}
    assert pairs([5]) == {} == pairs([])


def test_preference_pairs_equal_the_sql(spark, tmp_path):
    import duckdb

    long = words(random.Random(2), 50_000)
    rows = [(i, k, "assistant" if k % 2 else "user", f"t{i} {k % 3}") for i in (0, 3, 4, 10**9, -7) for k in range(i % 5 + 1)]
    rows += [rows[1], (3, 0, None, None), (3, 1, "assistant", long), (None, 0, "user", "x"), (4, None, "assistant", "no turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("n_common", F.lit("clash"))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = c.sql(chat_format.OP6_SQL)
    got = chat_format.op6_preference_format(spark, str(tmp_path)).select(*found.columns).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall()) and len(got) > 2


def test_short_notices_and_titles():
    known = [license_scan.Template(k, *v, license_scan.COVERAGE) for k, v in license_scan.TEMPLATES.items()]
    cases = {
        "Released under the Modified MIT License.": [], "Released under the MIT License.": ["mit-line"], "The MIT License (MIT)": ["mit-title"], "Licensed under Apache License 2.0": ["apache-2.0-name"],
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": ["gpl-3.0-title"], "GNU GENERAL PUBLIC LICENSE Version 2, June 1991": ["gpl-2.0-title"], "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": ["lgpl-3.0-title"],
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007": ["agpl-3.0-title"], "SPDX-License-Identifier: GPL-2.0": ["spdx-gpl-2.0"], "SPDX-License-Identifier: GPL-2.0+": ["spdx-gpl-2.0"], "SPDX-License-Identifier: GPL-2.0-only": ["spdx-gpl-2.0-only"],
    }
    for text, want in cases.items():
        assert [name for name, *_ in license_scan.scan(f"some words {text} and others", known, license_scan.COVERAGE)] == want, text


def test_window_hashes_tell_windows_apart():
    """Equal windows have equal hashes wherever they stand, also beyond a piece of powers, and windows that differ have others."""
    rng = random.Random(11)
    for size in (1, 3, 8):
        h = np.array([rng.choice((3, 5, 1 << 62, (1 << 63) + 16)) for _ in range(40_000)], np.uint64)
        got = decontamination._window_hashes(h, size)
        told = {}
        for i in range(len(h) - size + 1):
            assert told.setdefault(tuple(h[i : i + size].tolist()), int(got[i])) == got[i]
        assert len(set(told.values())) == len(told)
    wanted = decontamination.Wanted(np.unique(got[:50]))
    assert wanted.places(got).tolist() == np.flatnonzero(np.isin(got, got[:50])).tolist()
    assert len(decontamination.Wanted(np.array([], np.uint64)).places(got)) == 0

"""The pipeline against a plain Python version of its stages."""

import random

import corpus_pipeline
from courierlens.llm import line_dedup
from tests.llm.corpus import words
from tests.llm.test_copies import components_by_hand, lines_by_hand
from tests.llm.test_texts import counts


def test_pipeline_equals_brute_force(spark, tmp_path):
    r, rows = random.Random(11), []
    items = [words(r, 25) for _ in range(3)]
    for i in range(50):
        lines = [words(r, 30) for _ in range(3)]
        if i % 7 == 0:
            lines[1] = f"{lines[1]} {items[i % 3]} {words(r, 5)}"
        if i % 9 == 0:
            lines = lines[:1]
        if i % 5 == 0 and rows:
            w = [x for x in rows[-1][1].split("\n")]
            lines = w if i % 10 else [f"{x} {words(r, 1)} {words(r, 1)} {words(r, 1)} {words(r, 1)} {words(r, 1)} {words(r, 1)}" for x in w]
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}", None))
    rows += [(90, None, "en", "s", None), (91, "", "en", "s", None), (92, " ".join(["a b c"] * 40), "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def passes(t):
        n, chars, symbols, dup, rep = counts(t or "")
        lines = [x for x in (t or "").split("\n") if x.strip()]
        return not (n < 50 or 100 * rep > 50 * n or 10 * symbols > n or (dup >= 3 and 100 * dup > 30 * len(lines)) or chars < 2 * n or chars > 12 * n)

    left = [x for x in rows if passes(x[1])]
    gone = lines_by_hand(left, line_dedup.NUM, line_dedup.DEN)
    cut = [(x[0], "\n".join(s for k, s in enumerate(x[1].split("\n")) if (x[0], k) not in gone)) for x in left]
    cut = [x for x in cut if x[1].strip()]
    parts = components_by_hand(cut, 5, 80, 100)
    single = [x for x in cut if parts[x[0]] == x[0]]
    want = {x[0] for x in single if not any(i in x[1] for i in items)}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {g.doc_id for g in got} == want and len(got) == len(want) and len(want) > 10
    assert all(g.round_trip and g.n_pieces == len(g.ids) for g in got)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Null ids, nulls in other columns, repeated rows, a very long text, further columns, and no rows at all."""
    r = random.Random(13)
    schema = "doc_id long, text string, lang string, source string, n_chars long, rep long, removed string"
    text, long = words(r, 80), "\n".join(words(r, 40) for _ in range(600))
    rows = [(1, text, "en", "s", 3, 1, "x"), (1, text, "en", "s", 3, 1, "x"), (2, long, None, None, None, None, None), (None, words(r, 70), "en", "s", 1, 1, "x"), (3, None, None, None, None, None, None), (4, "", "", "", 0, 0, "")]
    items = spark.createDataFrame([(None, None), (1, "")], "item_id long, text string")
    for name, docs in (("some", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
        items.write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert sorted(str(g.doc_id) for g in got) == (["1", "1", "2", "None"] if docs else [])
        assert all(g.round_trip for g in got)
    docs = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{tmp_path}/some")
        assert out.columns == docs.columns and {x.removed for x in out.collect()} <= {"x", "", None}

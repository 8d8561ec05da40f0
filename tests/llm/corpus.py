"""Small corpora for the tests: awkward rows, and copies of every kind."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, component string, ids string"


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdeilnorst") for _ in range(r.randrange(2, 8))) for _ in range(n))


def awkward() -> list[tuple]:
    """Nulls, empty, blank, one word, repeated rows, odd characters, one long text; with extra columns of clashing names."""
    texts = [None, "", "  \t\n ", "word", "Word", "a b c", "a b c", "x" * 5000, "ÄÖ ß ñ 日本 ▁▁ \x00   é", "\n\n\n", "the the the the", "1 2 3 4 5 6 7 8 9"]
    rows = [(i, t, "en", "s", None if t is None else len(t), 7, "c", "i") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "a b c", None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (50, words(random.Random(5), 20000), "en", "s", 1, 1, "c", "i")]


def copies(seed: int = 1) -> list[tuple]:
    """Plain texts, exact copies, and copies with one to twelve words changed."""
    r, out = random.Random(seed), []
    for _ in range(25):
        base = words(r, r.randrange(5, 200)).split(" ")
        out.append(" ".join(base))
        for _ in range(r.randrange(0, 6)):
            other = list(base)
            for _ in range(r.randrange(0, 12)):
                other[r.randrange(len(other))] = words(r, 1)
            out.append(" ".join(other))
    r.shuffle(out)
    return [(100 + i, t, "en", "s", len(t), 0, "c", "i") for i, t in enumerate(out)]

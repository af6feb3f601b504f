import random

import pytest

#: Columns that operators use inside under names of their own, and a text column of another kind.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, `key` string, n int, score string, s string, weight double, mix_tokens string, train int, y int"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, ids=None, sources=None, langs=None):
        rows = [(i if ids is None else ids[i], t, langs[i] if langs else "en", sources[i] if sources else "a", len(t) if t is not None else None, "k", 1, "x", "z", 0.5, "m", 7, 3) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def edge(docs_of):
    """Nulls in every column, empty and blank texts, a very long text, ties and repeated rows."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    texts = [None, "", "   \n\t ", long, "a b c d e f", "a b c d e f", "a b c d e f", "one", "x" * 300_000, "é ü 　 z\n\n q", "same", "same"]
    ids = [0, 1, 2, 3, 4, 5, 5, None, 8, 9, 10, 10]
    return docs_of(texts, ids, [None, "a", "b", "a", "a", "a", "a", "c", "a", "a", "b", "b"], [None, "en", "en", "de", "en", "en", "en", "en", "en", "fr", "en", "en"])


@pytest.fixture(scope="session")
def none(docs_of):
    return docs_of(["x"]).limit(0)


@pytest.fixture(scope="session")
def prose():
    """Random texts with copies, near copies and shared passages."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 7)))
    vocabulary = [word() for _ in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = []
    for i in range(140):
        t = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120)))
        if i % 7 == 0:
            t = f"{t} {passage}"
        if i % 5 == 0 and texts:
            words = rng.choice(texts).split()
            for _ in range(max(1, len(words) // rng.choice((15, 40, 200)))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            t = " ".join(words)
        if i % 11 == 0 and texts:
            t = rng.choice(texts).upper()
        texts.append(t)
    return texts

import random

import pytest

WORDS = "amber basin cedar delta ember fjord grove haven inlet jetty knoll larch marsh north ocean pines quarry ridge slope tower urban valley wharf yield zonal".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_shingles string, `_x` int, ids array<int>"


def prose(seed: int, words: int = 120) -> str:
    r = random.Random(seed)
    made = ["".join(r.sample("abcdefghiklmnoprstuvw", r.randrange(3, 8))) for _ in range(words)]
    return " ".join(w + (".\n" if k % 12 == 11 else "") for k, w in enumerate(made)).strip()


def rows(texts):
    """texts: (doc_id, text) or (doc_id, text, lang, source); with further columns whose names clash with those of results."""
    out = []
    for t in texts:
        doc_id, text, lang, source = (*t, "en", "s0")[:4] if len(t) == 2 else t
        out.append((doc_id, text, lang, source, None if text is None else len(text), "other", 7, [1]))
    return out


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts: spark.createDataFrame(rows(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd():
    """Null, empty, blank, repeated and very long texts, null ids."""
    long_text = prose(99, 6000)
    return [(1, None), (2, ""), (3, " \n\t\n"), (4, prose(4)), (4, prose(4)), (5, prose(4)), (None, prose(7)), (6, long_text), (7, "a" * 20000), (8, "word"), (9, "Ünïcödé ☃ 漢字 é"), (10, None, None, None), (11, prose(11), None, None)]

import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "Epsilon", "zeta,", "eta", "theta.", "iota", "kappa", "λάμδα", "mü"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, word string, bucket long, row string, ids string"


def table(spark, texts, langs=None, sources=None, ids=None):
    """Documents with columns whose names the operators use inside."""
    rows = []
    for i, t in enumerate(texts):
        lang = langs[i] if langs else "en"
        source = sources[i] if sources else f"s{i % 3}"
        rows.append((ids[i] if ids else i, t, lang, source, len(t or ""), "b", "w", 7, "r", "x"))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def make(spark):
    return lambda *a, **b: table(spark, *a, **b)


@pytest.fixture(scope="session")
def texts():
    """Nulls, blanks, odd characters, long texts, copies, near copies and shared passages."""
    rng = random.Random(7)
    words = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))
    passage, long_ = words(60), words(4000)
    out = [None, "", " ", "\t\n", "a  b\n\n c", "x <|endoftext|> y<|startoftext|>z", "İstanbul ΣΑΣ ß ﬁ", "日本語 テスト　か", "é a ́b", "\x00\x1c tab\tq", "don't we'll I'M 'S"]
    out += ["emoji 😀👍🏽 👨‍👩‍👧", "a" * 3000, "  lead", "trail  ", "nb sp  ", "12 3,4.5 ２", "same " * 200, "same " * 200, long_, long_ + " end"]
    for i in range(30):
        body = words(rng.randint(1, 200))
        out.append(body)
        if i % 5 == 0:
            out += [body.upper(), body.swapcase(), body + " more"]
        if i % 4 == 0:
            out.append(f"{words(10)} {passage} {words(10)}")
    return out

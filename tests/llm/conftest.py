import pytest

from tracefp.llm import toxicity

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, id string, rep long, key long, at int, h1 long, line string, "
           "fp string, component string, chunk int, score double, path string, row int, _gone long, unit binary")


def document(doc_id, text, lang="en", source="src0"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", 1, 2, 3, 4, "l", "f", "c", 5, 0.5, "p/q/r", 6, 7, b"u")


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with extra columns whose names operators use inside."""
    def make(rows):
        return spark.createDataFrame([document(*r) for r in rows], COLUMNS)

    return make


WORDS = "amber birch cedar delta ember fjord grove heath inlet jetty knoll larch marsh north ocean plain quarry ridge shore thorn".split()


@pytest.fixture(scope="session")
def prose():
    """Text of n different-looking words."""
    def make(seed, n):
        out, x = [], seed * 7919 + 1
        for _ in range(n):
            x = (x * 1103515245 + 12345) % (1 << 31)
            out.append(WORDS[x >> 8 & 15] + WORDS[x >> 14 & 15] if x & 64 else WORDS[x >> 9 & 15])
        return " ".join(out)

    return make


@pytest.fixture(scope="session")
def messy(frame, prose):
    """Nulls everywhere, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(prose(k, 400) for k in range(30))
    return frame([
        (1, prose(1, 60)), (2, prose(1, 60)), (2, prose(1, 60)), (3, None), (4, ""), (5, " \n\t "), (None, prose(1, 60)), (None, None),
        (6, long), (7, long + " end"), (8, "one"), (9, "ONE"), (10, "é中　\U0001F600 \x00 <|endoftext|>"), (11, prose(2, 50), None, None),
        (11, prose(3, 50)), (12, "x" * 30000), (13, prose(1, 60) + "\n" + prose(4, 40) + "\n" + prose(4, 40)), (-5, prose(5, 3)),
    ])


@pytest.fixture(scope="session")
def quick_network():
    """A few training steps; restored afterwards."""
    was = toxicity.STEPS, toxicity.BATCH
    toxicity.STEPS, toxicity.BATCH = 60, 64
    yield
    toxicity.STEPS, toxicity.BATCH = was

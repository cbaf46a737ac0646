import pytest

#: Names that operators use for columns of their own; in the fixture they are the caller's.
OWN = "copy keep fp base n_lines c row of id s p n h m r t k x a b f at o w cdf parts salt none label node ids decoded n_tokens _parts _cdf _source _salt _s _count _text _all _chosen _blocks _candidates _base_email _kept _doc _none _id _null _hash _lines _stay _q _fp _r codes error found path leaf kids place total".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in OWN)

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


TEXTS = [
    "one two three four five six",
    "One two three four five six",
    None,
    "",
    "   \n\t ",
    "a",
    prose(60, 1) + "\n" + prose(12, 2),
    prose(60, 1) + "\n" + prose(12, 3),
    prose(60, 1) + " extra\nshort line",
    "short line\n\nshort line",
    "naïve Größe 日本語 😀 x" * 3,
    "word " * 3000,
    prose(4000, 5),
    "aaaa" * 500 + "  \r\n" + "!" * 300,
]


@pytest.fixture(scope="session")
def docs(spark):
    """Every awkward text, a repeated row, a repeated id, a null id, null columns and names that clash."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None) for i, t in enumerate(TEXTS)]
    rows += [rows[6], (7, "another text under the same id", "en", "s1", 5), (None, "no id here at all", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame([r + ("x",) * len(OWN) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)

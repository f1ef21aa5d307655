from __future__ import annotations

import pytest

#: Nulls, empty and blank texts, ties, repeated rows, long text, other scripts.
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 60), "en", "a", 1),
        (2, prose(2, 60), None, "a", 1),
        (3, None, "en", None, None),
        (4, "", "en", "a", 0),
        (5, "  \n\t ", "en", "a", 5),
        (6, "one two three", "en", "a", 13),
        (7, "one two three", "en", "a", 13),
        (8, long, "en", "a", len(long)),
        (9, "Übergrößen straße\nÜbergrößen straße\nkurz\n" + prose(3, 30), "de", "b", 9),
        (9, "Übergrößen straße\nÜbergrößen straße\nkurz\n" + prose(3, 30), "de", "b", 9),
        (10, prose(2, 59) + " other0 <|endoftext|> </s>", "en", "b", 1),
        (11, "日本語のテキスト 🎉  two  spaces \r\n\x00 end ", "ja", "b", 1),
        (None, prose(4, 40), "en", "b", 1),
        (None, None, None, None, None),
        (-5, "ÜBERGRÖßEN straße \n" + prose(5, 10), "de", "b", 1),
    ]
    # Extra columns with the names that operators use themselves.
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, part int, doc string, score double, n_lines int, component string, digest string, size int"
    return spark.createDataFrame([(*r, 1, "x", 0.5, 3, "c", "d", 9) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id = 424242")

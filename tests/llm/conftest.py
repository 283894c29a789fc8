import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string, size string"


def sample_rows():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéñßüo") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, long = text(60), text(400)
    edited = long.split()
    edited[200] = "changed"
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two words"), (6, "ONE"), (7, long), (8, long), (9, " ".join(edited)),
        (10, f"{text(30)} {passage} {text(30)}"), (11, f"{passage}\n{text(20)}"), (12, f"{text(5)} {passage}"),
        (13, "x" * 5000), (14, "spam " * 400), (15, "a a a a a a a a a a a a a a a a a a a a a a a a"),
        (16, text(3000)), (16, text(40)), (7, long), (17, "mail bob@x.example.org or 10.0.0.1, card 4111 1111 1111 1111, tel +1 (212) 555-0100"),
        (18, "line one here\n\nline one here\nline two\nline one here"), (19, "###*** $$$ %%% &&& | <b> ###"),
        (20, "ab " * 50 + "é" * 70), (21, "é" * 70 + text(10)), (None, text(30)), (None, None), (22, " nbsp em"),
    ]
    rows += [(100 + i, text(rng.randint(1, 80))) for i in range(60)]
    rows += [(200 + i, long) for i in range(8)]
    sources = ["s1", "s2", None, "S3", "é", ""]
    return [(i, t, "en", sources[k % 6] if k % 3 else "s1", None if t is None else len(t), "clash", "clash", None) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return sample_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *cols):
    """Rows as sorted tuples, null ids last."""
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda r: (r[0] is None, repr(r)))

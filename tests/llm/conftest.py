import pytest

#: Columns whose names operators use inside, to clash with them.
EXTRA = "digest string, n long, id string, band long, slot int, component string, key string"
SCHEMA = f"doc_id long, text string, lang string, source string, {EXTRA}"
CLASH = ("x", 1, "y", 2, 3, "z", "w")

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, copies and near copies."""
    a, b = prose(1, 60), prose(2, 80)
    near = a.split()
    near[30] = "changed"
    far = b.split()
    far[10:30] = ["other"] * 20
    rows = [
        (1, a), (2, a), (3, " ".join(near)), (4, b), (5, b + "\n"), (6, " ".join(far)), (7, None), (8, ""), (9, " \t\n"),
        (10, "two words"), (11, "two  words"), (12, prose(3, 5000)), (13, "x" * 100_000), (14, "é漢字 \U0001f600 <|endoftext|> 1.2.3.4 a@b.co"), (15, "12345 !!"),
        (1, a), (None, a), (None, None), (16, prose(4, 14) + " " + " ".join(a.split()[5:25]) + " " + prose(5, 14)),
    ]
    langs = ["en", "de", None]
    return [(i, t, langs[k % 3], ["s1", "s2", None][k % 3], *CLASH) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from lodestream.session import ship_package

    ship_package(spark)
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, bucket int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    """Sentences of made-up words, the same for the same seed."""
    x, out = seed * 7919 + 13, []
    for k in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        w = WORDS[(x >> 33) % len(WORDS)] + WORDS[(x >> 45) % len(WORDS)]
        end = "." if k % 9 == 8 else ""
        out.append((w.capitalize() if k % 9 == 0 else w) + end)
    return " ".join(out)


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, empty and very long texts, repeated rows, ties, odd characters, clashing columns."""
    base = prose(1, 120)
    near = base.replace("alpha", "ALPHA").replace(base.split()[60], "changed", 1)
    passage = prose(9, 80)
    rows = [
        (1, base), (2, base), (3, near), (4, ""), (5, None), (6, " \n\t "), (7, "one two"), (8, "one two"), (9, "ONE two"),
        (10, prose(3, 60) + " " + passage + " " + prose(4, 60)), (11, prose(5, 60) + "\n" + passage + "\n" + prose(6, 60)),
        (12, "Ünïcode çé 漢字 😀 \x00 a b c <|endoftext|> ▁x  y"), (13, prose(7, 30_000)), (14, "x" * 200_000),
        (15, "A!! B!! " * 300), (16, "line\nline\nline\n\nother"), (2, base), (None, base), (None, "nobody's words here at all now"), (17, "a b c d e"), (18, "### |||| $$$ %%% &&& " * 60),
    ]
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 7 else "src", None, "x", 1) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(hard):
    return hard.where(F.lit(False))

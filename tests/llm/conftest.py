import random

import pytest
from pyspark.sql import functions as F

#: Names that the operators use inside, as columns of the input.
CLASHING = ["node", "n", "part", "block", "spans", "removed", "copied", "size", "h", "d", "k", "shard", "fold", "held_out", "kept", "score", "base", "runs", "line", "digest", "best", "refers_to", "label", "rank", "hit", "item_id"]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(n))


def corpus():
    """(doc_id, text): prose, copies, near copies, shared passages, and odd rows."""
    rng = random.Random(5)
    out = [(i, words(rng, rng.randint(60, 160)) + "\n" + words(rng, 12) + "\n" + words(rng, 9)) for i in range(40)]
    passage = words(rng, 70)
    for i in range(40, 52):  # a passage of its own in other text, at other places
        out.append((i, f"{words(rng, rng.randint(1, 40))} {passage} {words(rng, rng.randint(1, 40))}"))
    for i in range(52, 60):  # exact copies
        out.append((i, out[3][1]))
    for i in range(60, 90):  # near copies of one document, and of a short one
        w = out[4][1].split(" ")
        w[rng.randrange(len(w))] = f"edit{i}"
        out.append((i, " ".join(w)))
    for i in range(90, 100):
        out.append((i, "same five words in all and then " + words(rng, i % 4)))
    block = "\n".join(words(rng, 8) for _ in range(12))
    for i in range(100, 108):
        out.append((i, f"{words(rng, 5)}\n{block}\n{words(rng, 6)}"))
    out += [(108, None), (109, ""), (110, " \t\n\v\r\f "), (111, "one"), (112, "one"), (113, "Tie tie TIE"), (114, "tie TIE tie"), (115, "éß中文 \U0001f642 x y"), (116, "a" * 900), (117, "ab" * 500), (118, words(rng, 60_000)), (None, "a row without an id " + words(rng, 20)), (119, out[0][1]), (119, out[0][1]), (-7, out[1][1])]
    return out


@pytest.fixture(scope="session")
def odd_rows():
    return corpus()


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The corpus as documents, with clashing extra columns."""
    df = spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, "src", len(t or "")) for i, t in odd_rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(c).alias(c) for c in CLASHING]).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")

import random

import pytest

from sparkalogue.llm.common import WORD  # noqa: F401

DOCS = "doc_id long, text string, lang string, extra int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """DataFrame of documents from texts, with a null, an empty and a blank text; test_edges.py has repeated rows and clashing names."""

    def make(texts, odd=True):
        rows = [(i, t, "en", 1) for i, t in enumerate(texts)]
        if odd:
            rows += [(9001, None, None, None), (9002, "", "en", 2), (9003, " \n\t ", "en", 3)]
        return spark.createDataFrame(rows, DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def texts():
    """Random prose with exact copies, near copies, shared lines and one long text."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice(["ka", "lo", "mi", "ten", "sur", "é", "ox"]) for _ in range(rng.randint(1, 5))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    made = ["\n".join(prose(rng.randint(3, 40)) for _ in range(rng.randint(1, 6))) for _ in range(30)]
    made += [made[0], made[0], made[3]]
    near = made[5].split(" ")
    if len(near) > 4:
        near[len(near) // 2] = "changed"
    made.append(" ".join(near))
    shared = prose(90)
    made += [prose(20) + "\n" + shared + "\n" + prose(15) for _ in range(3)]
    made += ["loop " * 300, prose(6000)]
    return made

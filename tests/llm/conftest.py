import random

import pytest

pytest.importorskip("queryloom.llm")


@pytest.fixture(scope="session")
def words():
    r = random.Random(5)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def corpus(words):
    """Ids and texts: copies, near copies, shared passages, nulls, empty and long texts, repeated ids."""
    r = random.Random(7)
    passage = " ".join(r.choices(words, k=70))
    rows = []
    for i in range(60):
        t = r.choices(words, k=r.choice([0, 1, 4, 12, 30, 80, 200]))
        if i % 5 == 1:
            t[len(t) // 2 : len(t) // 2] = passage.split()
        rows.append((i, r.choice([" ", "\n", "  "]).join(t)))
    base = " ".join(r.choices(words, k=120))
    rows += [(60, base), (61, base), (62, base + " tail"), (63, base.replace(base.split()[60], "changed", 1)), (64, None), (65, ""), (66, " \t\n "), (67, base), (67, base), (None, base), (None, passage)]
    rows += [(68, "x " * 4000), (69, "x " * 3000 + passage), (70, "é ü 漢字 " * 50 + passage), (71, " ".join(r.choices(words, k=20000)))]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus as a table with further columns, some with names that the operators use inside."""
    return spark.createDataFrame([(i, t, "en", 1, "m", 2) for i, t in corpus], "doc_id long, text string, lang string, doc int, marks string, `row` int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")

import random

import pytest


def edge_rows():
    """Documents with all the cases that operators should stand: null and empty texts, null ids, very long texts, ties,
    repeated rows, exact and near copies, lines and passages in common."""
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("ba", "ko", "ri", "the", "ün", "猫") for b in ("la", "mo", "si", "tu", "ne", "xi", "da")]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "a"), (None, "a null id has a text"), (4, "x" * 90_000), (5, "ab" * 2_000 + " tail")]
    base = [line(14) for _ in range(9)]
    rows += [(10 + i, "\n".join(base)) for i in range(4)]
    for i in range(12):
        near = "\n".join(base).split(" ")
        near[rng.randrange(len(near))] = "edit"
        rows.append((20 + i, " ".join(near)))
    passage = line(70)
    shared = [line(9) for _ in range(4)]
    for i in range(15):
        rows.append((40 + i, "\n".join([line(20), passage, line(30), *shared, line(12)])))
    rows += [(60 + i, "\n".join(line(25) for _ in range(rng.randrange(1, 12)))) for i in range(15)]
    rows += [(80, "home | about | contact | " * 30), (81, "BUY NOW!! CHEAP PILLS!! " * 25), (82, "\n".join(["Same line again and again here."] * 30)), (83, "word " * 400)]
    rows += [(84, "Released under the MIT License.\n" + "\n".join(line(20) for _ in range(6)))]
    rows += [rows[12], rows[30], rows[0]]  # repeated rows
    return rows


@pytest.fixture(scope="session")
def rows():
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The documents, with columns whose names clash with those that operators make."""
    langs = ["en", "de", None, "xx"]
    full = [(i, x, langs[k % 4], "hot" if k % 3 else f"s{k}", None if x is None else len(x), "clash", 1.5, [1]) for k, (i, x) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, class_id string, weight double, removed_lines array<int>").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)

import random

import pytest

SF = "/root/testdata/sf0.001"

#: Column names that operators use inside; they must not clash.
CLASHING = ["id", "ord", "row", "key", "size", "name", "n", "bucket", "w", "uid", "doc", "start", "spans", "cid", "held_out", "n_tokens"]


def words(rnd, n, vocabulary=300):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def edge_rows():
    """(doc_id, text): nulls, blanks, ties, copies, near copies, very long and repeated text, odd characters."""
    rnd = random.Random(5)
    base = words(rnd, 120)
    near = base.split()
    near[60] = "changed"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One  two\tthree"), (6, base), (7, base), (8, " ".join(near)), (9, base.upper()), (10, words(rnd, 30_000)), (11, "ab " * 400), (12, "é ß İ Σς 日本語 \u0301 ﬁ <|endoftext|> <s> ▁x"), (13, "\x00\x1c a\x85b\u3000c"), (14, base + " tail " + base)]
    rows += [(20 + i, words(rnd, 40) + " " + base[:250]) for i in range(6)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, *range(len(CLASHING))) for i, t in edge_rows()]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"{c} int" for c in CLASHING)])).repartition(3)


@pytest.fixture(scope="session")
def repeated(spark):
    """Repeated rows, repeated ids with other texts, null ids."""
    rnd = random.Random(6)
    t, u = words(rnd, 50), words(rnd, 50)
    return spark.createDataFrame([(1, t), (1, t), (1, u), (2, u), (None, t), (None, None), (3, None)], "doc_id long, text string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def table_rows(spark, name, columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]

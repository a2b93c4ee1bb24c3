import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Columns that operators use inside, added to the documents under these names.
CLASHING = ("_h", "h", "id", "k", "n", "o", "size", "score", "shard", "slot", "part", "copies", "maybe", "_maybe", "_key", "_score", "grams", "start", "_id")


def _rows(seed=3):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, base = say(60), say(150).split(" ")
    rows, nth = [], 0

    def add(text, source="a", id_=True, lang="en"):
        nonlocal nth
        rows.append((nth if id_ else None, text, lang, source, None if text is None else len(text)))
        nth += 1

    for text in (None, "", " ", "\n\t \n", "one", "one two", "one two three", "ONE two three", "é ü 漢字 🙂", "a<|endoftext|>b  c"):
        add(text)
    for i in range(40):
        add(say(r.randint(1, 120)), r.choice(["a", "b", "b", None]))
    for i in range(30):  # near copies
        words = list(base)
        for _ in range(i % 4):
            words[r.randrange(len(words))] = say(1)
        add(" ".join(words), "b")
    for i in range(12):  # a passage in common
        add(say(r.randint(5, 40)) + "\n" + passage + "  " + say(r.randint(5, 40)), None)
    for i in range(10):  # copies
        add(rows[20][1], "c", lang=None)
    for i in range(4):  # without an id
        add(say(30), "a", id_=False)
    add(passage, "b", id_=False)
    add(say(30_000), "b")
    add("x" * 200_000, "c")
    rows += [rows[25], rows[25], rows[60]]  # repeated rows
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return _rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """Documents with every odd case and columns whose names clash, read from Parquet."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df = df.withColumns({c: F.lit(c) for c in CLASHING})
    path = str(tmp_path_factory.mktemp("docs"))
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)

"""Small documents with nulls, empty and long texts, ties, repeated rows and columns whose names clash with results."""

import random

import pytest

SCHEMA = "doc_id long,text string,lang string,source string,n_chars long,fp long,prefix string,spans string,keep_id string,score string"


def made(rows):
    return [(i, t, lang, "s", 0 if t is None else len(t), 1, "p", "x", "k", "q") for i, t, lang in rows]


@pytest.fixture(scope="session")
def rows():
    r = random.Random(4)
    word = lambda: "".join(r.choice(["an", "er", "ti", "lo", "ñe", "ra", "st"]) for _ in range(r.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    out = [(k, text(r.randint(5, 120)), "en") for k in range(60)]
    long = text(30_000)
    out += [(60, None, "en"), (61, "", None), (62, " \n\t", "fr"), (None, out[3][1], "fr"), (None, None, None), (63, long, "de"), (64, long + " end", "de"), (65, long.upper().replace("Ñ", "ñ"), "de")]
    out += [(66 + k, out[k % 3][1], "en") for k in range(12)]  # copies, and near copies of a longer text
    near = text(400).split()
    for k in range(8):
        copy = list(near)
        copy[k * 7] = "changed"
        out.append((80 + k, " ".join(copy), "en"))
    out += [(5, out[5][1], "en"), (5, out[5][1], "en"), (7, out[9][1], "en")]  # repeated rows, and a repeated id
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(made(rows), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag string, count long, id string"


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def rows():
    """Documents with every awkward case: nulls, empties, copies, near copies, a long text, shared passages, clashing columns."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    passage = sentence(rng, words, 60)
    out = []
    for i in range(60):
        text = sentence(rng, words, rng.randint(1, 90))
        if i % 6 == 0:
            text = sentence(rng, words, 20) + " " + passage + "\n" + sentence(rng, words, 15)
        if i % 7 == 0:
            text = text.replace(" ", "\n", 3) + "\nthe same line again\nthe same line again"
        out.append(text)
    out += [out[3]] * 5 + [out[8].upper(), out[8] + " more", " ".join(out[10].split()[:-1] + ["changed"])]
    long = sentence(rng, words, 6000)
    out += [long, long + " tail", None, None, "", "   \n\t ", "one", "two words", "Ärger über Größe im Straßencafé €5 ½", passage]
    out += ["spam spam " * 50, "a b c d e " * 10 + "x", "#### $$$$ %%%% &&&& |||| <<<< >>>> **** #### $$$$ %%%% &&&&"]
    langs, sources = ["en", "de", None, "fr"], ["src0", "src0", "src1", None, "odd"]
    return [(i, t, langs[i % 4], sources[i % 5], len(t or ""), "x", 1, "y") for i, t in enumerate(out)]


@pytest.fixture(scope="session")
def doc_rows():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

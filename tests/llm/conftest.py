import random

import pytest

#: Columns with names that operators might use inside, beside those they are given.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, n long, node long, item string, pos int, size string, copies int, n_words string, gone string, words string, c0 int, label string, score string, _id int, _size int, copy_no int, n_deleted int, n_lines int, `meta.url` string, odd struct<`a b`: int>"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def collection(seed=5):
    """Documents with copies, near copies, shared passages, repeated lines, odd white space, nulls and ties."""
    rng = random.Random(seed)
    texts = [None, "", "  \n\t ", "one", "one two three four", "One TWO three four", "é ü ß  x", "same line of five words\nsame line of five words"]
    bases = ["\n".join(sentence(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 8))) for _ in range(8)]
    passage = sentence(rng, 55)
    for b in bases:
        w = b.split(" ")
        for _ in range(4):
            v = list(w)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                v[rng.randrange(len(v))] = sentence(rng, 1)
            texts.append(" ".join(v))
        texts.append(b + "\n" + passage)
        texts.append(b.upper())
    texts += [sentence(rng, 25) + "\n" + passage for _ in range(4)] + ["go " * 60, sentence(rng, 4000), "tie tie tie tie tie tie"] * 2
    return [(i * 3, t, rng.choice(["en", None]), rng.choice(["s1", "s2", "s10", None]), None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return collection()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3, "y", 4, "z", "g", "w", 5, "l", "s", 6, 7, 8, 9, 10, "u", (11,)) for r in rows], CLASH).repartition(5)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 0) -> list[tuple]:
    """Texts with copies, near copies, shared passages, odd bytes, nulls, empty and long ones."""
    pick = random.Random(seed)
    vocabulary = ["".join(pick.choice("abcdeé") for _ in range(pick.randint(1, 7))) for _ in range(300)]
    line = lambda n: " ".join(pick.choice(vocabulary) for _ in range(n))
    passage = "\n".join(line(12) for _ in range(6))
    texts: list[str | None] = [None, "", " \n\t ", "one", "Two words", "ONE", "a\x0bb\x0cc\rd  e", "日本 語 😀 " * 9, "x" * 700, "ab" * 300, "\n\n", "end\n"]
    for i in range(30):
        text = "\n".join(line(pick.randint(3, 25)) for _ in range(pick.randint(1, 9)))
        texts.append(text)
        if i % 3 == 0:
            texts.append(text)
        if i % 4 == 0:
            words = text.split(" ")
            words[len(words) // 2] = "changed"
            texts.append(" ".join(words))
        if i % 5 == 0:
            texts.append(line(8) + "\n" + passage + "\n" + text[: len(text) // 2])
    texts.append("\n".join(line(20) for _ in range(400)))
    base = line(120).split(" ")
    for _ in range(25):  # many near copies of one text
        words = list(base)
        for _ in range(pick.randint(0, 6)):
            words[pick.randrange(len(words))] = pick.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [line(40)] * 12
    sources = [None, "src0", "src1", "é", "Z"]
    return [(i, t, "en", sources[0 if i % 11 == 0 else 1 + (i * i) % 4], None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """No ids, repeated rows, and columns named like those of the operators."""
    names = "DOC_KEY string, text string, doc_id long, size int, kept string, Digest string, node int, n_words string, row int, source string, marks int, n int, lang string, n_chars long"
    row = ("k", "some words that come twice\nand a second line of words\nand a third", None, 1, "k", "d", 2, "w", 3, None, 4, 5, "en", 7)
    other = ("k", None, 5, 1, None, "d", 2, "w", 3, "s", 4, 5, None, None)
    return spark.createDataFrame([row, row, other, other, (*row[:2], 9, *row[3:])], names)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

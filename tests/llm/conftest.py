from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def lower_az(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def odd_texts() -> list[str | None]:
    """Empty, blank, very long and repeated texts, odd white space, letters of many scripts."""
    return [
        None, "", " ", "\n", "\n\n \t\n", "a", "A b", "x" * 40_000, "w " * 30_000, "\x0b\x0cmit\x1clicense\x85MIT License", "É é ß İ ı Σ ς Kelvin K",
        "日本語 のテキスト です", "🙂🙂 emoji 🙂", "MIT License mit license\nMIT  LICENSE", "general public license", "tab\tand\rreturn\r\nline",
        "password = hunter2222 TOKEN:'abcdef' api-key=zz secret=12345", "AKIA" + "B" * 16 + " AKIAAKIA " + "0123456789abcdef" * 2, "é password: ûabcdef token=ABCDEFG",
    ]


def prose(rng: random.Random, n: int, words: list[str]) -> str:
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """Rows of documents: prose, copies, near copies, shared lines and passages, and all odd texts, null ids among them."""
    rng = random.Random(11)
    words = ["".join(rng.choice(["an", "the", "ou", "ti", "er", "é", "sh"]) for _ in range(rng.randrange(1, 4))).capitalize() if rng.random() < 0.1 else "".join(rng.choice("abcdeéü") for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    texts: list[str | None] = [prose(rng, rng.randrange(1, 400), words) for _ in range(120)]
    passage = prose(rng, 60, words).replace("\n", " ")
    for i in range(0, 30, 3):
        texts[i] = texts[i] + "\nShared LINE of many  \n" + (passage if i % 2 else "") + " " + texts[i + 1][:50]
    for i in range(40, 50):
        texts.append("  shared line of many\n" + texts[i])
        texts.append(texts[i])
        w = texts[i].split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += odd_texts() + odd_texts()
    rows = []
    for i, t in enumerate(texts):
        rows.append((i if i % 41 else None, t, rng.choice(["en", "fr", "de", None]), rng.choice(["a", "b", None]), None if t is None else len(t)))
    return rows + rows[-3:]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

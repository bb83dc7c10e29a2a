"""Small corpora with the odd cases: nulls, empty, long, repeated and clashing."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " \
         "score double, spans string, hits string"


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    words = [f"{'abcdefghij'[i % 10]}{i}{'é' * (i % 3 == 0)}" for i in range(vocabulary)]
    out = []
    for _ in range(n):
        out.append(rng.choice(words))
        if rng.random() < 0.08:
            out[-1] += ".\n"
    return " ".join(out)


def texts(seed: int = 5) -> list[str | None]:
    """Prose with shared passages, near and exact copies, junk and odd texts."""
    rng = random.Random(seed)
    passage, second = prose(rng, 60), prose(rng, 130)
    out: list[str | None] = [None, "", " \n\t ", "a", "one two three"]
    for _ in range(20):
        out.append(f"{prose(rng, rng.randint(5, 200))} {passage} {prose(rng, rng.randint(1, 60))}")
    for _ in range(12):
        base = f"{prose(rng, 80)} {second[rng.randint(0, 80):]} {prose(rng, 50)}"
        near = base.split(" ")
        near[rng.randrange(len(near))] = "changed"
        out += [base, base, " ".join(near)]
    out += [prose(rng, 6000), "ab " * 700, "x" * 3000, "é" * 900,
            "same line again\n" * 40, f"{passage} {passage}"]
    out += [prose(rng, rng.randint(20, 120)) for _ in range(30)]
    return out


def documents(spark, rows: list[tuple] | None = None, seed: int = 5):
    """A documents table with columns whose names operators use themselves."""
    if rows is None:
        found = texts(seed)
        rows = list(enumerate(found)) + [(7, found[7]), (None, found[8]), (None, None),
                                         (9, None), (9, found[30])]
    full = [(i, t, "en", "src0", len(t or ""), 0.5, "x", "y") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df, *columns: str) -> list:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)

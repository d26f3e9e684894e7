"""Small tables with nulls, empty and long texts, ties, repeats and clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, component string, rank string, key string"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def documents(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = []
    base = prose(rng, 120)
    for i in range(n):
        if i % 10 == 0:
            text = base  # exact copies
        elif i % 10 == 1:
            w = base.split()
            for _ in range(rng.randrange(1, 6)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(99)}"
            text = " ".join(w)  # near copies
        elif i % 10 == 2:
            text = rng.choice([None, "", " \n\t", "one", "Two words", "Two words"])
        elif i == 3:
            text = prose(rng, 30_000)
        else:
            text = "\n".join(prose(rng, rng.randrange(5, 60)) for _ in range(3))
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s2", None]), len(text or ""), "x", "x", "x", "x"))
    rows.append((None, "text without an id here now", "en", None, 27, "x", "x", "x", "x"))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

"""Toxicity, vector codes and infilling against plain loops, held-out rows and exact round trips."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import SCHEMA, documents, empty, prose
from tidemark.llm import codes, infill, toxicity
from tidemark.llm.text import chunks

# --- Toxicity


def plain_features(text):
    """Words, stems and pairs as strings."""
    words = [w for w in re.split(rb"[^0-9a-z\x80-\xff]+", text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))) if w]
    found = {(w,) for w in words} | {(w[:n],) for w in words for n in toxicity.STEMS if len(w) > n}
    return found | {(a, b, 1) for a, b in zip(words, words[1:], strict=False)} | {(a, b, 2) for a, b in zip(words, words[2:], strict=False)}


@pytest.mark.parametrize("text", ["", " .,!", "One", "one ONE, one-two", "héllo wörld the quick. Brown\nfox jumps", "ab " * 500, "a b a b c"])
def test_features_are_the_words_and_pairs(text):
    """As many as the distinct words, stems and pairs (40 bits: none collide); texts beside it have no say."""
    alone, offsets = toxicity.features(next(chunks(pa.array([text]))), 40)
    assert len(alone) == len(plain_features(text)) == offsets[1]
    both, at = toxicity.features(next(chunks(pa.array(["before it", text, "after it"]))), 40)
    assert both[at[1] : at[2]].tolist() == alone.tolist()


def test_update_is_the_published_rule():
    """Against the per-coordinate rule, written with scalars."""
    rng = random.Random(3)
    state = toxicity.Ftrl.begun(np.ones(9, bool), alpha=0.5, l1=0.3, l2=0.2)
    z, n = [0.0] * 9, [0.0] * 9
    for _ in range(200):
        own, label = sorted(rng.sample(range(8), 3)), rng.randrange(2)
        w = {}
        for i in [*own, 8]:
            held = abs(z[i]) if i == 8 else max(abs(z[i]) - 0.3, 0.0)
            w[i] = -math.copysign(held, z[i]) / ((1.0 + math.sqrt(n[i])) / 0.5 + 0.2)
        p = 1 / (1 + math.exp(-sum(w.values())))
        for i in w:
            g = p - label
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5 * w[i]
            n[i] += g * g
        assert state.update(np.array(own), label) == pytest.approx(p, abs=1e-12)
    assert state.z.tolist() == pytest.approx(z) and state.n.tolist() == pytest.approx(n)


def corpus(spark, n=700, seed=5):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words, bad = prose(rng, rng.choice([20, 80, 300, 900]), 3000).split(), rng.random() < 0.2
        for _ in range(rng.randrange(2, 6) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Vile", "rotten,", "foulmouth", "FOULMOUTHED"]))
        rows.append((i, " ".join(words), "en", "s", 0, "x", "x", "x", "x"))
        if i % 10:
            labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    weights = toxicity.learn(docs, labels)
    assert 0 < len(weights.index) < 2000 and np.all(weights.weight != 0)
    got = toxicity.with_toxicity(docs.withColumn("score", F.lit("clash")), weights)
    assert got.columns == docs.columns + ["score"]
    told = {r["doc_id"]: r["score"] for r in got.collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    right = sum((told[r["doc_id"]] >= toxicity.THRESHOLD) == (r["toxic"] == 1) for r in held)
    assert right / len(held) >= 0.97
    again = toxicity.learn(docs.repartition(2), labels.repartition(3))
    assert again.index.tolist() == weights.index.tolist() and again.weight.tolist() == weights.weight.tolist() and again.intercept == weights.intercept


def test_toxicity_of_odd_rows(spark):
    docs, labels = corpus(spark, 120)
    weights = toxicity.learn(docs, labels)
    rows = [(1, None, *[None] * 7), (1, "", *[None] * 7), (None, "?!", *[None] * 7), (2, "vile " * 200_000, *[None] * 7), (2, "vile", *[None] * 7)]
    got = toxicity.with_toxicity(spark.createDataFrame(rows, SCHEMA), weights).collect()
    base = 1 / (1 + math.exp(-weights.intercept))
    assert [r["score"] for r in got[:3]] == pytest.approx([base] * 3) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.with_toxicity(empty(spark), weights).count() == 0
    none = toxicity.learn(docs, labels.limit(0))
    assert len(none.index) == 0 and none.intercept == 0.0


def test_toxicity_sample_is_bounded(spark):
    """An id a thousand times is one row, and a sample keeps its size."""
    docs, labels = corpus(spark, 60)
    many = docs.unionByName(spark.range(1000).select(F.lit(2).cast("long").alias("doc_id"), F.concat(F.lit("copy "), F.col("id")).alias("text"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema[2:])))
    seen = []

    def fit(labelled, **_):
        seen.append(labelled.collect())

    keep, toxicity.fit = toxicity.fit, fit
    try:
        toxicity.learn(many, labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 1), (3, 1, None)], labels.schema)))
        toxicity.learn(many, labels, sample=7)
    finally:
        toxicity.fit = keep
    assert len(seen[0]) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(60) if i % 10) and len(seen[1]) == 7


# --- Vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """The contract with Python's integers."""
    kept = sorted(((i is None, i or 0), [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in kept]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def far(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assigned():
        return [[min((far(v[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for v in cut]

    for _ in range(rounds):
        now = assigned()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p] for v, a in zip(cut, now, strict=True) if a[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    told = [("".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a)) for a in assigned()]
    return [i for i, _ in kept], told, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


VECTORS = "vec_id long, embedding array<double>, label int, code string, error string, vector string"


def vectors(spark, n, dims, seed, coarse):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.randrange(-3, 4) / 256 if coarse else rng.gauss(0, 1) for _ in range(dims)]
        rows.append((i * 3, v, rng.choice([0, 1, None]), "x", "x", "x"))
    rows += [(1, None, 0, "x", "x", "x"), (2, [float("nan")] * dims, 0, "x", "x", "x"), (4, [None] * dims, 0, "x", "x", "x"), (5, [math.inf] * dims, 0, "x", "x", "x"), (7, [], 0, "x", "x", "x"), (9, rows[0][1], 1, "x", "x", "x"), (9, rows[5][1], 1, "x", "x", "x"), (None, rows[3][1], None, "x", "x", "x")]
    return rows, spark.createDataFrame(rows, VECTORS).repartition(4)


@pytest.mark.parametrize(("n", "dims", "coarse"), [(300, 32, False), (300, 16, True), (20, 48, False)])
def test_codes_against_plain_integers(spark, n, dims, coarse):
    """Coarse components have many ties and equal entries; 20 vectors are fewer than the entries."""
    rows, table = vectors(spark, n, dims, n + dims, coarse)
    ids, told, digest = plain_codes([(r[0], r[1]) for r in rows if r[1] != []])
    books = codes.fit(table)
    assert books.digest() == digest
    got = [((r["vec_id"] is None, r["vec_id"] or 0), (r["code"], r["error"])) for r in codes.encode(table, books, keep=("label",)).collect()]
    assert sorted(got) == sorted(zip(ids, told, strict=True))


def test_ball_trees_find_the_nearest():
    rng = np.random.default_rng(2)
    for spread, k in ((2, 64), (40, 64), (10**8, 64), (3, 5), (1, 200)):
        book, points = rng.integers(-spread, spread + 1, (k, 4)), rng.integers(-spread, spread + 1, (3000, 4))
        which, far = codes.nearest(book, codes.ball_tree(book), points)
        every = np.square(points[:, None] - book[None]).sum(axis=2)
        assert which.tolist() == every.argmin(axis=1).tolist() and far.tolist() == every.min(axis=1).tolist()


def test_codes_of_odd_vectors(spark):
    assert codes.fit(spark.createDataFrame([], VECTORS)) is None
    mixed = spark.createDataFrame([(1, [1.0] * 5, 0, "", "", ""), (2, [1.0] * 16, 0, "", "", ""), (3, [2.0] * 32, 0, "", "", "")], VECTORS)
    books = codes.fit(mixed)
    assert books.books.shape == (16, 1, 1) and [r["vec_id"] for r in codes.encode(mixed, books).collect()] == [2]
    with pytest.raises(Exception, match="not exact"):
        codes.fit(spark.createDataFrame([(2, [1e9] * 16, 0, "", "", "")], VECTORS))


# --- Infilling


def plain_infill(i, text, seed=42):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, len(units))))
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = ["a b c", " lead and trail \n\t ", "\x1e\x1f \x1fm \x1e\x1e \x1fe\x1fm", "no<P>marker", "<S", "< <P <S <M >", "    wide　space", "\U0001f600 \U0001f600x", "x\x00y \x0b\x0c\r z", "one", "   ", "\n", None, "", "word " * 50_000, "x" * 300_000]


def test_infill_against_plain_strings(spark):
    rows = [(i, ODD[i % len(ODD)], "x", "x", 3, "x", "x", "x", "x") for i in range(400)] + [(None, "a b c d", None, None, None, None, None, None, None), (3, "again", None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("form", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("drawn", F.lit(2)).withColumn("marked", F.lit(2))
    made = infill.with_infill(docs.repartition(7)).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    assert set(docs.columns) - {"form"} <= set(made.columns)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""), (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]), r["back"]) for r in made.collect())
    want = sorted(((i is None, i or 0, t or ""), plain_infill(i, t), t or "") for i, t, *_ in rows)
    assert [(g[0], g[1]) for g in got] == [(w[0], w[1]) for w in want] and [g[2] for g in got] == [w[2] for w in want]
    assert {g[1][1] for g in got} == {"plain", "spm", "psm"}


def test_infill_parameters(spark):
    docs = documents(spark, 80)
    every = infill.with_infill(docs, percent=100, spm_percent=0)
    assert {r["form"] for r in every.collect()} == {"psm", "plain"} and every.where("form = 'plain' and text <> ''").count() == 0
    assert infill.with_infill(docs, percent=0).where("form <> 'plain'").count() == 0
    assert infill.with_infill(empty(spark)).count() == 0
    plan = infill.with_infill(spark.range(9).selectExpr("id as doc_id", "'a b' as text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan

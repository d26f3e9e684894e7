"""Stages of the corpus pipeline."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from tests.llm.cases import SCHEMA, empty, prose
from tests.llm.test_dedup import cut_words, grouped
from tests.llm.test_operators import least_padding, scored_by_hand
from tests.llm.test_text import WORD, plain
from tidemark.llm import packing, quality


def test_near_dedup_links_at_four_fifths(spark):
    """104 words with 2 changed far from each other: 90 of 110 shingles in common, 0.818; with 3 changed 0.739."""
    rng = random.Random(3)
    base = prose(rng, 104, 10**6).split()

    def changed(*at):
        return " ".join("changed" if k in at else w for k, w in enumerate(base))

    rows = [(1, " ".join(base)), (2, changed(20, 60)), (3, changed(40, 70, 90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]


def test_stages_decide_by_rows_where_ids_are_null_or_repeat(spark):
    rng = random.Random(4)
    a, b, c, d = (prose(rng, 120, 10**6) for _ in range(4))
    rows = [(3, a, "s", 1), (7, a, "s", 1), (7, b, "s", 1), (9, b, "s", 1), (9, b, "s", 1), (None, c, "s", 1), (None, b, "s", 1), (11, None, None, 1), (12, "", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int").repartition(3)

    def found(df):
        return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)

    assert found(corpus_pipeline.near_dedup(spark, docs, "")) == sorted([(3, a), (7, b), (None, c), (11, None), (12, "")], key=repr)
    assert found(corpus_pipeline.substring_dedup(spark, docs, "")) == sorted([(3, a), (7, ""), (7, b), (9, ""), (9, ""), (None, c), (None, ""), (11, None), (12, "")], key=repr)
    one = spark.createDataFrame([(7, a, "s", 1), (7, f"{b} x", "s", 1), (None, f"{c} x y", "s", 1), (1, d, "t", 1)], docs.schema)
    planned = corpus_pipeline.mix(corpus_pipeline._keyed(one), id_column="__own").agg({"taken": "sum"}).first()[0]
    mixed = corpus_pipeline.mixing(spark, one, "").collect()
    assert sum(len(r["text"].split()) for r in mixed) == planned and {r["text"] for r in mixed if r["doc_id"] is None} == {f"{c} x y"}
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.substring_dedup, corpus_pipeline.mixing):
        assert stage(spark, docs.limit(0), "").collect() == []


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Prose and shouted junk in three sources, exact and near copies, passages and paragraphs in common, a null text, an empty one."""
    rng = random.Random(21)
    shared = [prose(rng, n, 10**6) for n in (70, 90, 55)]
    rows = []
    for i in range(160):
        text = "\n".join(prose(rng, rng.randrange(8, 60), 10**6) + "." for _ in range(3))
        if i % 8 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split()[: rng.randrange(5, 40)])
        elif i % 8 == 1 and i > 1:
            text = rng.choice([r[1] for r in rows if "!!" not in r[1]])
        elif i % 8 == 2:
            words = rows[-1][1].split(" ")
            words[len(words) // 2] = "edited"
            text = " ".join(words)
        elif i % 8 in (3, 4):
            text += f" {rng.choice(shared)}\n{prose(rng, 12, 10**6)}."
        rows.append((i, text, "en", rng.choice("aab"), len(text), "x", "x", "x", "x"))
    rows += [(200, None, "en", "a", 0, "x", "x", "x", "x"), (201, "", "en", None, 0, "x", "x", "x", "x")]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 != 0), 0) for i in range(160)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_every_stage_does_what_brute_force_does(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    good = corpus_pipeline.stage(corpus_pipeline.quality(spark, docs, corpus), "t")
    rules = quality.learn(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    assert {r["doc_id"] for r in good.collect()} == {i for i, t in texts.items() if scored_by_hand(rules, t) >= 0.7} and good.columns == docs.columns
    assert {i for i in range(160) if i % 8} <= {r["doc_id"] for r in good.collect()}

    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    alone = corpus_pipeline.stage(corpus_pipeline.near_dedup(spark, good, corpus), "t")
    groups = grouped({i: plain(t) for i, t in kept.items()}, 80)
    assert {r["doc_id"]: r["text"] for r in alone.collect()} == {i: t for i, t in kept.items() if groups[i] == i}
    assert len(kept) > alone.count() and alone.columns == docs.columns

    cut = corpus_pipeline.stage(corpus_pipeline.substring_dedup(spark, alone, corpus), "t")
    before = {r["doc_id"]: r["text"] for r in alone.collect()}
    left = cut_words([(i, t) for i, t in before.items() if t is not None], 51)
    after = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()}
    assert {i: t.split() for i, (t, _) in after.items() if t is not None} == left and cut.columns == docs.columns
    assert all(n == len(t) for t, n in after.values() if t is not None) and any(left[i] != before[i].split() for i in left)

    mixed = corpus_pipeline.stage(corpus_pipeline.mixing(spark, cut, corpus), "t")
    size = {i: len(WORD.findall(t or "")) for i, (t, _) in after.items()}
    source = {r["doc_id"]: r["source"] for r in cut.collect()}
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert all(1 <= n <= 3 for n in copies.values()) and mixed.columns == docs.columns
    total, taken = Counter(), Counter()
    for i, n in size.items():
        total[source[i]] += n
        taken[source[i]] += copies[i] * n
    # weights 5, 2 for a, b, and 1 for null, whose size is 0; a stops at three times its size
    whole = sum(total.values())
    target = {"a": min(3 * total["a"], whole * 5 / 7)}
    target["b"] = whole - target["a"]
    for s in "ab":
        rest = target[s] % total[s]
        sums = {0}
        for i, n in size.items():
            if source[i] == s:
                sums |= {x + n for x in sums}
        assert abs(taken[s] - target[s]) <= min(abs(x - rest) for x in sums) + 1

    packed = corpus_pipeline.packing(spark, mixed, corpus).collect()
    assert Counter(r["doc_id"] for r in packed) == copies and all(r["n_tokens"] == size[r["doc_id"]] <= r["bucket_len"] for r in packed)
    lengths = [r["n_tokens"] for r in packed]
    assert sum(r["bucket_len"] - r["n_tokens"] for r in packed) == (least_padding(lengths, packing.BUCKETS) if len(set(lengths)) > packing.BUCKETS else 0)
    assert max(Counter((r["bucket"], r["batch"]) for r in packed).values()) <= max(packing.BUDGET // max(r["bucket_len"], 1) for r in packed)

    whole_run = corpus_pipeline.run(spark, corpus).collect()
    assert sorted(map(tuple, whole_run)) == sorted(map(tuple, packed))


def test_stages_of_nothing(spark, corpus):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), corpus).collect() == []

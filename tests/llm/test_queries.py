"""The registered queries over odd tables: nulls in every column, empty and very long texts, repeated rows, clashing columns, nothing."""

import random
from collections import Counter

import pytest
from tests.llm.cases import SCHEMA, prose
from tidemark.llm import queries

PAGES, VECTORS, LABELS = "page_id long, url string, html string, digest string", "vec_id long, embedding array<double>, label int, size int", "doc_id long, quality int, toxic int"


def written(spark, path, documents, pages, vectors, labels):
    for name, rows, schema in (("documents", documents, SCHEMA), ("pages", pages, PAGES), ("embeddings", vectors, VECTORS), ("labels", labels, LABELS)):
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return written(spark, str(tmp_path_factory.mktemp("nothing")), [], [], [], [])


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(31)
    twice = prose(rng, 80)
    texts = [twice, twice, None, "", " \t\n", prose(rng, 40_000), "x" * 300_000, "Ünïcødé 的 words. " * 30, *(prose(rng, rng.randrange(1, 90)) + "." for _ in range(30))]
    documents = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", None]), len(t or ""), "x", None, "x", None) for i, t in enumerate(texts)]
    documents += [documents[0], (0, "another text of the same id", None, None, None, None, None, None, None), (None, twice, None, None, None, "x", "x", "x", "x"), (None, None, None, None, None, None, None, None, None)]
    pages = [(1, None, None, None), (1, "http://a/", "p", "x"), (2, "http://a/", "p", "x"), (None, None, None, None), (None, "http://a/", "p", None), (3, "", "", "")]
    vectors = [(i, [float(i % 3), 1.0], 0, 7) for i in range(0, 30)] + [(20, [5.0, 5.0], 0, 7), (20, [5.0, 5.0], None, None), (40, None, 0, 0), (60, [None, 1.0], 0, 0), (None, [1.0, 1.0], 0, 0), (80, [1.0], 0, 0), (100, [], 0, 0)]
    labels = [(i, i % 2, 0) for i in range(30)] + [(1, 0, 0), (None, 1, None), (2, None, None)]
    return written(spark, str(tmp_path_factory.mktemp("odd")), documents, pages, vectors, labels)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_nothing_gives_nothing(spark, nothing, name):
    assert queries.queries()[name](spark, nothing).collect() == []


BY_ROW = [n for n in sorted(queries.queries()) if n.split("_")[0] in ("op2", "op3", "op4", "op6", "op7", "op8", "op9", "op11", "op13")]


@pytest.mark.parametrize("name", BY_ROW)
def test_every_document_has_its_row(spark, odd, name):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    rows = queries.queries()[name](spark, odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    for field in ("held_out", "kept"):
        if rows and field in rows[0].asDict():
            assert all(isinstance(r[field], bool) for r in rows) and not any(r[field] for r in rows if r["doc_id"] is None and field == "held_out")
    if "score" in rows[0].asDict():
        assert all(r["score"] is not None for r in rows)


def test_pages_without_ids_have_their_records(spark, odd):
    rows = queries.queries()["op1_warc_captures"](spark, odd).collect()
    assert Counter(r["page_id"] for r in rows) == Counter({1: 2, None: 2, 2: 1, 3: 1})
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in rows if r["payload_bytes"] == 1} == {(1, "revisit", 2), (2, "response", None), (None, "revisit", 2)}


def test_few_candidates_and_ties(spark, odd):
    """32 vectors of two components: ties go to smaller ids, the rows that repeat id 20 are never each other's candidates, and [1.0] has none."""
    rows = queries.queries()["op5_projected_neighbours"](spark, odd).orderBy("query_id", "rank").collect()
    assert Counter(r["query_id"] for r in rows) == {0: 20, 20: 20}
    first = [(r["vec_id"], r["score"]) for r in rows if r["query_id"] == 0]
    assert first[0] == (20, 5.0) and first[2:] == [(i, 1.0) for i in range(1, 19)]
    assert all(r["vec_id"] != r["query_id"] for r in rows)


def test_repeats_among_odd_rows(spark, odd):
    rows = queries.queries()["op10_paragraph_dedup"](spark, odd).collect()
    assert {(r["doc_id"], r["keeper_doc_id"], r["kept"]) for r in rows} >= {(0, 0, True), (1, 0, False)} and all(r["doc_id"] is not None for r in rows)

"""Near-duplicate and paragraph grouping against brute force, and components."""

import random

import pytest

from tests.llm.cases import documents, empty, prose
from tests.llm.test_text import plain
from tidemark.llm import components, linkage
from tidemark.llm.components import connected_components
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.substring import cut_repeats, repeated_spans


def grouped(sets, percent):
    """Smallest reachable key of each key whose set is not empty."""
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def check_near(docs):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in near_duplicates(docs).collect()}
    assert set(got) == set(rows)
    sets = {k: plain(t) for k, t in rows.items() if k is not None}
    wanted = grouped(sets, 85)
    for k, w in wanted.items():
        assert (got[k]["component_id"], got[k]["kept"], got[k]["n_shingles"]) == (w, w == k, len(sets[k]))
    if None in got:
        assert got[None]["component_id"] is None and got[None]["kept"]


def test_near_duplicates_are_those_of_brute_force(spark):
    check_near(documents(spark))


@pytest.mark.parametrize("limit", ["CHUNK", "ELEMENTS"])
def test_a_chain_of_copies_and_large_buckets(spark, monkeypatch, limit):
    """Copies each a little further from the first, in buckets beyond a task's limits, of rows or of elements."""
    monkeypatch.setattr(linkage, limit, 8 if limit == "CHUNK" else 900)
    monkeypatch.setattr(linkage, "LEADERS", 5)
    monkeypatch.setattr(linkage, "SALTS", 2)
    monkeypatch.setattr(components, "EDGES", 6)
    rng = random.Random(9)
    words, rows = prose(rng, 100).split(), []
    for i in range(45):
        if i % 3 == 2:
            words[rng.randrange(100)] = f"c{i}"
        own = list(words)
        for _ in range(i % 4):
            own[rng.randrange(100)] = f"d{rng.randrange(1000)}"
        rows.append((100 - i, " ".join(own)))
    check_near(spark.createDataFrame(rows, "doc_id long, text string"))


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(empty(spark)).collect() == []


@pytest.mark.parametrize("limit", [3, 1000])
def test_components_of_paths_stars_and_rings(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "EDGES", limit)
    edges = [(i, i + 1) for i in range(10, 22)] + [(100, x) for x in range(101, 120)] + [(30, 31), (31, 32), (32, 30), (None, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {**{i: 10 for i in range(10, 23)}, **{i: 100 for i in range(100, 120)}, 30: 30, 31: 30, 32: 30}


def cut_words(rows, least, percent=80):
    """Words of each text that brute force leaves: paragraphs alike an earlier one go, then the words of windows that stand elsewhere."""
    lines = {i: [p.split() for p in t.split("\n")] for i, t in rows}
    sets = {(i, k): plain(" ".join(w)) for i, own in lines.items() for k, w in enumerate(own) if len(w) >= least}
    gone = {k for k, g in grouped(sets, percent).items() if g != k}
    words = {i: [(w.lower(), (i, k) in gone) for k, own in enumerate(own) for w in own] for i, own in lines.items()}
    seen = {}
    for i, own in words.items():
        for k in range(len(own) - least + 1):
            part = own[k : k + least]
            if not all(g for _, g in part):
                seen.setdefault(tuple(w for w, _ in part), []).append((i, k, not any(g for _, g in part)))
    out = {i: {k for k, (_, g) in enumerate(own) if g} for i, own in words.items()}
    for places in seen.values():
        alive = sorted((i, k) for i, k, a in places if a)
        for i, k, _ in places if alive else ():
            firsts = [x for j, x in alive if j == i]
            if i > alive[0][0] or (firsts and k - firsts[0] >= least):
                out[i].update(range(k, k + least))
    return {i: [w for k, w in enumerate(t.split()) if k not in out[i]] for i, t in rows}


def test_repeated_paragraphs_are_those_of_brute_force(spark):
    rng = random.Random(5)
    shared = [prose(rng, n) for n in (60, 25, 80, 8)]
    rows = []
    for i in range(40):
        parts = [prose(rng, rng.randrange(3, 50), 10**6) for _ in range(3)]
        if i % 3 == 0:
            w = rng.choice(shared).split()
            if i % 2:
                w[rng.randrange(len(w))] = "edited"
            parts.insert(rng.randrange(4), " ".join(w).title())
        rows.append((i, "\n".join(parts), "x"))
    rows += [(50, None, "x"), (51, "", "x"), (None, "\n".join(shared), "x"), (52, "\n\n" + shared[0] + "\n", "x"), (52, shared[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class string").repartition(3)
    spans = repeated_spans(docs, least_words=20)
    got = {(r["doc_id"], r["paragraph"]): ((r["keeper_doc_id"], r["keeper_paragraph"]), r["kept"]) for r in spans.where("keeper_paragraph is not null").collect()}
    sets = {(i, k): plain(p) for i, t, _ in rows if i is not None for k, p in enumerate((t or "").split("\n")) if len(p.split()) >= 20}
    groups = grouped(sets, 80)
    wanted = {k: (g, k == g) for k, g in groups.items() if list(groups.values()).count(g) > 1 or k[0] == 52}
    assert got == wanted
    cut = [(r["doc_id"], r["text"], r["class"]) for r in cut_repeats(docs, spans).collect()]
    assert len(cut) == len(rows)
    left = cut_words([(i, t) for i, t, _ in rows if i is not None and i != 52 and t is not None], 20)
    assert {i: t.split() for i, t, _ in cut if i in left} == left
    assert {t for i, t, _ in cut if i is None} == {"\n".join(shared)} and (50, None, "x") in cut and (51, "", "x") in cut
    assert repeated_spans(empty(spark)).collect() == []


def test_every_exact_repeat_of_over_50_words_goes(spark):
    """Repeats over several short lines, from mid-sentence, without a full stop, and a line that is one inside another text."""
    rng = random.Random(12)
    many = "\n".join(prose(rng, n, 10**6) for n in (48, 19, 17))
    short = "\n".join(prose(rng, 9, 10**6) for _ in range(6))  # 54 words, each line too short for a paragraph
    mixed = "\n".join(prose(rng, n, 10**6) for n in (30, 66, 20))  # 30 and 20 words beside a whole paragraph
    bare, sentence, just, under = prose(rng, 70, 10**6), prose(rng, 60, 10**6) + ".", prose(rng, 51, 10**6), prose(rng, 50, 10**6)
    rows = []
    for i, shared in enumerate((many, short, mixed, bare, sentence, just, under)):
        rows += [(10 * i, f"{prose(rng, 30, 10**6)} {shared} {prose(rng, 20, 10**6)}"), (10 * i + 1, shared + "\n" + prose(rng, 7, 10**6)), (10 * i + 2, f"{prose(rng, 5, 10**6)}\n\n{prose(rng, 13, 10**6)} {shared.replace(chr(10), ' ')} {prose(rng, 40, 10**6)}")]
    rows += [(90, " ".join(["again"] * 300)), (91, prose(rng, 400, 10**6).title())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = repeated_spans(docs)
    got = {r["doc_id"]: r["text"].split() for r in cut_repeats(docs, spans).collect()}
    assert got == cut_words(rows, 51)
    for i, shared in enumerate((many, short, mixed, bare, sentence, just)):
        left = shared.split()
        assert [w for w in got[10 * i + 1] if w in left] == [w for w in got[10 * i + 2] if w in left] == []
    assert {r["keeper_doc_id"] for r in spans.where("doc_id between 10 and 12").collect()} == {10}


def test_spans_of_texts_against_brute_force(spark):
    """Texts from a pool of pieces and edited pieces, so that paragraphs are alike, runs cross line feeds and both meet."""
    rng = random.Random(13)
    pool = [prose(rng, rng.randrange(3, 14), 60) for _ in range(12)]
    pool += [prose(rng, 25, 10**6) for _ in range(3)]
    pool += [" ".join("edited" if k == 12 else w for k, w in enumerate(p.split())) for p in pool[-3:]]
    rows = [(i, "".join(rng.choice(pool) + rng.choice(["\n", " ", "\n\n"]) for _ in range(rng.randrange(1, 16)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for least in (9, 15):
        spans = repeated_spans(docs, least_words=least, percent=60)
        assert {r["doc_id"]: r["text"].split() for r in cut_repeats(docs, spans).collect()} == cut_words(rows, least, 60)


def test_a_passage_whose_first_copy_goes_with_its_paragraph_stays(spark):
    """A kept, A with an edit before passage P cut, P in other words: P's only text left is the third's, and it stays."""
    rng = random.Random(14)
    lead, tail, passage = prose(rng, 200, 10**6), prose(rng, 200, 10**6), prose(rng, 60, 10**6)
    edited = passage.split()
    edited[11] = edited[40] = "edited"
    rows = [(10, f"{lead} {' '.join(edited)} {tail}"), (20, f"{lead} {passage} {tail}"), (30, f"{prose(rng, 40)}. {passage} {prose(rng, 30)}."), (40, f"{prose(rng, 30)} {passage}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in cut_repeats(docs, repeated_spans(docs)).collect()}
    assert left == {10: rows[0][1], 20: "", 30: rows[2][1], 40: rows[3][1].removesuffix(" " + passage)}


def test_repeats_under_51_words_stay(spark):
    rng = random.Random(15)
    shared = [prose(rng, n, 10**6) for n in (20, 42, 50)]
    rows = [(i, "\n".join([prose(rng, 30, 10**6), shared[i % 3], prose(rng, 30, 10**6)])) for i in range(9)]
    assert repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []

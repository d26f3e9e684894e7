"""WARC, fingerprints, PPM, neighbours, quality, language, packing and mixing against brute force or held-out rows."""

import base64
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import SCHEMA, documents, empty, prose
from tests.llm.test_text import WORD, lower, plain
from tidemark.llm import fingerprint, language, mixing, neighbours, packing, ppm, quality, warc


def bucket(i, n):
    return zlib.crc32(str(i).encode()) % n


# --- WARC


PAGES = [(1, "http://www.B.example.com:80/x?q=1", "same"), (2, "https://b.example.com/x?q=1", "same"), (3, None, None), (4, "not a url", ""), (5, "http://a.example.org/é", "é\r\n\r\n" * 3000), (None, "http://[bad", "lone"), (7, "ftp://c.example.net:21", "same")]


def test_archives_read_back(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    archive = warc.write_archive(pages)
    got = {r["page_id"]: r for r in archive.records().collect()}
    assert len(got) == len(PAGES)
    for i, _, html in PAGES:
        body = (html or "").encode()
        owner = max(k or 0 for k, _, h in PAGES if (h or "") == (html or ""))
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if (i or 0) == owner else ("revisit", owner))
        assert r["payload"] == (body if r["record_type"] == "response" else None)
    found = {r["page_id"] for r in archive.lookup(["http://b.example.com/x?q=1", "http://nowhere.example/"]).collect()}
    assert found == {1, 2} and archive.lookup([]).collect() == []
    keys = [r["first_key"] for r in archive.directory.collect()]
    assert sorted(keys) == sorted(keys, key=str) and archive.directory.agg(F.sum("n")).first()[0] == len(PAGES)


def test_lookups_read_few_blocks(spark, monkeypatch):
    """Keys that run on over several blocks, and one between two blocks; rows that repeat an id."""
    monkeypatch.setattr(warc, "BLOCK_ROWS", 4)
    rows = [(i, f"http://h{i % 10}.example/p{i // 10}", f"page {i}") for i in range(200)] + [(i, "http://h3.example/hot", "hot") for i in range(300, 330)] + [(300, "http://h3.example/hot", "hot")]
    archive = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2))
    blocks = archive.directory.count()
    assert blocks >= 58
    for urls, wanted in (([f"http://h{i % 10}.example/p{i // 10}" for i in (5, 77, 140)], [5, 77, 140]), (["http://h3.example/hot"], [*range(300, 330), 300]), (["http://h3.example/hou", "http://zz.example/"], [])):
        assert sorted(r["page_id"] for r in archive.lookup(urls).collect()) == sorted(wanted)
        assert archive.blocks_of(urls).count() <= 1 + len(urls) + len(wanted) // 4 + 2
    assert archive.blocks_of([f"http://h{k}.example/none" for k in range(3000)]).count() < blocks
    got = [(r["record_type"], r["refers_to"]) for r in archive.records().where("page_id = 300").collect()]
    assert got == [("revisit", 329)] * 2


def test_lookups_over_many_index_files(spark, monkeypatch):
    """Twelve files of the index in four read partitions, which take them by size; one key has a third of the rows."""
    monkeypatch.setattr(warc, "BLOCK_ROWS", 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        rows = [(i, f"http://h{i % 37}.example/p{i}", f"page {i}") for i in range(600)] + [(i, "http://h3.example/hot", "hot") for i in range(600, 900)]
        archive = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6))
        assert archive.directory.select("file").distinct().count() >= 8
        urls = [f"http://h{i % 37}.example/p{i}" for i in range(0, 600, 3)]
        assert sorted(r["page_id"] for r in archive.lookup(urls).collect()) == list(range(0, 600, 3))
        assert sorted(r["page_id"] for r in archive.lookup(["http://h3.example/hot", urls[1]]).collect()) == [3, *range(600, 900)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def _samples(monkeypatch, module, name, call):
    """How many rows ``call`` gives to ``module.name``."""
    seen = []
    monkeypatch.setattr(module, name, lambda *args, **_: seen.append(args))
    call()
    return seen


def test_language_sample_is_bounded_and_not_empty(spark, monkeypatch):
    """Rows without ids or with one id, a language of one row, more languages than the sample, and repeats."""
    own = next(i for i in range(9) if bucket(i, 3) != 1)
    rows = [(None if i % 2 else own, f"text number {i} here", "en" if i else "de") for i in range(3000)] + [(own, "the same text", "fr")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    (x, langs), = _samples(monkeypatch, language, "fit_tree", lambda: language.learn(docs, sample=300))
    counts = Counter(langs)
    assert counts["de"] == 1 and counts["fr"] == 1 and 60 <= counts["en"] <= 160 and len(x) == len(langs)
    many = spark.createDataFrame([(None, f"text {i}", f"l{i:03d}") for i in range(50)], "doc_id long, text string, lang string")
    (x, langs), = _samples(monkeypatch, language, "fit_tree", lambda: language.learn(many, sample=20))
    assert sorted(langs) == [f"l{i:03d}" for i in range(20)]


def test_quality_sample_is_bounded(spark, monkeypatch):
    rows = [(2 if i < 2000 else i, f"text number {i}.") for i in range(2100)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2, 0) for i in range(2100)], "doc_id long, quality int, toxic int")
    (table,), = _samples(monkeypatch, quality, "fit_rules", lambda: quality.learn(docs, labels))
    assert table.count() == sum(bucket(i, 4) != 2 for i in (2, *range(2000, 2100)))


def test_archive_of_nothing(spark):
    assert warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string")).records().collect() == []


def test_url_keys():
    assert warc.url_key("http://www.B.example.com:80/x?q=1") == "com,example,b)/x?q=1" == warc.url_key("https://b.example.com/x?q=1")
    assert warc.url_key(None) == "" and warc.url_key("plain") == "plain"


# --- fingerprints


def test_edits_and_sketches(spark):
    docs = documents(spark, 40)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    got = {r["doc_id"]: r for r in fingerprint.fingerprints_with_edits(docs).collect()}
    assert len(got) == len(rows)
    errors = []
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for a, b, near in ((plain(t), plain(edited), "near_edited"), (plain(t), plain(other), "near_next")):
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert 0 <= got[i][near] <= 1
            errors.append((abs(got[i][near] - true), len(a | b)))
    assert all(e < 0.2 for e, n in errors if n > 300) and np.mean([e for e, _ in errors]) < 0.1
    prints = {}
    for i, t in rows:
        prints.setdefault(frozenset(plain(t)), set()).add(got[i]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert fingerprint.fingerprints_with_edits(empty(spark)).collect() == []


def test_sketches_of_another_fraction(spark):
    """Counts, unions and likeness of sketches that retain one in 2, 4 and 8."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(9000)]
    rng.shuffle(words)
    a, b = " ".join(words[:6000]), " ".join(words[3000:])
    made = {f: [fingerprint.sketches(pa.array([t]), fraction=f)[0][0] for t in (a, b)] for f in (2, 4, 8)}
    assert [fingerprint.fraction_of(s) for f in made for s in made[f]] == [2, 2, 4, 4, 8, 8]
    rows = [(f, g, made[f][0], made[g][1]) for f in made for g in made]
    df = spark.createDataFrame(rows, "f int, g int, a string, b string")
    for r in df.select("*", fingerprint.merged("a", "b").alias("u"), fingerprint.likeness("a", "b").alias("l"), fingerprint.containment("a", "b").alias("c")).collect():
        assert fingerprint.fraction_of(r["u"]) == max(r["f"], r["g"])
        assert int(r["u"].split(".")[0], 16) == pytest.approx(9000, rel=0.1) and r["l"] == pytest.approx(1 / 3, abs=0.06) and r["c"] == pytest.approx(0.5, abs=0.08)
    grouped = df.selectExpr("f + g as k", "a as fingerprint").union(df.selectExpr("f + g as k", "b as fingerprint"))
    for r in fingerprint.merged_by(grouped, ["k"]).collect():
        most = {4: 2, 6: 4, 8: 4, 10: 8, 12: 8, 16: 8}[r["k"]]
        assert fingerprint.fraction_of(r["fingerprint"]) == most and int(r["fingerprint"].split(".")[0], 16) == pytest.approx(9000, rel=0.1)


def test_containment_and_union(spark):
    rng = random.Random(2)
    small, large = prose(rng, 400, 9999), prose(rng, 6000, 9999)
    import pyarrow as pa

    a, b, c = fingerprint.sketches(pa.array([small, large + " " + small, large]))[0]
    row = spark.createDataFrame([(a, b, c)], "a string, b string, c string").select(
        fingerprint.containment("a", "b").alias("inside"), fingerprint.containment("a", "c").alias("outside"), fingerprint.likeness("a", "a").alias("same"), fingerprint.likeness(fingerprint.merged("a", "c"), "b").alias("union")
    ).first()
    assert row["inside"] > 0.95 and row["outside"] < 0.1 and row["same"] == 1 and row["union"] > 0.95
    grouped = spark.createDataFrame([("x", a), ("x", c), ("x", c), ("x", None), (None, b), ("y", fingerprint.sketches(pa.array([""]))[0][0])], "g string, fingerprint string").repartition(3)
    unions = {r["g"]: r["fingerprint"] for r in fingerprint.merged_by(grouped, ["g"]).collect()}
    assert fingerprint.retained(unions["x"]).tolist() == sorted({*fingerprint.retained(a).tolist(), *fingerprint.retained(c).tolist()})
    assert fingerprint.retained(unions[None]).tolist() == fingerprint.retained(b).tolist() and len(fingerprint.retained(unions["y"])) == 0
    again = spark.createDataFrame([(unions["x"], unions["x"])], "a string, b string").select(fingerprint.merged("a", "b").alias("m"), fingerprint.likeness("a", "b").alias("l")).first()
    assert again["m"] == unions["x"] and again["l"] == 1


# --- PPM


def brute_ppm(train, order):
    """Counts of contexts, the shorter ones with update exclusion, and a coder of one symbol at a time."""
    full = Counter()
    for t in train:
        line = [0] * order + list(t) + [256]
        for k in range(order, len(line)):
            full[tuple(line[k - order : k + 1])] += 1
    levels = {order: full}
    for o in range(order - 1, -1, -1):
        levels[o] = Counter(g[1:] for g in levels[o + 1])

    def score(t):
        line, total = [0] * order + list(t) + [256], 0.0
        for k in range(order, len(line)):
            out, chance, done = set(), 0.0, False
            for o in range(order, -1, -1):
                ctx = tuple(line[k - o : k])
                seen = {g[-1]: n for g, n in levels[o].items() if g[:-1] == ctx and g[-1] not in out}
                if not seen:
                    continue
                whole = sum(seen.values())
                if line[k] in seen:
                    chance += math.log10((2 * seen[line[k]] - 1) / (2 * whole))
                    done = True
                    break
                chance += math.log10(len(seen) / (2 * whole))
                out |= set(seen)
            if not done:
                chance -= math.log10(257 - len(out))
            total += chance
        return total

    return score


@pytest.mark.parametrize("answer_bytes", [ppm.ANSWER_BYTES, 100])
def test_scores_are_those_of_a_trie(spark, monkeypatch, answer_bytes):
    """With groups answered at once, and in many slices."""
    monkeypatch.setattr(ppm, "ANSWER_BYTES", answer_bytes)
    rng = random.Random(6)
    texts = {i: rng.choice([None, "", "abra cadabra", "Abc abd", prose(rng, 6, 9), "é\x00z"]) for i in range(30)}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, item string")
    got = {r["doc_id"]: r for r in ppm.score(docs, block_bytes=100).collect()}
    train = [t or "" for i, t in texts.items() if bucket(i, 5) != 1]
    counts = Counter(w for t in train for w in [*WORD.findall(lower(t)), None])
    total = sum(counts.values())
    model = brute_ppm([t.encode() for t in train], ppm.ORDER)
    for i, t in texts.items():
        tokens = [*WORD.findall(lower(t)), None]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (bucket(i, 5) == 1, len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in tokens))
        assert r["score"] == pytest.approx(model((t or "").encode()))
    assert ppm.score(empty(spark)).collect() == []


# --- neighbours


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, size=(1500, 1))
    x[300:420] = x[300]
    rows = [(i, [float(v) for v in x[i]], "x") for i in range(1500)]
    rows += [(2000, None, "x"), (2020, [0.0] * 24, "x"), (2040, [float("nan")] * 24, "x"), (2060, [None] * 24, "x"), (None, [1.0] * 24, "x"), (2080, [], "x"), (2100, [1.0, 2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        scores = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(1500), -scores)) if i != q][:20]
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 21)) and all(s == pytest.approx(scores[i]) for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(order))
        if 300 <= q < 420:
            assert [i for _, i, _ in found] == [i for i in range(300, 420) if i != q][:20] or scores[order[0]] > scores[300]
    assert hits / (20 * len(got)) >= 0.95
    assert neighbours.nearest(df.limit(0), F.lit(True)).collect() == []


@pytest.mark.parametrize("most_cells", [4096, 4])
def test_neighbours_through_cells_slices_and_blocks(spark, monkeypatch, most_cells):
    """Many cells, few cells of many slices, and several blocks of queries, on clusters and a third of equal vectors."""
    for name, value in (("SHARD_ROWS", 120), ("QUERY_ROWS", 16), ("SAMPLE_ROWS", 400), ("MOST_CELLS", most_cells)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1800, 16)) + 3 * rng.normal(size=(30, 16))[rng.integers(0, 30, 1800)]
    x[600:1200] = x[600]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(1800)], "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1800, 20))
    hits = 0
    for q, found in got.items():
        scores = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(1800), -scores.round(9))) if i != q][:20]
        assert [k for k, _, _ in sorted(found)] == list(range(1, 21)) and all(s == pytest.approx(scores[i]) for _, i, s in found)
        hits += sum(scores[i] >= scores[order[-1]] - 1e-9 for _, i, _ in found)
    assert hits / (20 * len(got)) >= 0.95


def test_chi_square_quantiles():
    assert neighbours.chi_square_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    assert neighbours.chi_square_quantile(0.98, 16) == pytest.approx(29.6332, abs=1e-3)


# --- quality and language


def test_statistics_of_a_text():
    from tidemark.llm.text import chunks
    import pyarrow as pa

    c = next(iter(chunks(pa.array(["AB cd. 12 ###", "", "a a\na"]))))
    got = [dict(zip(quality.STATISTICS, r, strict=True)) for r in quality.text_statistics(c)]
    assert got[0]["log_words"] == pytest.approx(math.log(5)) and got[0]["upper"] == 0.5 and got[0]["wordless"] == 0.5 and got[0]["shout_words"] == 0.25 and got[0]["stops_per_word"] == 0.25
    assert set(got[1].values()) == {0.0} and got[2]["distinct_words"] == pytest.approx(1 / 3) and got[2]["lines_per_word"] == pytest.approx(1 / 3)


def scored_by_hand(rules, text):
    """The rules' score of one text, rule by rule."""
    import pyarrow as pa
    from tidemark.llm.text import chunks

    own = dict(zip(quality.STATISTICS, quality.text_statistics(next(iter(chunks(pa.array([text], pa.string())))))[0], strict=True))
    total = rules.intercept
    for weight, rule in rules.rules:
        if all(own[s] > t if above else own[s] <= t for s, above, t in rule):
            total += weight
    return 1 / (1 + math.exp(-total))


def test_compiled_rules_are_the_rules(spark):
    docs = documents(spark, 80)
    rng = random.Random(6)
    rules = quality.fit_rules(quality.with_statistics(docs.select("text"), "text").withColumn("label", F.lit(rng.random() < 2).cast("double") * (F.col("__q_log_words") > 4.0).cast("double")), trees=8)
    assert len(rules.rules) > 2
    for r in quality.with_quality(docs, rules, score_column="component").select("text", "component").collect():
        assert r["component"] == pytest.approx(scored_by_hand(rules, r["text"]))


def test_lasso_weights_are_optimal():
    """At the optimum the gradient of a standardised column is the penalty against its weight's sign, and no more where the weight is 0."""
    rng = np.random.default_rng(7)
    holds = rng.random((600, 30)) < rng.uniform(0.1, 0.9, 30)
    labels = (rng.random(600) < 1 / (1 + np.exp(-(2.0 * holds[:, 0] - 3.0 * holds[:, 1] + 0.5)))).astype(float)
    penalty = 0.01
    b, w = quality._lasso(holds.astype(np.int8), labels, penalty, 3000)
    chance = 1 / (1 + np.exp(-(holds @ w + b)))
    z = (holds - holds.mean(axis=0)) / holds.std(axis=0)
    gradient = z.T @ (chance - labels) / len(labels)
    used = np.abs(w) > 1e-6
    assert 2 <= used.sum() < 30 and abs((chance - labels).mean()) < 1e-3
    assert np.allclose(gradient[used], -penalty * np.sign(w[used]), atol=2e-4) and (np.abs(gradient[~used]) <= penalty + 2e-4).all()


def test_quality_on_held_out_rows(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        good = i % 4 != 0
        text = ". ".join(prose(rng, 12) for _ in range(4)) if good else " ".join(f"W{rng.randrange(9)}###!!" for _ in range(40))
        rows.append((i, text, "en", None, 1, "x", "x", "x", "x"))
        labels.append((i, int(good)))
    rows += [(900, None, "en", None, 1, "x", "x", "x", "x"), (901, "", None, None, 1, "x", "x", "x", "x")]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1), (902, None)], "doc_id long, quality int")
    rules = quality.learn(docs, marks)
    assert 0 < len(rules.rules) < 200
    got = {r["doc_id"]: r["q"] for r in quality.with_quality(docs, rules, score_column="q").select("doc_id", "q").collect()}
    assert len(got) == len(rows) and all(0 <= v <= 1 for v in got.values())
    held = [(i, y) for i, y in labels if bucket(i, 4) == 2]
    assert np.mean([(got[i] >= 0.7) == bool(y) for i, y in held]) > 0.95
    assert quality.learn(docs, marks.limit(0)).rules == ()


WORDS = {"en": "the of and to in that is was for it with as his on be at by".split(), "de": "der die und in den von zu das mit sich des auf für ist".split(), "fr": "le de un à être et en avoir que pour dans ce il qui".split(), "es": "el que y a los del se las por un para con no una su al".split()}


def test_language_on_held_out_rows(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS[lang]).upper() if i % 7 == 0 else rng.choice(WORDS[lang]) for _ in range(25)), lang, None, 1, "x", "x", "x", "x") for i in range(400) for lang in [sorted(WORDS)[i % 4]]]
    rows += [(900, None, "en", None, 1, "x", "x", "x", "x"), (901, " 12 -- !", None, None, 1, "x", "x", "x", "x"), (902, "的", None, None, 1, "x", "x", "x", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    tree = language.learn(docs)
    assert sorted(map(tuple, tree.families)) == [("de", "en"), ("es", "fr")]
    got = {r["doc_id"]: r for r in language.identify(docs, tree).collect()}
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in rows[:400] if bucket(r[0], 3) == 1]) > 0.95
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] != "und" and all(0 <= r["score"] <= 1 for r in got.values())
    assert language.learn(empty(spark)) is None and language.identify(docs.limit(1), None).first()["lang_pred"] == "und"


def test_decisions_are_those_of_a_plain_loop(spark):
    """Family by family, language by language: most pairs won, then the larger sum of squashed margins, then the earlier name."""
    import pyarrow as pa
    from tidemark.llm.text import chunks

    rng = random.Random(14)
    pool = [w for own in WORDS.values() for w in own]
    rows = [(i, " ".join(rng.choice(WORDS[sorted(WORDS)[i % 4]] if rng.random() < 0.8 else pool) for _ in range(12)), sorted(WORDS)[i % 4], None, 1, "x", "x", "x", "x") for i in range(200)]
    tree = language.learn(spark.createDataFrame(rows, SCHEMA))
    texts = [" ".join(rng.choice(pool) for _ in range(n)) for n in (1, 2, 5, 30, 5000)] + ["", "zzz qqq"]
    x = language.profiles(next(iter(chunks(pa.array(texts)))))
    names, score = tree.predict(x)
    for k, row in enumerate(x):
        margins = [float(np.float32(row @ tree.weights[:, p]) + tree.biases[p]) for p in range(len(tree.pairs))]

        def decide(level, n):
            wins, sums = [0.0] * n, [0.0] * n
            for (at, i, j), m in zip(tree.pairs, margins, strict=True):
                if at == level:
                    p = 1 / (1 + math.exp(-max(-30, min(30, 3 * m))))
                    wins[i if p >= 0.5 else j] += 1
                    sums[i] += p
                    sums[j] += 1 - p
            best = max(range(n), key=lambda i: (wins[i], sums[i]))
            return best, sums[best] / (n - 1) if n > 1 else 1.0

        family, sure = decide(-1, len(tree.families))
        language_, inner = decide(family, len(tree.families[family]))
        assert names[k] == tree.families[family][language_] and score[k] == pytest.approx(sure * inner, abs=1e-4)


# --- packing and mixing


def test_bounds_are_optimal():
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 60, 9))
        counts = rng.integers(1, 9, len(lengths))

        def padding(bounds):
            return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))

        best = min(padding([*cut, lengths[-1]]) for cut in itertools.combinations(lengths[:-1], 2))
        assert padding(packing.best_bounds(lengths, counts, 3)) == best
    assert packing.best_bounds(np.zeros(0, int), np.zeros(0, int), 3) == []


def least_padding(lengths, buckets):
    """Plain dynamic programme over the sorted lengths of all rows."""
    own = sorted(lengths)
    cost = [0] + [math.inf] * len(own)
    for _ in range(buckets):
        cost = [0] + [min(cost[i] + sum(own[j - 1] - x for x in own[i:j]) for i in range(j)) for j in range(1, len(own) + 1)]
    return cost[-1]


def test_padding_of_long_texts_is_the_least(spark):
    """Lengths far above 256, with ties, a null and a repeated id."""
    rng = random.Random(23)
    lengths = [rng.choice([rng.randrange(300), rng.randrange(250, 3000), 700, 20_000]) for _ in range(70)] + [0]
    rows = [(None if i == 5 else 7 if i == 6 else i, n or None, "x") for i, n in enumerate(lengths)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long, bucket string").repartition(3), buckets=5).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(lengths)
    assert sum(r["bucket_len"] - r["n_tokens"] for r in got) == least_padding(lengths, 5)


def test_bounds_of_many_lengths():
    """Against the same programme solved without halving."""
    rng = np.random.default_rng(9)
    lengths = np.unique(rng.integers(0, 60_000, 700))
    counts = rng.integers(1, 1000, len(lengths))
    c, t = (np.concatenate(([0], np.cumsum(x))) for x in (counts, counts * lengths))
    cost = np.full(len(lengths) + 1, 1 << 62)
    cost[0] = 0
    for _ in range(16):
        cost = np.array([0] + [(cost[:j] + lengths[j - 1] * (c[j] - c[:j]) - (t[j] - t[:j])).min() for j in range(1, len(lengths) + 1)])
    bounds = np.array(packing.best_bounds(lengths, counts, 16))
    assert len(bounds) == 16 and ((bounds[np.searchsorted(bounds, lengths)] - lengths) * counts).sum() == cost[-1]


def test_batches_hold_every_row_once(spark):
    docs = documents(spark, 80)
    rows = docs.collect()
    got = packing.pack_documents(docs, buckets=4, budget=400).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows)
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in rows}
    places = Counter((r["bucket"], r["batch"], r["slot"]) for r in got)
    assert max(places.values()) == 1 and len({r["bucket_len"] for r in got}) <= 4
    for r in got:
        assert r["n_tokens"] == size[r["doc_id"]] <= r["bucket_len"]
    for (b, n), k in Counter((r["bucket"], r["batch"]) for r in got).items():
        room = max(1, 400 // max(1, next(r["bucket_len"] for r in got if r["bucket"] == b)))
        last = max(r["batch"] for r in got if r["bucket"] == b)
        assert k == room or (n == last and k <= room)
    assert packing.pack_documents(empty(spark)).collect() == []


def test_mix_meets_its_targets(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.choice([0, 3, 3, 3, 11, 40, 90])), None, rng.choice(["a", "a", "a", "b", "c", None]), 0, "x", "x", "x", "x") for i in range(300)] + [(400, None, None, "z", 0, "x", "x", "x", "x")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(2)).collect()), key=str)
    size, names = Counter(), sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        left = sum(size.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * size[s] for s in over}
        open_ -= over
    taken, of = Counter(), {r[0]: r[3] for r in rows}
    for r in got:
        assert r["source_size"] == size[of[r["doc_id"]]] and r["target"] == pytest.approx(target[of[r["doc_id"]]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[of[r["doc_id"]]] += r["taken"]
    for s in names:
        whole = int(target[s] // size[s]) if size[s] else 0
        sums = {0}
        for r in rows:
            if r[3] == s:
                sums |= {x + len(WORD.findall(r[1] or "")) for x in sums}
        assert abs(taken[s] - target[s]) <= min(abs(whole * size[s] + x - target[s]) for x in sums) + 1
    assert mixing.mix(empty(spark)).collect() == []


def test_lengths_fit_as_well_as_any_choice():
    rng = np.random.default_rng(6)
    for _ in range(40):
        lengths = np.unique(rng.integers(1, 30, 4))
        counts = rng.integers(1, 4, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        taken = mixing.fit_lengths(lengths, counts, budget, 1)
        assert ((0 <= taken) & (taken <= counts)).all()
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {x + k * n for x in sums for k in range(c + 1)}
        assert abs((taken * lengths).sum() - budget) == min(abs(x - budget) for x in sums)
    lengths, counts = np.arange(1, 3000), np.full(2999, 40)
    taken = mixing.fit_lengths(lengths, counts, 70_000_123, 1)
    assert (taken * lengths).sum() == 70_000_123 and (taken <= counts).all() and (taken >= 10).mean() > 0.9

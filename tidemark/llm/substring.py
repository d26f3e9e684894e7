"""Substring dedup: repeated paragraphs are found by MinHash banding, repeated runs of words by digests of windows that run across
line feeds, and all but one copy of each is cut out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linkage import link
from .minhash import band_keys, minhash
from .shared import scratch, side, stage
from .text import Chunk, U, chunks, column, distinct_sorted, lists, mix64, powers, set_digest, shingle_hashes, word_bounds, word_hashes

BANDS, ROWS = 8, 2  # a pair at 0.8 collides nowhere with probability 2.8e-4, at 0.9 with 1.7e-6
LEAST_WORDS = 51  # of a repeat
BLOCK_BYTES = 4_000_000  # of text whose windows are summed up together
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _lines(c: Chunk) -> tuple[Chunk, np.ndarray, np.ndarray]:
    """The chunk cut at line feeds: a row for each paragraph, with its text's row and its number there."""
    breaks = np.flatnonzero(c.data == 10)
    owner = np.concatenate((np.arange(len(c.offsets) - 1), np.searchsorted(c.offsets, breaks, "right") - 1))
    starts = np.concatenate((c.offsets[:-1], breaks + 1))
    order = np.lexsort((starts, owner))
    owner = owner[order]
    first = np.searchsorted(owner, np.arange(len(c.offsets) - 1))
    return Chunk(c.rows, c.data, np.concatenate((starts[order], [len(c.data)]))), owner, np.arange(len(owner)) - first[owner]


def _long_paragraphs(c: Chunk, width: int, min_words: int):
    """Rows, numbers, word counts and shingle sets of the paragraphs of at least ``min_words`` words."""
    lines, owner, place = _lines(c)
    starts, ends, first = word_bounds(lines)
    n = np.diff(first)
    pick = n >= max(min_words, 1)
    words = word_hashes(lines, starts, ends)[np.repeat(pick, n)]
    n = n[pick]
    sets = distinct_sorted(*shingle_hashes(words, np.concatenate(([0], np.cumsum(n))), width))
    return owner[pick], place[pick], n, *sets


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """Digests of the runs of ``size`` words from every word on that has as many to come."""
    p, inverse = powers(len(words) + 1)
    total = np.zeros(len(words) + 1, U)
    np.cumsum(words * p[:-1], out=total[1:])
    return mix64((total[size:] - total[:-size]) * inverse[: len(words) + 1 - size] + U(size)) if len(words) >= size else np.zeros(0, U)


def _anchors(words: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows of ``size`` words within a row, the place of each one's anchor, and the digests of anchors by place.

    The anchor is the least digest among a window's runs of about half its size: windows of equal words have it at the same
    word, and neighbouring windows mostly share it.
    """
    short = (size + 1) // 2
    digests = _runs(words, short)
    if len(words) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), digests
    at = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :])
    return at, at + np.lib.stride_tricks.sliding_window_view(digests, size - short + 1).argmin(1)[at], digests


def _read(docs: DataFrame, width: int, least: int, bands: int, rows: int) -> DataFrame:
    """One pass over the texts: a row for each paragraph of ``least`` words or more, with the digest of its set and the keys of its bands,
    and for each different anchor of a text, with how often it is one as ``n_words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(column(batch, "body")):
                ids = column(batch, "id")[c.rows]
                row, place, n_words, values, offsets = _long_paragraphs(c, width, least)
                starts, ends, first = word_bounds(c)
                of = np.repeat(np.arange(len(ids)), np.diff(first))
                _, at, digests = _anchors(word_hashes(c, starts, ends), of, least)
                at = np.unique(at)
                order = np.lexsort((digests[at], of[at]))
                own, digest = of[at][order], digests[at][order]
                heads = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (digest[1:] != digest[:-1]))))[: len(own)]
                none = pa.nulls(len(heads), pa.int64())
                if len(row):
                    high, low = set_digest(values, offsets)
                    keys = lists(band_keys(minhash(values, offsets, bands * rows), bands, rows))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(place.astype(np.int32)), pa.array(n_words.astype(np.int32)), pa.array(high), pa.array(low), keys, pa.nulls(len(row), pa.int64())], _READ)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(own[heads])), none.cast(pa.int32()), pa.array(np.diff(np.append(heads, len(own))).astype(np.int32)), none, none, pa.nulls(len(heads), pa.list_(pa.int64())), pa.array(digest[heads].view(np.int64))], _READ)

    return docs.mapInArrow(run, "doc long, place int, n_words int, high long, low long, keys array<long>, anchor long")


_READ = ["doc", "place", "n_words", "high", "low", "keys", "anchor"]


def _sets(docs: DataFrame, width: int, min_words: int) -> DataFrame:
    """Sets of the paragraphs that each row of ``(body, wanted)`` names: ``wanted`` is a list of (id, leader, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = column(batch, "wanted").to_pylist()
            for c in chunks(column(batch, "body")):
                row, place, _, values, offsets = _long_paragraphs(c, width, min_words)
                at = {k: i for i, k in enumerate(zip(row.tolist(), place.tolist(), strict=True))}
                out = [(w["id"], w["leader"], at[r, w["place"]]) for r, own in enumerate(wanted[c.rows]) for w in own if (r, w["place"]) in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([values[offsets[x[2]] : offsets[x[2] + 1]].tobytes() for x in out], pa.binary())],
                    ["id", "leader", "hashes"],
                )

    return docs.select("body", "wanted").mapInArrow(run, "id long, leader long, hashes binary")


def _repeated_paragraphs(docs: DataFrame, found: DataFrame, width: int, percent: int, least: int) -> DataFrame:
    """``(doc, place, n_words, keeper, kept)`` of the paragraphs ``found`` that are alike another one."""
    names = ["high", "low"]
    grouped = found.groupBy(*names).agg(F.min(F.struct("doc", "place")).alias("first"), F.first("keys").alias("keys"), F.max("n_words").alias("n"), F.count(F.lit(1)).alias("copies"))
    classes = stage(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")
    repeats = not found.groupBy("doc", "place").count().where("count > 1").isEmpty()

    def sets_of(led: DataFrame) -> DataFrame:
        wanted = classes.select("id", "first").join(led, "id").groupBy(F.col("first.doc").alias("id")).agg(F.collect_list(F.struct("id", "leader", F.col("first.place").alias("place"))).alias("wanted"))
        sets = _sets(docs.join(side(stage(wanted, "wanted"), 32 + 40 * F.size("wanted")), "id"), width, least)
        # where rows repeat an id, the paragraph may be there more than once or not at all
        return sets.dropDuplicates(["id"]) if repeats else sets

    labels = link(classes.select("id", "n", "keys"), sets_of, percent=percent)
    groups = stage(classes.select("id", *names, "first", "copies").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "groups")
    keepers = stage(groups.groupBy("component").agg(F.min("first").alias("keeper"), F.sum("copies").alias("copies")).where("copies > 1").drop("copies"), "keepers")
    repeated = stage(groups.select(*names, "component").join(keepers, "component").select(*names, "keeper"), "repeated")
    return stage(found.select("doc", "place", "n_words", *names).join(repeated, names).select("doc", "place", "n_words", "keeper", (F.struct("doc", "place") == F.col("keeper")).alias("kept")), "whole")


class _Words:
    """The words of a chunk's rows, with the paragraphs they are in and which of these go."""

    def __init__(self, c: Chunk, ids: np.ndarray, gone: dict[int, set[int]]) -> None:
        lines, owner, self.place = _lines(c)
        starts, ends, first = word_bounds(lines)
        self.ids, self.owner, self.n = ids, owner, np.diff(first)
        self.hashes, self.line = word_hashes(lines, starts, ends), np.repeat(np.arange(len(self.n)), self.n)
        self.row = owner[self.line]
        self.line_start = first[:-1]
        out = np.zeros(len(self.n), bool)
        for k, i in enumerate(ids.tolist()):
            if i in gone:
                own = np.flatnonzero(owner == k)
                out[own[np.isin(self.place[own], list(gone[i]))]] = True
        self.dead = np.concatenate(([0], np.cumsum(np.repeat(out, self.n))))

    def windows(self, size: int, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows of ``size`` words ``keep`` that have a word outside paragraphs that go, and whether all are outside."""
        lost = self.dead[keep + size] - self.dead[keep]
        return keep[lost < size], lost[lost < size] == 0


def _known(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Each value's place in the ascending array ``among``, -1 where it isn't there."""
    if not len(among):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return np.where(among[at] == values, at, -1)


def _again(row: np.ndarray, digest: np.ndarray, at: np.ndarray, alive: np.ndarray, size: int) -> np.ndarray:
    """Whether each window follows the first alive one of its digest in its row by ``size`` words or more."""
    order = np.lexsort((at, ~alive, digest, row))
    r, d, a = row[order], digest[order], at[order]
    head = np.ones(len(order), bool)
    head[1:] = (r[1:] != r[:-1]) | (d[1:] != d[:-1])
    lead = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    out = np.empty(len(order), bool)
    out[order] = alive[order][lead] & (a - a[lead] >= size)
    return out


def _block_of(table: pa.Table, facts: pa.Table):
    """A block's chunks with their ids, the digests it is told of (ascending, with their keepers), and the paragraphs that go by id."""
    digest, keeper = facts.column("digest").combine_chunks(), facts.column("keeper").combine_chunks()
    told = digest.is_valid()
    values, of = digest.filter(told).to_numpy(zero_copy_only=False).astype(np.int64).view(U), keeper.filter(told).fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.argsort(values)
    gone: dict[int, set[int]] = {}
    lost = facts.filter(digest.is_null())
    for doc, place in zip(lost.column("doc").to_pylist(), lost.column("place").to_pylist(), strict=True):
        gone.setdefault(doc, set()).add(place)
    ids, body = table.column("id").to_numpy(), table.column("body").combine_chunks()
    body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
    return ((c, ids[c.rows]) for c in chunks(body)), values[order], of[order], gone


def _summed(size: int):
    """For a block and the repeated anchors that it has: its windows around these, each once, with the least id that has it alive and how many there are."""

    def run(table: pa.Table, facts: pa.Table) -> pa.Table:
        digests, owners = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        if table.num_rows and facts.num_rows:
            parts, marks, _, gone = _block_of(table, facts)
            for c, ids in parts:
                w = _Words(c, ids, gone)
                at, anchor, anchors = _anchors(w.hashes, w.row, size)
                hot = _known(anchors, marks) >= 0
                at, alive = w.windows(size, at[hot[anchor]])
                digests.append(_runs(w.hashes, size)[at])
                owners.append(np.where(alive, ids[w.row[at]], _NOBODY))
        digest, owner = np.concatenate(digests), np.concatenate(owners)
        order = np.argsort(digest, kind="stable")
        digest, owner = digest[order], owner[order]
        heads = np.flatnonzero(np.concatenate(([True], digest[1:] != digest[:-1])))[: len(digest)]
        least = np.minimum.reduceat(owner, heads) if len(heads) else owner
        block = pa.array(np.full(len(heads), table.column("block")[0].as_py() if table.num_rows else 0, np.int32))
        return pa.table([block, pa.array(digest[heads].view(np.int64)), pa.array(least, mask=least == _NOBODY), pa.array(np.diff(np.append(heads, len(digest))).astype(np.int64))], ["block", "digest", "least", "n"])

    return run


_NOBODY = np.iinfo(np.int64).max


def _cut(size: int):
    """For a block and the keepers of the repeated windows that it has: the runs of words that go, cut at line feeds."""

    def run(table: pa.Table, facts: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if table.num_rows and facts.num_rows:
            parts, told, keepers, gone = _block_of(table, facts)
            for c, ids in parts:
                w = _Words(c, ids, gone)
                digest = _runs(w.hashes, size)
                known = _known(digest, told)
                at, alive = w.windows(size, np.flatnonzero((known >= 0) & (w.row[: len(digest)] == w.row[size - 1 :])) if len(digest) else np.zeros(0, np.int64))
                keeper = keepers[known[at]] if len(at) else np.zeros(0, np.int64)
                hit = (ids[w.row[at]] > keeper) | _again(w.row[at], digest[at], at, alive, size)
                at, keeper = at[hit], keeper[hit]
                if not len(at):
                    continue
                opens = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (keeper[1:] != keeper[:-1]) | (w.row[at[1:]] != w.row[at[:-1]]))))
                begin, end = at[opens], at[np.append(opens[1:], len(at)) - 1] + size
                pieces = w.line[end - 1] - w.line[begin] + 1
                line = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces - w.line[begin], pieces)
                run_of = np.repeat(np.arange(len(begin)), pieces)
                start, stop = np.maximum(begin[run_of], w.line_start[line]), np.minimum(end[run_of], w.line_start[line] + w.n[line])
                some = stop > start
                line, run_of, start, stop = line[some], run_of[some], start[some], stop[some]
                out.append((ids[w.owner[line]], w.place[line], start - w.line_start[line], stop - start, keeper[opens][run_of]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        return pa.table([pa.array(x.astype(k.to_pandas_dtype()), k) for x, k in zip(columns, kinds, strict=True)], ["doc", "place", "first_word", "n_words", "keeper_doc"])

    return run


def _repeated_windows(docs: DataFrame, anchors: DataFrame, gone: DataFrame, size: int) -> DataFrame:
    """``(doc, place, first_word, n_words, keeper_doc)`` of the repeats of ``size`` words or more in ``docs(id, body)`` that don't stay.

    ``anchors(doc, n, anchor)`` are chosen by content in every window of ``size`` words: equal windows have equal ones. Texts are dealt
    to blocks of about ``BLOCK_BYTES``. A block gets the anchors of its own that occur again anywhere, and gives the windows
    around them, each once, however many of its texts have it; windows are compared by 64 bits of their digest. It gets their keepers
    back, and gives the runs of words that go.
    """
    size_of = docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    block = lambda of: F.pmod(F.xxhash64(of), F.lit(max(1, -(-size_of // BLOCK_BYTES)))).cast("int").alias("block")
    pairs = stage(anchors.groupBy(block("doc"), "anchor").agg(F.sum("n").alias("n")), "pairs")
    again = stage(pairs.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "again")
    none = F.lit(None)
    lost = stage(gone.distinct().select(block("doc"), none.cast("long").alias("digest"), none.cast("long").alias("keeper"), "doc", "place"), "lost")
    nobody = [none.cast("long").alias("doc"), none.cast("int").alias("place")]
    marks = pairs.join(again, "anchor").select("block", F.col("anchor").alias("digest"), none.cast("long").alias("keeper"), *nobody)
    texts = docs.select("id", "body", block("id")).groupBy("block")
    found = stage(texts.cogroup(marks.unionByName(lost).toDF("of", "digest", "keeper", "doc", "place").groupBy("of")).applyInArrow(_summed(size), "block int, digest long, least long, n long"), "windows")
    keepers = stage(found.groupBy("digest").agg(F.min("least").alias("keeper"), F.sum("n").alias("n")).where("n > 1 and keeper is not null").drop("n"), "keepers")
    told = found.select("block", "digest").join(keepers, "digest").select("block", "digest", "keeper", *nobody)
    return texts.cogroup(told.unionByName(lost).toDF("of", "digest", "keeper", "doc", "place").groupBy("of")).applyInArrow(_cut(size), "doc long, place int, first_word int, n_words int, keeper_doc long")


SPANS = ["doc_id", "paragraph", "first_word", "n_words", "keeper_doc_id", "keeper_paragraph", "kept"]


def repeated_spans(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 80, least_words: int = LEAST_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, paragraph, first_word, n_words, keeper_doc_id, keeper_paragraph, kept)`` of every repeat of ``least_words`` words or more.

    Paragraphs are the pieces between line feeds, numbered from 0. Two of at least ``least_words`` words are alike when their
    sets of ``width``-word shingles (A-Z as a-z) have a Jaccard of ``percent`` hundredths or more; banding proposes, the full
    sets decide. Of each component of alike paragraphs the first by (doc_id, paragraph) is kept, the others go. Each has a
    row, from its first word on. Equal sets are one class, told by 128 bits of their digest.

    Beside that, exact repeats of at least ``least_words`` words are found wherever they begin and however many line feeds they run
    across. Of equal windows of so many words one stays: the first in the smallest id that has one without words of paragraphs
    that go; windows that overlap it in its own text stay with it. The others' words go, with a row for each run of
    words and paragraph (``keeper_paragraph`` null, ``kept`` false). So a word only goes if the same passage stands in a text
    of a smaller id, or earlier in its own, where it stays or has gone for one yet earlier in turn.

    Null, blank and short texts hold no repeats. Rows with a null id are left alone. Rows that repeat an id are one document to
    the windows' choice: a passage that stands in both stays in both. Of equal rows of an id all are alike. Other columns are not read.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("body")).where("id is not null and body is not null")
    with scratch(docs.sparkSession) as keep:
        return keep(_spans(docs, width, percent, least_words, bands, rows), "spans")


def _spans(docs: DataFrame, width: int, percent: int, least_words: int, bands: int, rows: int) -> DataFrame:
    every = stage(_read(docs, width, least_words, bands, rows), "paragraphs")
    whole = _repeated_paragraphs(docs, every.where("anchor is null").drop("anchor"), width, percent, least_words)
    windows = _repeated_windows(docs, every.where("anchor is not null").select("doc", F.col("n_words").alias("n"), "anchor"), whole.where("not kept").select("doc", "place"), least_words)
    paragraphs = whole.select("doc", "place", F.lit(0).alias("first_word"), "n_words", F.col("keeper.doc").alias("keeper_doc"), F.col("keeper.place").alias("keeper_place"), "kept")
    return paragraphs.unionByName(windows.withColumns({"keeper_place": F.lit(None).cast("int"), "kept": F.lit(False)})).toDF(*SPANS)


def _without(text: str | None, spans) -> str | None:
    """The text without the spans (paragraph, first word, number of words); a paragraph that loses all words goes with its line feed."""
    if text is None or spans is None:
        return text
    gone: dict[int, set[int]] = {}
    for paragraph, first, n in spans:
        gone.setdefault(int(paragraph), set()).update(range(first, first + n))
    out = []
    for i, line in enumerate(text.split("\n")):
        starts = [m.start() for m in WORD.finditer(line)] if i in gone else []
        if starts:
            left = [line[a:b] for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(line)], strict=True)) if k not in gone[i]]
            if not left:
                continue
            line = "".join(left).rstrip()
        out.append(line)
    return "\n".join(out)


def cut_repeats(docs: DataFrame, spans: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with all columns, its texts without what ``spans`` doesn't keep; other texts, null ones too, are unchanged.

    Rows with a null id keep their texts; rows that repeat an id all lose the spans of that id. A paragraph that loses all its words goes
    with its line feed; a text that loses all is empty.
    """
    gone = spans.where("not kept").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(F.array("paragraph", "first_word", "n_words")).alias("__gone"))

    @F.pandas_udf("string")
    def without(texts: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([_without(t, g) for t, g in zip(texts, gone, strict=True)], dtype=object)

    joined = docs.join(side(stage(gone, "gone"), 32 + 48 * F.size("__gone")), F.col(id_column) == F.col("__id"), "left").withColumn("__cut", F.when(F.col("__gone").isNotNull(), F.col(text_column)))
    return joined.withColumn(text_column, F.when(F.col("__gone").isNull(), F.col(text_column)).otherwise(without("__cut", "__gone"))).drop("__id", "__gone", "__cut")


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repeated_spans`` of all ``documents``."""
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))

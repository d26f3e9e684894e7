"""Language-model scores by prediction by partial matching over bytes, beside a smoothed word-unigram base.

The model is a trie of byte contexts of up to ``ORDER`` bytes with the symbols seen after each (257: the bytes and the end of
text). A symbol is coded by the longest context that has seen it, with chance (2c - 1) / 2t; a context that hasn't escapes with
chance d / 2t (c the symbol's count there, t that of all, d their number), and what it has seen is excluded further down.
Below the empty context all symbols left are alike. The longest contexts count occurrences; a shorter one counts a symbol
once for each longer context it is seen in (update exclusion). Contexts nest: whatever a context has seen, its suffix has
seen, so exclusion takes two sums.

Neither trie nor vocabulary is held in one place. Documents are dealt to blocks; each block asks for the words and grams
(context and symbol) that it holds, and brings their counts in training texts. Items travel as packed sorted arrays, one for
each block and group: grams are grouped by a hash of the last two context bytes, words by their own. However hot a group is, a task
merges its counts of ``FAN_IN`` blocks, then of as many merged parts, until one part holds each distinct item once; grams
turn into log-probabilities there. Blocks are answered from it, in the order of the block's own items, by slices that ask for about
``ANSWER_BYTES``: groups grow in number with the corpus and not in size, so a group's copies for its slices stay few, and a hot group has more.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bucket_of, side, stage
from .text import U, Chunk, chunks, mix64, row_sums, word_bounds, word_hashes

ORDER = 5
SYMBOLS = 257
END = -1  # the end token among the words
BLOCK_BYTES = 12_000_000
GROUP_BYTES = 64_000_000  # of text for each group of items
LEAST_GROUPS = 32
FAN_IN = 16
ANSWER_BYTES = 24_000_000  # of items that a task answers, about
TRAIN_PARTS, HELD_OUT_PART = 5, 1


def grams(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and every end of text: its ``ORDER`` preceding bytes (0 before the start) and itself, as one number.
    Returns the numbers and each text's first position (one entry more than texts)."""
    rows, gap = len(c.offsets) - 1, ORDER + 1
    line = np.zeros(len(c.data) + gap * rows, np.int64)
    at = np.arange(len(c.data)) + np.repeat(np.arange(rows) * gap + ORDER, np.diff(c.offsets))
    line[at] = c.data
    ends = c.offsets[1:] + np.arange(rows) * gap + ORDER
    line[ends] = 256
    real = np.zeros(len(line), bool)
    real[at] = True
    real[ends] = True
    out = line.copy()
    for back in range(1, ORDER + 1):
        out[back:] |= line[:-back] << (9 + 8 * (back - 1))
    return out[real], c.offsets + np.arange(rows + 1)


def words_of(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Each word's number (negative, never ``END``) and each text's first word."""
    starts, ends, first = word_bounds(c)
    found = (word_hashes(c, starts, ends) | U(1 << 63)).view(np.int64)
    found[found == END] -= 1
    return found, first


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    items, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(items, kind="stable")
    items, counts = items[order], counts[order]
    cut = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1])))
    return items[cut], np.add.reduceat(counts, cut)


def _packed(values: np.ndarray) -> bytes:
    """The array's bytes, plane by plane, compressed."""
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _texts(table: pa.Table) -> pa.Array:
    texts = table.column("body").combine_chunks()
    return texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts


def _items(table: pa.Table, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct items, ascending, their counts in its training texts, the items' order by group, and where each group
    starts in that order: grams are in the first ``groups`` groups, words in as many more."""
    train = table.column("train").to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, bool)
    parts = [(np.array([END]), np.array([int(train.sum())]))]
    for c in chunks(_texts(table)):
        for values, first in (words_of(c), grams(c)):
            learns = np.repeat(train[c.rows], np.diff(first))
            for part, weight in ((values[learns], 1), (values[~learns], 0)):
                if len(part):
                    items, counts = np.unique(part, return_counts=True)
                    parts.append((items, counts * weight))
        if len(parts) > 24:
            parts = [_merged(parts)]
    items, counts = _merged(parts)
    spread = mix64(np.where(items < 0, items, (items >> 9) & 65535).view(U)) % U(groups)
    group = spread.astype(np.int64) + np.where(items < 0, groups, 0)
    order = np.argsort(group, kind="stable")
    return items, counts.astype(np.int64), order, np.searchsorted(group[order], np.arange(2 * groups + 1))


def _asker(groups: int):
    def run(table: pa.Table) -> pa.Table:
        """For each group that the block has items of: the items and their counts in training texts."""
        table = table.combine_chunks()
        items, counts, order, cuts = _items(table, groups)
        out: list[tuple] = []
        for g in np.flatnonzero(np.diff(cuts)).tolist():
            span = order[cuts[g] : cuts[g + 1]]
            out.append((g, _packed(items[span]), _packed(counts[span]), int(counts[span].sum())))
        columns = list(zip(*out, strict=True))
        block = pa.array(np.full(len(out), table.column("block")[0].as_py(), np.int32))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64())
        return pa.table([block, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["block", "group", "items", "counts", "total"])

    return run


def _merge(table: pa.Table) -> pa.Table:
    """One part's items of a group, with the sums of their counts."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for items, counts in zip(table.column("items").to_pylist(), table.column("counts").to_pylist(), strict=True):
        parts.append((_unpacked(items, np.int64), _unpacked(counts, np.int64)))
    items, counts = _merged(parts)
    return pa.table({"group": table.column("group").slice(0, 1), "part": table.column("part").slice(0, 1), "items": pa.array([_packed(items)], pa.binary()), "counts": pa.array([_packed(counts)], pa.binary())})


def _whole(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A group's items and counts, from its one row."""
    (items,), (counts,) = table.column("items").to_pylist(), table.column("counts").to_pylist()
    return _unpacked(items, np.int64), _unpacked(counts, np.int64)


def _kinds(groups: int):
    def run(table: pa.Table) -> pa.Table:
        """How many of a group's learnt items there are: of words all together (as -1), of the last two context bytes with a symbol by last byte and symbol."""
        items, counts = _whole(table)
        learnt = items[counts > 0]
        if table.column("group")[0].as_py() >= groups:
            names, n = np.array([-1]), np.array([len(learnt)])
        else:
            names, n = np.unique(np.unique(learnt & ((1 << 25) - 1)) & ((1 << 17) - 1), return_counts=True)
        return pa.table({"pair": pa.array(names, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def _valuer(groups: int, first_order: np.ndarray, zero_order: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        """The values of a group's items: of words their training counts, of grams their log10 probabilities."""
        items, counts = _whole(table)
        value = counts if table.column("group")[0].as_py() >= groups else code_lengths(items, counts, first_order, zero_order).astype(np.float32)
        return pa.table({"of": table.column("group"), "known": table.column("items"), "value": pa.array([_packed(value)], pa.binary())})

    return run


def _answerer(groups: int):
    def run(asked: pa.Table, told: pa.Table) -> pa.Table:
        """Each block's values of a group, in the order of its items."""
        out: list[bytes] = []
        if asked.num_rows:
            items = _unpacked(told.column("known")[0].as_py(), np.int64)
            value = _unpacked(told.column("value")[0].as_py(), np.int64 if asked.column("group")[0].as_py() >= groups else np.float32)
            out = [_packed(value[np.searchsorted(items, _unpacked(own.as_py(), np.int64))]) for own in asked.column("items")]
        return pa.table({"block": asked.column("block"), "group": asked.column("group"), "answer": pa.array(out, pa.binary())})

    return run


def code_lengths(items: np.ndarray, n: np.ndarray, first_order: np.ndarray, zero_order: np.ndarray) -> np.ndarray:
    """log10 probabilities of grams. ``items`` must hold all grams of each of its contexts' last two bytes; ``n`` are training counts.
    ``first_order`` (256 x 257) and ``zero_order`` (257) are the counts after one byte and after any."""
    seen = n > 0
    pairs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    keys, weights = items[seen], n[seen]
    for order in range(ORDER, 1, -1):
        keys = keys & ((1 << (9 + 8 * order)) - 1)
        pairs[order] = keys, weights = _merged([(keys, weights)]) if len(keys) else (keys, weights)
        weights = np.ones(len(keys), np.int64)

    def counts(order: int, keys: np.ndarray) -> np.ndarray:
        """Training counts of (context of that order, symbol) keys."""
        if order == 1:
            return first_order[(keys >> 9) & 255, keys & 511]
        if order == 0:
            return zero_order[keys & 511]
        known, total = pairs[order]
        if not len(known):
            return np.zeros(len(keys), np.int64)
        keys = keys & ((1 << (9 + 8 * order)) - 1)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, total[at], 0)

    def context(order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each item's context: its total, its number of symbols, and the total those have in the next shorter context."""
        if order == 0:
            return tuple(np.full(len(items), x) for x in (zero_order.sum(), (zero_order > 0).sum(), 0))
        if order == 1:
            byte = (items >> 9) & 255
            return tuple(x[byte] for x in (first_order.sum(axis=1), (first_order > 0).sum(axis=1), (first_order > 0) @ zero_order))
        known, total = pairs[order]
        if not len(known):
            return tuple(np.zeros(len(items), np.int64) for _ in range(3))
        names = known >> 9
        cut = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
        own = (items >> 9) & ((1 << (8 * order)) - 1)
        at = np.minimum(np.searchsorted(names[cut], own), len(cut) - 1)
        hit = names[cut][at] == own
        sizes = np.diff(np.append(cut, len(names)))
        return tuple(np.where(hit, x[at], 0) for x in (np.add.reduceat(total, cut), sizes, np.add.reduceat(counts(order - 1, known), cut)))

    out, open_ = np.zeros(len(items)), np.ones(len(items), bool)
    ruled_out, ruled_total = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    for order in range(ORDER, -1, -1):
        total, kinds, below = context(order)
        t, d = total - ruled_total, kinds - ruled_out
        own = counts(order, items)
        live = open_ & (d > 0)
        coded = live & (own > 0)
        out[coded] += np.log10((2 * own[coded] - 1) / (2 * t[coded]))
        escapes = live & (own == 0)
        out[escapes] += np.log10(d[escapes] / (2 * t[escapes]))
        open_ &= ~coded
        ruled_out, ruled_total = kinds, below
    out[open_] -= math.log10(SYMBOLS - int((zero_order > 0).sum())) if open_.any() else 0.0
    return out


def score(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row.

    Rows whose crc32 bucket of 5 is not 1 (null ids included) are learnt from. Null texts are empty: one end token. Words
    are known by 63 bits of a hash. A gram's log-probability has the 24 bits of a float. Without training rows every count is 0
    and all symbols are alike. Rows that repeat an id are scored each by its own text. An empty table gives no rows. Whole texts are
    read, however long; a block holds about ``block_bytes`` of them, or one longer text. Other columns are not read.
    """
    held_out = F.coalesce(bucket_of("id", TRAIN_PARTS) == HELD_OUT_PART, F.lit(False))
    named = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("body")).withColumn("train", ~held_out)
    size = named.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks, groups = max(1, math.ceil(size / block_bytes)), max(LEAST_GROUPS, math.ceil(size / group_bytes))
    dealt = named.withColumn("block", F.pmod(F.xxhash64("id", "body"), F.lit(blocks)).cast("int"))
    asked = stage(dealt.groupBy("block").applyInArrow(_asker(groups), "block int, group int, items binary, counts binary, total long"), "asked")
    total = asked.where(F.col("group") >= groups).agg(F.sum("total")).first()[0] or 0
    parts, merged = blocks, asked.select("group", F.col("block").alias("part"), "items", "counts")
    while True:
        fewer = merged.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        merged = stage(fewer.groupBy("group", "part").applyInArrow(_merge, "group int, part int, items binary, counts binary"), "merged")
        parts = math.ceil(parts / FAN_IN)
        if parts <= 1:
            break
    # one row for the words and at most 256 x 257 for last byte and symbol
    known = {r["pair"]: r["n"] for r in merged.groupBy("group").applyInArrow(_kinds(groups), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    kinds = known.pop(-1, 0)
    first_order = np.zeros((256, SYMBOLS), np.int64)
    for pair, n in known.items():
        first_order[pair >> 9, pair & 511] = n
    zero_order = (first_order > 0).sum(axis=0)
    valued = stage(merged.groupBy("group").applyInArrow(_valuer(groups, first_order, zero_order), "of int, known binary, value binary"), "values")
    slices = stage(asked.groupBy("group").agg(F.ceil(F.sum(F.octet_length("items")) / ANSWER_BYTES).cast("int").alias("slices")), "slices")
    sliced = valued.join(side(slices.withColumnRenamed("group", "of"), 8), "of").withColumn("of_slice", F.explode(F.sequence(F.lit(0), F.greatest("slices", F.lit(1)) - 1))).drop("slices")
    asks = asked.join(side(slices, 8), "group").select("block", "group", "items", F.pmod(F.xxhash64("block", F.lit(3)), F.greatest("slices", F.lit(1))).cast("int").alias("slice"))
    told = asks.groupBy("group", "slice").cogroup(sliced.groupBy("of", "of_slice")).applyInArrow(_answerer(groups), "block int, group int, answer binary")

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({k: pa.array([], t) for k, t in _SCHEMA.items()})
        texts = texts.combine_chunks()
        items, _, order, cuts = _items(texts, groups)
        value = np.empty(len(items))
        for g, answer in zip(answers.column("group").to_pylist(), answers.column("answer").to_pylist(), strict=True):
            got, span = _unpacked(answer, np.int64 if g >= groups else np.float32), order[cuts[g] : cuts[g + 1]]
            if len(got) != len(span):
                raise ValueError("the texts of a block have changed since they were counted")
            value[span] = got
        index = pd.Index(items)
        base_of = np.log10((np.maximum(value, 0) + 0.5) / (total + 0.5 * (kinds + 1)))
        end = value[index.get_indexer([END])[0]]
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for c in chunks(_texts(texts)):
            found, first = words_of(c)
            at = index.get_indexer(found)
            columns[0].append(np.diff(first) + 1)
            columns[1].append(row_sums((value[at] > 0).astype(np.int64), first) + int(end > 0))
            columns[2].append(row_sums(base_of[at], first) + math.log10((end + 0.5) / (total + 0.5 * (kinds + 1))))
            found, first = grams(c)
            columns[3].append(row_sums(value[index.get_indexer(found)], first))
        n_tokens, n_known, base, own = (np.concatenate(x) for x in columns)
        ids = texts.column("id")
        return pa.table({
            "doc_id": ids, "held_out": pa.array(~texts.column("train").to_numpy(zero_copy_only=False)), "n_tokens": n_tokens.astype(np.int64), "n_known": n_known.astype(np.int64),
            "train_tokens": np.full(len(ids), total, np.int64), "base_score": base, "score": own,
        })

    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_SCHEMA = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def op4_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score`` of all ``documents``."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range is retained.

A sketch is ``<number of distinct shingles>.<set digest>.<base64 of the retained hashes, 48 bits each, ascending>``.
Sketches of any two texts sample the same hashes, so Jaccard and containment estimates need only the two sketches, the
sketch of a union is the union of sketches, and a short text's share in a much longer one is estimated without bias.
"""

from __future__ import annotations

import hashlib
from base64 import b64decode, b64encode
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import U, chunks, column, mix64, set_digest, shingle_sets

FRACTION = 4  # one hash in so many is retained
WIDTH = 5
BUCKETS_PER_PARTITION = 4


def sketches(texts: pa.Array, width: int = WIDTH, fraction: int = FRACTION) -> tuple[list[str], list[np.ndarray], np.ndarray]:
    """Of each text (null: empty) the sketch, its retained hashes, and a 64-bit digest of its whole shingle set."""
    words, kept, digests = [], [], []
    for c in chunks(texts):
        values, offsets = shingle_sets(c, width)
        digest = set_digest(values, offsets)[0]
        below = values < U((1 << 64) // fraction)
        total = np.concatenate(([0], np.cumsum(below)))[offsets]
        short = values[below] >> U(16)
        raw = np.ascontiguousarray(short.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
        for i, n in enumerate(np.diff(offsets).tolist()):
            a, b = int(total[i]), int(total[i + 1])
            words.append(f"{n:x}.{int(digest[i]) & 0xFFFFFFFFFFFFFFFF:016x}.{b64encode(raw[6 * a : 6 * b]).decode()}{_tag(fraction)}")
            kept.append(short[a:b])
        digests.append(digest)
    return words, kept, np.concatenate(digests) if digests else np.zeros(0, np.int64)


def _tag(fraction: int) -> str:
    """What a sketch of another fraction than ``FRACTION`` ends with."""
    return "" if fraction == FRACTION else f".{fraction}"


def fraction_of(sketch: str) -> int:
    parts = sketch.split(".")
    return int(parts[3]) if len(parts) > 3 else FRACTION


def _below(hashes: np.ndarray, fraction: int) -> np.ndarray:
    """Those of the retained hashes that a sketch of ``fraction`` retains."""
    return hashes[hashes < U((1 << 64) // fraction >> 16)]


def _paired(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """Both sketches' hashes below the lower of their thresholds."""
    fraction = max(fraction_of(a), fraction_of(b))
    return _below(retained(a), fraction), _below(retained(b), fraction)


def retained(sketch: str) -> np.ndarray:
    raw = np.frombuffer(b64decode(sketch.split(".")[2]), np.uint8).reshape(-1, 6)
    return np.concatenate((np.zeros((len(raw), 2), np.uint8), raw), axis=1).copy().view(">u8").reshape(-1).astype(U)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _likeness(a: np.ndarray, b: np.ndarray, same: bool) -> float:
    if same:
        return 1.0
    shared = _common(a, b)
    return shared / max(len(a) + len(b) - shared, 1)


@F.pandas_udf(T.DoubleType())
def likeness(left: pd.Series, right: pd.Series) -> pd.Series:
    """Estimated Jaccard similarity of two sketches; equal shingle sets: 1, nothing retained in common: 0."""
    return pd.Series([_likeness(*_paired(a, b), a.split(".")[:2] == b.split(".")[:2]) for a, b in zip(left, right, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def containment(part: pd.Series, whole: pd.Series) -> pd.Series:
    """Estimated share of the first sketch's shingles that the second has; null if the first retains none."""
    pairs = (_paired(a, b) for a, b in zip(part, whole, strict=True))
    return pd.Series([_common(x, y) / len(x) if len(x) else None for x, y in pairs], dtype=float)


def _sketch_of(hashes: np.ndarray, fraction: int) -> str:
    """The sketch of a union: its count is an estimate, and its digest is that of the retained hashes, so equal unions have equal sketches."""
    digest = int(mix64(hashes + U(1)).sum(dtype=U))
    return f"{len(hashes) * fraction:x}.{digest:016x}.{b64encode(hashes.astype('>u8').view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()}{_tag(fraction)}"


@F.pandas_udf(T.StringType())
def merged(left: pd.Series, right: pd.Series) -> pd.Series:
    """Sketch of the union of two sketches' texts; two equal sketches are their own union. Of two fractions the union has the smaller share."""
    return pd.Series([a if a == b else _sketch_of(np.union1d(*_paired(a, b)), max(fraction_of(a), fraction_of(b))) for a, b in zip(left, right, strict=True)], dtype=object)


def merged_by(sketched: DataFrame, keys: list[str], *, sketch_column: str = "fingerprint") -> DataFrame:
    """``(keys, sketch_column)``: the sketch of the union of each group's texts; null sketches count for nothing. Of
    several fractions in a group the union has the smallest share.

    The retained hashes are summed up as sets: distinct before they move and after, then packed by ranges of the hash, so no task holds
    more of a group than its distinct hashes, which are the sketch itself.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [retained(x) for x in column(batch, sketch_column).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([*(column(batch, k).take(at) for k in keys), pa.array(np.concatenate([np.zeros(0, U), *found]).view(np.int64))], [*keys, "hash"])

    named = sketched.where(F.col(sketch_column).isNotNull()).select(*keys, sketch_column)
    schema = T.StructType([*(sketched.schema[k] for k in keys), T.StructField("hash", T.LongType())])

    @F.pandas_udf(T.StringType())
    def packed(sets: pd.Series, fractions: pd.Series) -> pd.Series:
        return pd.Series([_sketch_of(_below(np.sort(np.asarray(x, np.int64)).view(U), int(f)), int(f)) for x, f in zip(sets, fractions, strict=True)], dtype=object)

    unions = named.mapInArrow(hashes, schema).distinct().groupBy(*keys).agg(F.collect_list("hash").alias("__hashes"))
    own = F.coalesce(F.try_element_at(F.split(sketch_column, "[.]"), F.lit(4)).cast("int"), F.lit(FRACTION))
    every = named.groupBy(*keys).agg(F.max(own).alias("__fraction"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = every.join(unions.withColumnsRenamed({k: f"__{k}" for k in keys}), same, "left")
    return joined.select(*keys, packed(F.coalesce("__hashes", F.array().cast("array<long>")), "__fraction").alias(sketch_column))


def _with_next(docs: DataFrame) -> DataFrame:
    """``(bucket, extra, id, body)`` by descending id in buckets of neighbouring ids; each bucket ends with an extra row, the
    first of the bucket that follows (after the last: the very first), so that every row's next one is beside it."""
    spark = docs.sparkSession
    n = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(x) for x in docs.approxQuantile("id", [i / n for i in range(1, n)], 0.25 / n)}) if n > 1 else []
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        found = len(bounds) - np.searchsorted(bounds, ids.fillna(0).to_numpy(np.int64), "left")
        return pd.Series(np.where(ids.isna(), len(bounds), found), dtype="int32")

    narrow = docs.select("id").withColumn("bucket", bucket("id"))
    heads = narrow.groupBy("bucket").agg(F.max("id").alias("head")).orderBy("bucket").collect()
    follows = [(r["bucket"], h["head"]) for r, h in zip(heads, [*heads[1:], *heads[:1]], strict=True)]
    wanted = spark.createDataFrame(follows, "of int, head long").groupBy("head").agg(F.collect_list("of").alias("ofs"))
    placed = docs.withColumn("bucket", bucket("id")).join(F.broadcast(wanted), F.col("id").eqNullSafe(F.col("head")), "left")
    targets = F.concat(F.array("bucket"), F.coalesce("ofs", F.array().cast("array<int>")))
    return placed.select("id", "body", F.posexplode(targets).alias("extra", "bucket")).withColumn("extra", F.least("extra", F.lit(1)))


def fingerprints_with_edits(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, fraction: int = FRACTION) -> DataFrame:
    """For each row its sketch, and that of an edited text: the last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next row's text by descending id (after the last: the first; rows of one id by text; null ids last).

    Returns ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``. Null texts
    count as empty; texts without words have equal sketches; a single row is its own next one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            """All rows but the last, which is only looked at."""
            bucket, extra, ids = (rows.column(k).to_numpy(zero_copy_only=False) for k in ("bucket", "extra", "id"))
            texts = [t or "" for t in rows.column("body").to_pylist()]
            own = np.flatnonzero((extra[:-1] == 0) & (bucket[1:] == bucket[:-1]))
            edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in own.tolist()]
            words, kept, digests = sketches(pa.array(texts, pa.large_string()), width, fraction)
            new_words, new_kept, new_digests = sketches(pa.array(edited, pa.large_string()), width, fraction)
            columns = [
                rows.column("id").combine_chunks().take(pa.array(own)),
                pa.array([len(texts[i]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([words[i] for i in own], pa.string()),
                pa.array(new_words, pa.string()),
                pa.array([_likeness(kept[i], new_kept[k], digests[i] == new_digests[k]) for k, i in enumerate(own)], pa.float64()),
                pa.array([_likeness(kept[i], kept[i + 1], digests[i] == digests[i + 1]) for i in own], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = pa.Table.from_batches([held, part] if held is not None else [part]).combine_chunks()
                held = part.slice(part.num_rows - 1)
                if rows.num_rows > 1:
                    yield from done(rows)

    named = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("body"))
    dealt = _with_next(named).repartition("bucket").sortWithinPartitions("bucket", "extra", F.col("id").desc_nulls_last(), "body")
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_scaled_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fingerprints_with_edits`` of all ``documents``."""
    return fingerprints_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))

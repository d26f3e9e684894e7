"""Group sets that share band keys, verified on the full sets, without emitting all pairs of a bucket.

A first round compares each set with one other: the smallest leader (smallest id) among its buckets. Members that share a
component need no further test. What is left are buckets that still hold more than one component. In those of at most
``CHUNK`` members and ``ELEMENTS`` elements, the members outside the bucket's most frequent component meet all others inside one task, which
counts common elements by a matrix product over the elements that more than one member has, and emits no more links than
members. Larger buckets are worked through in rounds: up to ``LEADERS`` members of a bucket, those of its rarer components first,
meet all others, dealt out in chunks of that size; leaders are then done, and rounds end when each bucket's untried members
lie in one component. In the end every colliding pair has been compared on its full sets or lies in one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import scratch, stage
from .text import U, give_back

LEADERS = 512
CHUNK = 4096
ELEMENTS = 8_000_000  # of a chunk's sets, 8 bytes each
SALTS = 16
CELLS = 8_000_000  # of a task's matrix of members and elements; more elements are worked through in blocks
SLICE = 256  # leading members at a time
PART = 256  # pairs at a time
PAIRS = "a long, b long"


def _verified(sets: DataFrame, percent: int) -> DataFrame:
    """Links of sets with their leaders' sets: 100 * |A and B| >= percent * |A or B|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, PART):
                left, right = (batch.column(c).slice(at, PART).to_pylist() for c in (2, 3))
                for x, y in zip(left, right, strict=True):
                    both = np.frombuffer(x + y, U)
                    total, both = len(both), np.sort(both, kind="stable")
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    keep.append(100 * common >= percent * (total - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        give_back()

    leaders = sets.select(F.col("id").alias("leader"), F.col("hashes").alias("leader_set"))
    led = sets.where("id <> leader").join(leaders, "leader")
    return led.select(F.col("leader").alias("a"), F.col("id").alias("b"), "leader_set", "hashes").mapInArrow(run, PAIRS)


class _Counter:
    """Counts the elements that members of a bucket have in common, by products of 0/1 matrices over the elements shared by any two."""

    def __init__(self, sets: list[bytes]) -> None:
        values = [np.frombuffer(s, U) for s in sets]
        owner = np.repeat(np.arange(len(sets)), [len(v) for v in values])
        _, element, n = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        shared = n > 1
        use = shared[element]
        self.members, self.owner, self.element = len(sets), owner[use], (np.cumsum(shared) - 1)[element[use]]
        self.width, self.step = int(shared.sum()), max(1, CELLS // len(sets))
        self.only = self._block(0) if self.width <= self.step else None

    def _block(self, at: int) -> np.ndarray:
        part = (self.element >= at) & (self.element < at + self.step)
        block = np.zeros((self.members, min(self.step, self.width - at)), np.float32)
        block[self.owner[part], self.element[part] - at] = 1
        return block

    def common(self, lead: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return self.only[lead] @ self.only.T
        out = np.zeros((len(lead), self.members), np.float32)
        for at in range(0, self.width, self.step):
            block = self._block(at)
            out += block[lead] @ block.T
        return out


def _alike(components: np.ndarray, sets: list[bytes], lead: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of a ``lead`` row and a row of another component whose sets are alike."""
    size, counter = np.array([len(s) // 8 for s in sets], np.int32), None
    for part in (lead[i : i + SLICE] for i in range(0, len(lead), SLICE)):
        own = size[part][:, None]
        fit = (100 * np.minimum(own, size) >= percent * np.maximum(own, size)) & (components[part][:, None] != components)
        i, j = np.nonzero(fit)
        if counter is None and len(i) > 2 * len(sets):
            counter = _Counter(sets)
        if counter is not None:
            common = counter.common(part)
            i, j = np.nonzero(fit & (100 * common >= percent * (own + size - common)))
            yield from zip(part[i].tolist(), j.tolist(), strict=True)
            continue
        for x, y in zip(part[i].tolist(), j.tolist(), strict=True):
            both = np.sort(np.frombuffer(sets[x] + sets[y], U), kind="stable")
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            if 100 * common >= percent * (len(both) - common):
                yield x, y


def _links_within(ids: np.ndarray, components: np.ndarray, sets: list[bytes], lead: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of the ``lead`` rows with any row of another component, as a forest over the components they join."""
    root = {c: c for c in components.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found = []
    for i, j in _alike(components, sets, lead, percent):
        x, y = find(int(components[i])), find(int(components[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            found.append((int(ids[i]), int(ids[j])))
    return found


def _grouped_links(percent: int):
    """For mapInArrow over rows sorted by (key, chunk): a run of rows is one bucket, or one chunk of a large one."""

    def one(ids: np.ndarray, components: np.ndarray, whole: bool, leads: np.ndarray, sets: list[bytes]) -> list[tuple[int, int]]:
        if len(ids) < 2:
            return []
        if whole:
            names, place, n = np.unique(components, return_inverse=True, return_counts=True)
            leads = place != n.argmax()
        lead = np.flatnonzero(leads)
        return _links_within(ids, components, sets, lead, percent) if len(lead) else []

    def links(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    def groups(rows: pa.Table) -> list[tuple[int, int]]:
        if not rows.num_rows:
            return []
        key, chunk, ids, components, leads = (rows.column(k).to_numpy() for k in ("key", "chunk", "id", "component", "leads"))
        hashes = rows.column("hashes")
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])) + 1).tolist(), len(key)]
        found = []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            found += one(ids[x:y], components[x:y], chunk[x] < 0, leads[x:y], hashes.slice(x, y - x).to_pylist())
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]) if rest is not None else rows
            key, chunk = rows.column("key").to_numpy(), rows.column("chunk").to_numpy()
            cut = int(np.flatnonzero((key != key[-1]) | (chunk != chunk[-1]))[-1]) + 1 if len(key) and (key[0] != key[-1] or chunk[0] != chunk[-1]) else 0
            yield links(groups(rows.slice(0, cut)))
            rest = rows.slice(cut)  # its group may go on
        if rest is not None:
            yield links(groups(rest))
        rest = None
        give_back()

    return run


_DEALT = ["key", "chunk", "id", "component", "leads", "hashes"]


def _compared(dealt: DataFrame, percent: int) -> DataFrame:
    return stage(dealt.select(*_DEALT).repartition("key", "chunk").sortWithinPartitions("key", "chunk").mapInArrow(_grouped_links(percent), PAIRS), "links")


def link(items: DataFrame, sets_of: Callable[[DataFrame], DataFrame], *, percent: int) -> DataFrame:
    """``(id, component)`` of every item linked to another.

    ``items(id long, n, keys array<long>)``: one row for each distinct set, none empty, with its size or about that and the keys of its
    bands. ``sets_of(led)`` takes ``(id, leader)`` and returns ``(id, leader, hashes)``, with the sets (ascending uint64, binary) of the ids.
    """
    with scratch(items.sparkSession) as keep:
        return keep(_linked(items, sets_of, percent), "linked")


def _linked(items: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    keyed = items.select(F.explode("keys").alias("key"), "id", "n")
    pieces = F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK, F.sum("n") / ELEMENTS)).cast("int")
    buckets = stage(keyed.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("size"), pieces.alias("pieces")).where("size > 1").drop("size"), "buckets")
    members = stage(keyed.drop("n").join(buckets, "key"), "members")
    sets = stage(sets_of(members.groupBy("id").agg(F.min("leader").alias("leader"))), "sets")
    links = stage(_verified(sets, percent), "links")
    sets = sets.select("id", "hashes")
    labels = connected_components(links)

    def labelled(table: DataFrame) -> DataFrame:
        return stage(table.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")), "labelled")

    now = labelled(members.where("pieces = 1").select("key", "id"))
    torn = stage(now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key"), "torn")
    more = _compared(now.join(torn, "key").join(sets, "id").withColumns({"chunk": F.lit(-1), "leads": F.lit(False)}), percent)
    giants = members.where("pieces > 1").select("key", "id", "pieces", F.lit(False).alias("tried"))
    while True:
        if not more.isEmpty():
            links = links.union(more)
            labels = connected_components(links)
        if giants.isEmpty():
            return labels.select(F.col("node").alias("id"), "component")
        giants, more = _giant_round(labelled(giants), sets, percent)


def _giant_round(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Leaders of each bucket that isn't done against the rest of it: the buckets' members thereafter, and the links found."""
    untried = F.when(~F.col("tried"), F.col("component"))
    state = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(untried).alias("low_u"), F.max(untried).alias("high_u"))
    # where all untried members lie in one component, they have met the tried ones of others, which led
    todo = stage(state.where("low <> high and low_u <> high_u").select("key"), "todo")
    members = stage(members.join(todo, "key"), "members")
    weight = stage(members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("weight")), "weight")
    ranked = members.where("not tried").join(weight, ["key", "component"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    order = [F.col("weight"), F.col("component"), F.col("id")]
    near = ranked.withColumn("place", F.row_number().over(Window.partitionBy("key", "salt").orderBy(*order))).where(F.col("place") <= LEADERS)
    leaders = stage(near.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("place") <= LEADERS).select("key", "id"), "leaders")
    marked = stage(members.join(leaders.withColumn("leads", F.lit(True)), ["key", "id"], "left").withColumn("leads", F.coalesce("leads", F.lit(False))), "marked")
    pieces = F.col("pieces")
    home = F.pmod(F.xxhash64("id"), pieces).cast("int")
    full = marked.join(sets, "id")
    own = full.withColumn("chunk", home)
    lead = full.where("leads").withColumn("chunk", F.explode(F.sequence(F.lit(0), pieces - 1))).where(F.col("chunk") != home)
    more = _compared(own.select(*_DEALT).union(lead.select(*_DEALT)), percent)
    return stage(marked.select("key", "id", "pieces", (F.col("tried") | F.col("leads")).alias("tried")), "giants"), more

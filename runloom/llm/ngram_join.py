"""Jaccard join of word n-gram sets by partitioning the universe of hashes into segments.

Two sets with Jaccard similarity of at least t and sizes up to n differ in at most H elements.
If every element is hashed to a segment and a pair is met where a segment is equal (weight 1)
or differs by one element (weight 2), then segments with a total weight of H + 1 miss no pair:
otherwise each unmet segment would hold as many differences as it weighs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workspace import discard, materialise, release
from .columns import by_place
from .components import connected_components
from .shingles import mix, shingle_hashes, slices

WORDS = 4
PERCENT = 85
# Members of a bucket that meet in one unit of work; a larger bucket is cut into blocks.
BLOCK = 512
# Rows of a bucket that a task holds to name it.
HELD = 20_000
# What a compared pair costs against writing a signature.
PAIR_COST = 0.05
# Rounds in which each set is tested against its closest possible partner, before all pairs that are left.
CLOSEST_ROUNDS = 4
# Parts of the buckets that are screened one after the other.
WAVES = 4
# Ids up to this count are sent to all tasks.
BROADCAST_IDS = 300_000


def most_difference(size: int, percent: int = PERCENT) -> int:
    """Largest symmetric difference of two linked sets of at most ``size`` elements each."""
    totals = range(max(2, 2 * size - 25), 2 * size + 1)
    return max(t - 2 * -(-percent * t // (100 + percent)) for t in totals)


@dataclass(frozen=True)
class Band:
    """Scheme for pairs whose larger set has ``low`` to ``high`` elements.

    ``plain`` segments are indexed as they are, ``near`` ones with all one-deletions. A set
    with at most ``spare`` empty plain segments leaves those out.
    """

    low: int
    high: int
    plain: int
    near: int
    spare: int

    @property
    def segments(self) -> int:
        return self.plain + self.near


def allocate(low: int, high: int, sets: int, percent: int = PERCENT) -> Band:
    """The cheapest allocation for a band with so many sets.

    Costs are the signatures of a set plus the pairs that would meet in empty segments,
    which grow with the square of the band; so large bands get longer segments, with
    one-deletion neighbourhoods, or more spare ones.
    """
    need = most_difference(high, percent) + 1
    size = (low + high) / 2
    best = None
    for near in sorted({0, 1, 2, need // 8, need // 4, need // 2, (need + 1) // 2}):
        for spare in range(0, 5):
            plain = max(0, need + spare - 2 * near) if near * 2 < need + spare else 0
            if plain == 0 and spare:
                continue
            n = plain + near
            if n == 0:
                continue
            mean = size / n
            empty = math.exp(-mean)
            expected = plain * empty
            over = 1 - sum(math.exp(-expected) * expected**k / math.factorial(k) for k in range(spare + 1))
            listed = min(empty, over * (spare + 1) / max(1, plain))
            signatures = plain + near * (1 + mean)
            alike = plain * (sets * listed) ** 2 / 2 + near * (sets * empty * (1 + mean)) ** 2 / 2
            cost = sets * signatures + PAIR_COST * alike
            if best is None or cost < best[0]:
                best = (cost, Band(low, high, plain, near, spare))
    return best[1]


def band_edges(largest: int, percent: int = PERCENT) -> list[int]:
    """First sizes of the bands, so that a set meets partners of its own and the next band only."""
    edges = [1]
    while edges[-1] <= largest * 100 // percent:
        edges.append(int(edges[-1] * (100 / percent) ** 2) + 1)
    return edges


def _distinct(part: pa.RecordBatch, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted inside the row, and the row bounds."""
    hashes, bounds = shingle_hashes(part.column(text), words)
    own = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    sizes = np.array([len(x) for x in own], dtype=np.int64)
    return (np.concatenate(own) if own else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _set_ids(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit hash of each set, a mixed sum over its elements."""
    sizes = np.diff(bounds).astype(np.uint64)
    return mix(_sums(mix(values ^ np.uint64(0xA0761D6478BD642F)), bounds) + mix(sizes)).view(np.int64)


def parity_sketch(own: np.ndarray) -> bytes:
    """One bit per element, flipped by each element that hashes to it; as many bits as elements, a power of 2.

    Two sketches differ in at most as many bits as the sets in elements, and a sketch folds
    to half its size by XOR of its halves.
    """
    bits = max(64, 1 << max(0, len(own) - 1).bit_length())
    at = (mix(own + np.uint64(0xE7037ED1A0B428DB)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the shortest."""
    width = min(map(len, sketches))
    out = []
    for s in sketches:
        x = np.frombuffer(s, dtype=np.uint64)
        while x.nbytes > width:
            x = x[: len(x) // 2] ^ x[len(x) // 2:]
        out.append(x)
    return np.stack(out)


def signatures(values: np.ndarray, bounds: np.ndarray, bands: list[Band], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit signature for every indexed segment of every set, in each band that it can meet."""
    sizes = np.diff(bounds)
    lows = np.array([b.low for b in bands])
    highs = np.array([b.high for b in bands])
    rows_out, sigs_out = [], []
    first = np.searchsorted(lows, sizes, side="right") - 1
    last = np.searchsorted(lows, sizes * 100 // percent, side="right") - 1
    for step in (0, 1):
        rows = np.flatnonzero((sizes > 0) & (first + step <= last))
        if not len(rows):
            continue
        band = first[rows] + step
        plain, near = (np.array([getattr(bands[k], f) for k in band]) for f in ("plain", "near"))
        spare = np.array([bands[k].spare for k in band])
        count = plain + near
        begin = np.concatenate([[0], np.cumsum(count)])
        length = sizes[rows]
        job = np.repeat(np.arange(len(rows)), length)
        at = np.repeat(bounds[rows] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        x = values[at]
        segment = ((mix(x + np.uint64(0x8EBC6AF09C88C6E3)) >> np.uint64(33)).astype(np.int64)) % count[job]
        cell = begin[job] + segment
        add = mix(x ^ np.uint64(0x589965CC75374CC3))
        total = np.zeros(begin[-1], dtype=np.uint64)
        np.add.at(total, cell, add)
        owner = np.repeat(np.arange(len(rows)), count)
        number = np.arange(begin[-1]) - begin[owner]
        place = mix((highs[band][owner] * np.int64(1 << 24) + number).astype(np.uint64))
        filled = np.zeros(begin[-1], dtype=bool)
        filled[cell] = True
        is_plain = number < plain[owner]
        empties = np.bincount(owner[is_plain & ~filled], minlength=len(rows))
        listed = filled | ~is_plain | (empties > spare)[owner]
        rows_out.append(rows[owner[listed]])
        sigs_out.append(mix(total[listed] + place[listed]))
        deleted = segment >= plain[job]
        rows_out.append(rows[job[deleted]])
        sigs_out.append(mix(total[cell[deleted]] - add[deleted] + place[cell[deleted]]))
    if not rows_out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows_out), np.concatenate(sigs_out)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Exact test on two sorted arrays of distinct hashes."""
    if not len(a) or not len(b):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) * 100 < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    shared = int((large[at] == small).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def shingle_sets(docs: DataFrame, key: str, text: str, words: int = WORDS) -> DataFrame:
    """(key, n_shingles, set_id, sketch) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                values, bounds = _distinct(part, "_text", words)
                sketch = [parity_sketch(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key"), pa.array(np.diff(bounds)), pa.array(_set_ids(values, bounds)),
                     pa.array(sketch, pa.binary())], names=["_key", "n_shingles", "set_id", "sketch"])

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        work, f"_key {kind}, n_shingles long, set_id long, sketch binary")


def index_segments(docs: DataFrame, text: str, bands: list[Band], words: int, percent: int) -> DataFrame:
    """(sig, set_id): members of the buckets that hold more than one set.

    Signatures are dealt and sorted by value, so a bucket of any size streams through. A
    bucket is named by its members: near copies share most of their segments, and buckets
    with the same members are one.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                values, bounds = _distinct(part, "_text", words)
                ids = _set_ids(values, bounds)
                rows, sigs = signatures(values, bounds, bands, percent)
                yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(ids[rows])], names=["sig", "set_id"])

    def named(sig: np.ndarray, ids: np.ndarray) -> pa.RecordBatch | None:
        """Whole buckets of two or more sets, named by the hash of their members."""
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(sig)))
        if not (sizes > 1).any():
            return None
        name = mix(np.add.reduceat(mix(ids.view(np.uint64)), starts) + mix(sizes.astype(np.uint64))).view(np.int64)
        several = np.repeat(sizes > 1, sizes)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(name, sizes)[several]), pa.array(ids[several])], names=["sig", "set_id"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last bucket is held back until it is whole; one that is too long to hold keeps its signature as name.
        sig, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        long_one = None
        for batch in batches:
            sig = np.concatenate([sig, batch.column("sig").to_numpy()])
            ids = np.concatenate([ids, batch.column("set_id").to_numpy()])
            fresh = np.ones(len(sig), dtype=bool)
            fresh[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
            sig, ids = sig[fresh], ids[fresh]
            if long_one is not None:
                more = np.searchsorted(sig != long_one, True)
                if more:
                    yield pa.RecordBatch.from_arrays([pa.array(sig[:more]), pa.array(ids[:more])], names=["sig", "set_id"])
                    sig, ids = sig[more:], ids[more:]
            if not len(sig):
                continue
            last = len(sig) - np.searchsorted(sig[::-1] != sig[-1], True)
            whole = named(sig[:last], ids[:last])
            if whole is not None:
                yield whole
            sig, ids, long_one = sig[last:], ids[last:], None
            if len(sig) > held:
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(ids)], names=["sig", "set_id"])
                sig, ids, long_one = sig[:0], ids[:0], sig[0]
        whole = named(sig, ids)
        if whole is not None:
            yield whole

    held = HELD
    emitted = docs.select(F.col(text).alias("_text")).mapInArrow(emit, "sig long, set_id long")
    met = emitted.repartition("sig").sortWithinPartitions("sig", "set_id").mapInArrow(meet, "sig long, set_id long")
    return met.distinct()


class _Forest:
    """Union-find over the labels of one unit of work."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while self.parent.get(root, root) != root:
            root = self.parent[root]
        while self.parent.get(x, x) != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, a: int, b: int) -> None:
        self.parent[self.find(a)] = self.find(b)


def _units(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Rows of each unit, from rows sorted by unit."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and any(row[k] != rows[0][k] for k in keys):
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _sets_of(docs: DataFrame, facts: DataFrame, wanted: DataFrame, key: str, text: str, words: int, broadcast_ids: int) -> DataFrame:
    """(set_id, elements): one row for each wanted set, its hashes made anew from one document that has it."""
    holders = facts.join(wanted.select("set_id").distinct(), "set_id").groupBy("set_id").agg(F.min("_key").alias("_key"))
    holders = materialise(holders, "holders")
    listed = F.broadcast(holders) if holders.count() <= broadcast_ids else holders
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(listed, "_key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                values, bounds = _distinct(part, "_text", words)
                ids = _set_ids(values, bounds)
                # Of rows with equal keys, only that with the wanted set counts.
                right = np.flatnonzero(ids == part.column("set_id").to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[right]), pa.array([values[bounds[i]: bounds[i + 1]].tobytes() for i in right], pa.binary())],
                    names=["set_id", "elements"])

    return rows.select("set_id", "_text").mapInArrow(work, "set_id long, elements binary")


def _pivot_links(buckets: DataFrame, metas: DataFrame, sets_of, percent: int) -> DataFrame:
    """Links found by comparing each set with one pivot: the bucket leader it shares most buckets with.

    A bucket's leader is its member with most buckets, in a group of near copies the one
    closest to their common origin.
    """
    fame = buckets.groupBy("set_id").agg(F.count(F.lit(1)).alias("fame"))
    famed = buckets.join(fame, "set_id")
    leaders = famed.groupBy("sig").agg(F.max(F.struct("fame", "set_id"))["set_id"].alias("pivot"))
    shared = buckets.join(leaders, "sig").filter("set_id <> pivot").groupBy("set_id", "pivot").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy("set_id").agg(F.max(F.struct("n", "pivot"))["pivot"].alias("pivot"))
    other = metas.select(F.col("set_id").alias("pivot"), F.col("n_shingles").alias("n2"), F.col("sketch").alias("sketch2"))
    pairs = best.join(metas, "set_id").join(other, "pivot")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_compatible(r["n_shingles"], r["n2"], _folded([r["sketch"], r["sketch2"]]), percent) for r in batch.to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["set_id", "pivot"])

    return _verified(materialise(pairs.mapInArrow(alike, "set_id long, pivot long"), "pivots"), sets_of, percent)


def _verified(near: DataFrame, sets_of, percent: int) -> DataFrame:
    """Those of the stored (set_id, pivot) pairs that are links; a popular pivot's partners are cut into parts."""
    parts = near.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    members = near.join(parts, "pivot").select("set_id", "pivot", F.pmod(F.xxhash64("set_id"), F.col("parts")).alias("part"))
    copies = parts.select(F.col("pivot").alias("set_id"), "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    tagged = members.unionByName(copies)
    rows = tagged.join(sets_of(tagged), "set_id").withColumn("member", F.col("set_id") != F.col("pivot"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pivot = None, np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                own = np.frombuffer(r["elements"], dtype=np.uint64)
                if (r["pivot"], r["part"]) != group:
                    group, pivot = (r["pivot"], r["part"]), np.zeros(0, np.uint64)
                if not r["member"]:
                    pivot = own
                elif linked(own, pivot, percent):
                    found.append((r["set_id"], r["pivot"]))
            if found:
                yield pa.RecordBatch.from_pydict({"a": [x for x, _ in found], "b": [y for _, y in found]})

    dealt = rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "member")
    return dealt.select("pivot", "part", "member", "set_id", "elements").mapInArrow(verify, "a long, b long")


def _compatible(n1: int, n2: int, folded: np.ndarray, percent: int) -> bool:
    """Whether sizes and sketches leave it possible that two sets are linked."""
    if min(n1, n2) * 100 < percent * max(n1, n2):
        return False
    allowed = n1 + n2 - 2 * -(-percent * (n1 + n2) // (100 + percent))
    return int(np.bitwise_count(folded[0] ^ folded[1]).sum()) <= allowed


def _block_units(buckets: DataFrame) -> DataFrame:
    """Bucket members with the pair of blocks in which they meet others; a block has about BLOCK members.

    Members of one label need not meet. So in a bucket of more than one block those with its most frequent label
    have blocks of their own, after the others', and go only where others are.
    """
    counts = buckets.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("sig").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"))
    whole = F.col("n") <= BLOCK
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1).cast("long"))
    counts = counts.select(
        "sig", F.when(~whole, F.col("top.label")).alias("top_label"), blocks(F.col("top.n")).alias("tops"),
        blocks(F.when(whole, F.lit(1)).otherwise(F.col("n") - F.col("top.n"))).alias("rest"))
    placed = buckets.join(counts, "sig").withColumn("_top", F.col("label").eqNullSafe(F.col("top_label")))
    hashed = F.xxhash64("set_id")
    block = F.when(F.col("_top"), F.col("rest") + F.pmod(hashed, F.col("tops"))).otherwise(F.pmod(hashed, F.col("rest")))
    last = F.col("rest") - 1 + F.when(F.col("_top") | F.col("top_label").isNull(), 0).otherwise(F.col("tops"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other")
    return placed.withColumn("block", block).select("sig", "set_id", "label", "block", others).withColumns({
        "low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")


def _near_members(members: list[dict], percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each member of a unit the later ones with another label that sizes and sketches leave possible, and how
    many bits differ."""
    n = np.array([m["n_shingles"] for m in members])
    label = np.array([m["label"] for m in members])
    block = np.array([m["block"] for m in members])
    sketch = _folded([m["sketch"] for m in members])
    across = members[0]["low"] != members[0]["high"]
    for i in range(len(members)):
        total = n[i] + n[i + 1:]
        fits = (label[i + 1:] != label[i]) & (np.minimum(n[i], n[i + 1:]) * 100 >= percent * np.maximum(n[i], n[i + 1:]))
        if across:
            fits &= block[i + 1:] != block[i]
        at = np.flatnonzero(fits)
        if len(at):
            differ = np.bitwise_count(sketch[i + 1 + at] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            near = differ <= total[at] + 2 * (-percent * total[at] // (100 + percent))
            if near.any():
                yield i, i + 1 + at[near], differ[near]


UNIT = ["sig", "low", "high"]
FIELDS = [*UNIT, "block", "set_id", "label"]


def _screened(rows: DataFrame, metas: DataFrame, percent: int) -> DataFrame:
    """Members of units that have a possible partner with another label in their unit, with the closest of these and
    how many bits differ."""
    names = [*FIELDS, "least", "partner"]
    schema = pa.schema([(f, pa.int64()) for f in names])

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members in _units(batches, UNIT):
            least = np.full(len(members), np.iinfo(np.int64).max)
            partner = np.full(len(members), -1)
            for i, near, differ in _near_members(members, percent):
                closer = differ < least[near]
                least[near[closer]], partner[near[closer]] = differ[closer], i
                k = int(differ.argmin())
                if differ[k] < least[i]:
                    least[i], partner[i] = differ[k], near[k]
            kept = [
                {k: members[i][k] for k in FIELDS} | {"least": int(least[i]), "partner": members[partner[i]]["set_id"]}
                for i in np.flatnonzero(partner >= 0)]
            if kept:
                yield pa.RecordBatch.from_pylist(kept, schema=schema)

    return _with_sketches(rows, metas).mapInArrow(screen, ", ".join(f"{f} long" for f in names))


def _with_sketches(rows: DataFrame, metas: DataFrame) -> DataFrame:
    met = rows.join(metas, "set_id").select(*FIELDS, "n_shingles", "sketch")
    return met.repartition(*UNIT).sortWithinPartitions(*UNIT)


def _closest(screened: DataFrame) -> DataFrame:
    """(set_id, pivot): for each set its closest possible partner with another label over all units, each pair once."""
    best = screened.groupBy("set_id").agg(F.min(F.struct("least", "partner"))["partner"].alias("other"))
    return best.select(F.least("set_id", "other").alias("set_id"), F.greatest("set_id", "other").alias("pivot")).distinct()


def _relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    own = rows.drop("label").join(labels, F.col("set_id") == F.col("node"), "left")
    return own.withColumn("label", F.coalesce("label", "set_id")).drop("node")


def _block_links(screened: DataFrame, sets_of, percent: int) -> DataFrame:
    """Links between different labels inside the screened units, tested exactly."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members in _units(batches, UNIT):
            forest = _Forest()
            own = [np.frombuffer(m["elements"], dtype=np.uint64) for m in members]
            across = members[0]["low"] != members[0]["high"]
            sketch = _folded([parity_sketch(x) for x in own])
            n = np.array([len(x) for x in own])
            found = []
            for i in range(len(members)):
                total = n[i] + n[i + 1:]
                differ = np.bitwise_count(sketch[i + 1:] ^ sketch[i]).sum(axis=1, dtype=np.int64)
                fits = np.flatnonzero(differ <= total + 2 * (-percent * total // (100 + percent))) + i + 1
                for j in fits[np.argsort(differ[fits - i - 1], kind="stable")]:
                    a, b = members[i], members[j]
                    if across and a["block"] == b["block"] or forest.find(a["label"]) == forest.find(b["label"]):
                        continue
                    if linked(own[i], own[j], percent):
                        forest.join(a["label"], b["label"])
                        found.append((a["set_id"], b["set_id"]))
            if found:
                yield pa.RecordBatch.from_pydict({"a": [x for x, _ in found], "b": [y for _, y in found]})

    whole = screened.join(sets_of(screened), "set_id").repartition(*UNIT).sortWithinPartitions(*UNIT)
    return whole.select(*FIELDS, "elements").mapInArrow(verify, "a long, b long")


def _remaining_links(buckets: DataFrame, metas: DataFrame, found: DataFrame, sets_of, percent: int) -> DataFrame:
    """(node, label) over all links: those ``found`` and those between sets that share a bucket.

    Sets that share a bucket but no label yet meet in pairs of blocks and are screened by
    sketches, some of the buckets after the others, so that not all their sketches are shuffled
    at once. Then each set that is left is tested against its closest possible partner with
    another label, which joins most groups for little; what is still
    apart is screened again and all its pairs are tested. A table goes when the next is written.
    """
    spark = buckets.sparkSession
    labels = connected_components(found)
    labelled = _relabelled(buckets.withColumn("label", F.col("set_id")), labels)
    open_ = labelled.groupBy("sig").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).filter("l1 <> l2").select("sig")
    unresolved = materialise(labelled.join(open_, "sig"), "unresolved")
    discard(buckets)
    release(spark)
    tables = []
    for wave in range(WAVES):
        part = unresolved.filter(F.pmod(F.xxhash64("sig"), F.lit(WAVES)) == wave)
        tables.append(materialise(_screened(_block_units(part), metas, percent), "screened"))
        release(spark)
    discard(unresolved)
    screened = reduce(DataFrame.union, tables)
    for _ in range(CLOSEST_ROUNDS):
        if screened.isEmpty():
            return labels
        closest = materialise(_closest(screened), "closest")
        links = materialise(_verified(closest, sets_of, percent), "links")
        discard(closest)
        if links.isEmpty():
            break
        found = found.union(links)
        labels = connected_components(found)
        before, screened = tables, materialise(_screened(_relabelled(screened, labels), metas, percent), "screened")
        discard(*before)
        tables = [screened]
        release(spark)
    rest = materialise(_block_links(screened, sets_of, percent), "block-links")
    return labels if rest.isEmpty() else connected_components(found.union(rest))


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
    broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """(key, n_shingles, component_id) of every row of ``docs``.

    Rows with equal sets are one class from the start. Sets that share an indexed segment
    are candidates: each is first tested against one pivot, then all pairs of a bucket that
    are still in different components are screened by sketches and tested exactly, in
    blocks. So the components are those of all links, whatever the size of a bucket, and
    no list of pairs is made. A component's id is its smallest key. Null and empty texts
    have an empty set and are linked with nothing; a null key never names a component.
    Rows with equal keys are one document with several texts. Sets are told apart by a
    64-bit hash of their shingles' hashes.
    """
    facts = materialise(shingle_sets(docs, key, text, words), "sets")
    filled = facts.filter("n_shingles > 0 AND _key IS NOT NULL")
    largest = filled.agg(F.max("n_shingles")).first()[0] or 0
    edges = band_edges(largest, percent)
    band = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("n_shingles"))) - 1
    # One row per band, a few dozen at any size of the table.
    counts = {r["band"]: r["count"] for r in filled.groupBy(band.alias("band")).count().collect()}
    bands = [
        allocate(low, high - 1, counts.get(i, 0) + counts.get(i - 1, 0) + 1, percent)
        for i, (low, high) in enumerate(zip(edges, edges[1:]))]
    buckets = materialise(index_segments(docs.filter(F.col(key).isNotNull()), text, bands, words, percent), "buckets")
    metas = materialise(
        filled.join(buckets.select("set_id").distinct(), "set_id", "left_semi").groupBy("set_id").agg(
            F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "metas")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return _sets_of(docs, filled, wanted, key, text, words, broadcast_ids)

    # Rows with equal keys are one document: its sets are linked, too.
    several = filled.groupBy("_key").agg(F.min("set_id").alias("a"), F.max("set_id").alias("_b")).filter("a <> _b")
    same = filled.join(several, "_key").filter("set_id <> a").select("a", F.col("set_id").alias("b"))
    release(docs.sparkSession)
    found = materialise(_pivot_links(buckets, metas, sets_of, percent).union(same), "pivot-links")
    release(docs.sparkSession)
    labels = _remaining_links(buckets, metas, found, sets_of, percent)
    discard(metas)
    named = filled.select("_key", "set_id").join(labels, F.col("set_id") == F.col("node"), "left").select(
        "_key", "set_id", F.coalesce("label", "set_id").alias("label"))
    ids = named.groupBy("label").agg(F.min("_key").alias("component_id"))
    members = named.select("set_id", "label").distinct().join(ids, "label").select("set_id", "component_id")
    return facts.join(members, "set_id", "left").select(
        F.col("_key").alias(key), "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "_key")).otherwise(F.col("_key")).alias("component_id"))


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
    broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """``docs`` with one row for each component of linked documents: that of the smallest key.

    Of rows with equal keys the one whose text is first in order stays. Rows with a null
    key, which cannot be told apart, all stay. Columns are unchanged, whatever the names and
    types of the others are.
    """
    plain = by_place(docs)
    id_, body = (f"c{docs.columns.index(c)}" for c in (key, text))
    placed = materialise(jaccard_components(plain.select(id_, body), id_, body, words, percent, broadcast_ids), "components")
    gone = placed.filter(F.col("component_id") != F.col(id_)).select(F.col(id_).alias("_gone")).distinct()
    again = placed.filter(F.col(id_).isNotNull()).groupBy(F.col(id_).alias("_again")).count().filter("count > 1").select("_again")
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_ids else df
    gone, again = small(materialise(gone, "gone")), small(materialise(again, "again"))
    left = plain.join(gone, F.col(id_) == F.col("_gone"), "left_anti")
    once = left.join(again, F.col(id_) == F.col("_again"), "left_anti")
    # Maps have no order of their own.
    others = [F.to_json(f.name) if "map<" in f.dataType.simpleString() else F.col(f.name)
              for f in plain.schema.fields if f.name not in (id_, body)]
    first = Window.partitionBy(id_).orderBy(F.col(body).asc_nulls_last(), *others)
    several = left.join(again, F.col(id_) == F.col("_again"), "left_semi").withColumn(
        "_place", F.row_number().over(first)).filter("_place = 1").drop("_place")
    return once.unionByName(several).toDF(*docs.columns)

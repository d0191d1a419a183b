"""Exact set-similarity join on word shingles by universe partitioning.

Two sets whose Jaccard similarity reaches ``percent`` differ in at most H shingles, and H follows from
their sizes. Sizes are cut into bands, so that partners stand in the same or in neighbouring bands.
A band has m segments; a hash of the shingle picks its segment, and a set's key in a segment is the
hash of all its shingles there. Partners differ in at most H segments, so they share at least m - H
keys: the pigeonhole. Every set states the keys of its own band and, as a possible larger partner,
those of the band below.

Keys that only one set has cannot match and are left out by partition sketches. Of the others every
set takes those that cost least: with errors e allowed in a segment (-1: not looked at, 0: equal keys,
1: one shingle more or less), sum(e + 1) >= H + 1 still finds every partner. A band has more segments
than H + 1, so that each set can leave out its most crowded keys; where over ``crowded`` candidates
remain in more segments than that, it leaves them out too and pays by one-deletion neighbourhoods in
its smallest segments: keys of the segment without one of its shingles. If equal keys alone do not
find a pair then both sets have so many crowded keys, so only such sets state deletions.

Only components matter: sets with equal shingles are one class, whose members count as one; each class
is first compared with a few leaders of its buckets' largest components, other ones in each round, and
with those that agree best linked to them; then pairs of different components that meet in a bucket are
formed inside tasks, in pairs of blocks of bounded size. A pair must have fitting sizes, and of a finer
partition (cells of about two shingles, four bits of each) at most H cells may differ, as every shingle
that only one set has changes one cell; what is left is verified on full sets.

Defined results: null and empty texts have no shingles and are linked with nothing; fewer words than a
shingle form one shingle; a row without doc_id has component null; rows that share a doc_id are each
judged by their own text (where several represent a class, they are one node); extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrays import Texts, mix, slices
from tidemark.llm.exchange import Batches, repeated_keys
from tidemark.llm.graph import components
from tidemark.llm.near_dedup import shingles, whole_groups
from tidemark.runtime import cut_lineage, discard

WORDS, PERCENT, CROWDED, BLOCK, ROUNDS, LEADERS = 3, 90, 64, 512, 2, 4
FULL, LOOKS, NEAR, WITHOUT, LOOKS_WITHOUT, LOWER = 1, 2, 4, 8, 16, 32
_FEW = 1 << 16  # pairs whose keys are compared at once


class Bands:
    """Size bands of a threshold: first sizes, segments, and segments beyond the pigeonhole."""

    def __init__(self, percent: int, largest: int) -> None:
        first = [1]
        while first[-1] <= largest:
            first.append(max(first[-1] + 1, -(-first[-1] * 100 // percent)))
        self.first = np.array(first)
        most = (100 - percent) * (self.first[1:] - 1) // percent  # H of each band
        self.spare = np.append((most + 1) // 3, 0)
        self.segments = np.append(most + 1, 1) + self.spare
        self.cells = 2 * (np.append(self.first[1:], self.first[-1]) // 4 + 1)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, sizes, side="right") - 1


def _segments(sets: np.ndarray, count: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sets laid end to end: the segment of every shingle, numbered over all sets, and the first
    segment of each set."""
    first = np.cumsum(segments) - segments
    place = (mix(sets ^ np.uint64(0x7F4A7C159E3779B9)) % np.repeat(segments, count).astype(np.uint64)).astype(np.int64)
    return place + np.repeat(first, count), first


def _keys(content: np.ndarray, band: np.ndarray, segment: np.ndarray) -> np.ndarray:
    return mix(content + mix((band.astype(np.uint64) << np.uint64(32)) + segment.astype(np.uint64) + np.uint64(1)))


class Partition:
    """Keys of some sets in the band ``below`` (0 or 1) their own one."""

    def __init__(self, sets: np.ndarray, count: np.ndarray, below: int, percent: int) -> None:
        bands = Bands(percent, int(count.max(initial=1)))
        band = bands.of(count) - below
        self.whose = np.flatnonzero((count > 0) & (band >= 0))
        use = np.zeros(len(count), bool)
        use[self.whose] = True
        self.sets, self.count, self.band = sets[np.repeat(use, count)], count[use], band[use]
        self.segments, self.spare, self.cells = bands.segments[self.band], bands.spare[self.band], bands.cells[self.band]
        self.at, self.first = _segments(self.sets, self.count, self.segments)
        total = int(self.segments.sum())
        self.letters = mix(self.sets + np.uint64(0x1B873593))
        self.content = np.zeros(total, np.uint64)
        np.add.at(self.content, self.at, self.letters)
        self.size = np.bincount(self.at, minlength=total)
        self.owner = np.repeat(np.arange(len(self.whose)), self.segments)
        self.segment = np.arange(total) - np.repeat(self.first, self.segments)
        self.keys = _keys(self.content, self.band[self.owner], self.segment)

    def briefs(self) -> list[bytes]:
        """Four bits of the content of every cell of each set; unequal cells agree once in 16."""
        at, first = _segments(self.sets ^ np.uint64(0x632BE59BD9B4E019), self.count, self.cells)
        content = np.zeros(int(self.cells.sum()), np.uint64)
        np.add.at(content, at, self.letters)
        four = (mix(content) >> np.uint64(60)).astype(np.uint8)
        body = (four[::2] << 4 | four[1::2]).tobytes()
        return [body[a : a + m] for a, m in zip((first // 2).tolist(), (self.cells // 2).tolist())]

    def without_one(self, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the segment and key of every segment of these sets less one shingle."""
        some = np.flatnonzero(np.isin(self.owner[self.at], owners))
        at = self.at[some]
        return at, _keys(self.content[at] - self.letters[some], self.band[self.owner[at]], self.segment[at])


def allocate(cost: np.ndarray, size: np.ndarray, spare: int, crowded: int) -> np.ndarray:
    """Errors allowed in each segment of one set, by the candidates each key brings (its cost).

    The ``spare`` dearest segments are not looked at; beyond those, a crowded segment is left out for
    one smallest uncrowded segment in which one error is allowed, as long as there are such.
    """
    errors = np.zeros(len(cost), np.int8)
    dear = np.argsort(-cost, kind="stable")
    errors[dear[:spare]] = -1
    rest = dear[spare:]
    hot = rest[cost[rest] > crowded]
    cheap = rest[cost[rest] <= crowded]
    cheap = cheap[np.argsort(size[cheap], kind="stable")]
    swaps = min(len(hot), len(cheap))
    errors[hot[:swaps]] = -1
    errors[cheap[:swaps]] = 1
    return errors


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column."""
    return np.asarray(column.flatten()).view(np.uint64), np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)


def _prints(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits of every set."""
    both, full = np.zeros((2, len(bounds) - 1), np.uint64), np.diff(bounds) > 0
    if full.any():
        both[0, full] = np.add.reduceat(sets, bounds[:-1][full])
        both[1, full] = np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), bounds[:-1][full])
    return both


def jaccard_components(
    docs: DataFrame,
    percent: int = PERCENT,
    words: int = WORDS,
    crowded: int = CROWDED,
    block: int = BLOCK,
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sign(batches: Batches) -> Batches:
        for batch in batches:
            for texts in slices(batch.column("text")):
                sets, bounds = shingles(texts, words)
                both = _prints(sets, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(texts.first, len(texts)), pa.array(np.diff(bounds).astype(np.int64))]
                    + [pa.array(b.view(np.int64)) for b in both],
                    names=["doc_id", "n", "f1", "f2"],
                )

    def stated(texts: Texts, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sets, bounds = shingles(texts, words)
        parts = [Partition(sets, np.diff(bounds), below, percent) for below in (0, 1)]
        return np.concatenate([p.keys for p in parts]), np.concatenate([ids[p.whose[p.owner]] for p in parts])

    def full_sets(batches: Batches) -> Batches:
        for batch in batches:
            for texts in slices(batch.column("text")):
                sets, bounds = shingles(texts, words)
                mine = slice(texts.first, texts.first + len(texts))
                own = _prints(sets, bounds).view(np.int64)
                named = [np.asarray(batch.column(c)[mine]) for c in ("f1", "f2")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[mine], pa.array(np.diff(bounds).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sets.view(np.int64))),
                     batch.column("keys")[mine]],
                    names=["id", "n", "shingles", "keys"],
                ).filter(pa.array((own[0] == named[0]) & (own[1] == named[1])))

    def entries_of(batches: Batches) -> Batches:
        """Every key of a set that others have too."""
        for batch in batches:
            sets, count = _flat(batch.column("shingles"))
            known = np.unique(_flat(batch.column("keys"))[0])
            ids = np.asarray(batch.column("id"))
            for below in (0, 1):
                p = Partition(sets, count, below, percent)
                hit = np.flatnonzero(np.isin(p.keys, known))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p.keys[hit].view(np.int64)), pa.array(ids[p.whose[p.owner[hit]]]), pa.array(np.full(len(hit), below, np.int32))],
                    names=["key", "id", "below"],
                )

    def looked_up(batches: Batches) -> Batches:
        """The allocation of each set in each of its bands: keys and what they may meet."""
        for batch in batches:
            sets, count = _flat(batch.column("shingles"))
            ids = np.asarray(batch.column("id"))
            told, told_n = _flat(batch.column("keys"))
            cost = np.asarray(batch.column("costs").flatten())
            order = np.lexsort((told, np.repeat(np.arange(len(ids)), told_n)))
            told, cost, bounds = told[order], cost[order], np.concatenate(([0], np.cumsum(told_n)))
            for below in (0, 1):
                p = Partition(sets, count, below, percent)
                found = []
                for i, whose in enumerate(p.whose):
                    mine = slice(p.first[i], p.first[i] + p.segments[i])
                    keys, known = p.keys[mine], told[bounds[whose] : bounds[whose + 1]]
                    price = np.full(len(keys), -1)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                        same = known[at] == keys
                        price[same] = cost[bounds[whose] + at[same]]
                    # a key without a cost is known to no other set
                    errors = allocate(price, p.size[mine], int(p.spare[i]), crowded)
                    kind = np.where(errors < 0, FULL, FULL | LOOKS) | np.where(errors > 0, NEAR, 0)
                    deletes = (price > crowded).sum() > p.spare[i]
                    send = np.flatnonzero((price > 0) | deletes)
                    found.append((keys[send], np.full(len(send), i), kind[send]))
                    if deletes:
                        at, less = p.without_one(np.array([i]))
                        found.append((less, np.full(len(less), i), np.where(errors[at - p.first[i]] > 0, WITHOUT | LOOKS_WITHOUT, WITHOUT)))
                if not found:
                    continue
                keys, of, kind = (np.concatenate(c) for c in zip(*found))
                if below:
                    kind = kind | LOWER
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(ids[p.whose[of]]), pa.array(kind.astype(np.int32))],
                    names=["key", "id", "kind"],
                )

    def signs_of(batches: Batches) -> Batches:
        """The cells of every set in both of its bands."""
        for batch in batches:
            sets, count = _flat(batch.column("shingles"))
            ids = np.asarray(batch.column("id"))
            for below in (0, 1):
                p = Partition(sets, count, below, percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[p.whose]), pa.array(np.full(len(p.whose), LOWER * below, np.int32)), pa.array(p.count),
                     pa.array(p.briefs(), pa.binary())],
                    names=["id", "lower", "n", "sign"],
                )

    def agreeing(batches: Batches) -> Batches:
        """Pairs with a leader that may reach the threshold, and the share of cells that differ."""
        for batch in batches:
            one, two = _packed(batch.column("sa")), _packed(batch.column("sb"))
            na, nb = np.asarray(batch.column("na")), np.asarray(batch.column("nb"))
            keep, apart = _close(np.arange(batch.num_rows), np.arange(batch.num_rows), one, two, na, nb, percent)
            some = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(some), batch.column("b").take(some), pa.array(-apart[keep] / one[2][keep])],
                names=["a", "b", "share"],
            )

    def compare(batches: Batches) -> Batches:
        for table in whole_groups(batches, ["key", "one", "two"]):
            yield _meet(table, percent)

    signed = cut_lineage(docs.mapInArrow(sign, "doc_id bigint, n bigint, f1 bigint, f2 bigint"))
    classes = cut_lineage(
        signed.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id"))
    )
    # texts of representatives, with the print of their class: a row may have its id with another text
    texts = cut_lineage(docs.join(classes.select(F.col("id").alias("doc_id"), "f1", "f2"), "doc_id"))
    shared = repeated_keys(texts, stated)
    wide = cut_lineage(
        texts.join(shared, "doc_id").mapInArrow(full_sets, "id bigint, n bigint, shingles array<bigint>, keys array<bigint>")
    )
    discard(texts)
    sets = wide.select("id", "n", "shingles")
    entries = cut_lineage(wide.mapInArrow(entries_of, "key bigint, id bigint, below int"))

    def verified(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s"))
        two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("t"))
        both = F.size(F.array_intersect("s", "t"))
        return (
            pairs.join(one, "a").join(two, "b")
            .where(100 * both >= percent * (F.size("s") + F.size("t") - both))
            .select("a", "b")
        )

    signs = cut_lineage(sets.mapInArrow(signs_of, "id bigint, lower int, n bigint, sign binary"))
    side = lambda x: signs.select(
        F.col("id").alias(x), F.col("lower").alias(f"l{x}"), F.col("n").alias(f"n{x}"), F.col("sign").alias(f"s{x}")
    )
    found: DataFrame | None = None
    for turn in range(ROUNDS):
        placed = _placed(entries, found).withColumn("lower", F.col("below") * LOWER)
        leaders = _buckets(placed, turn)
        led = (
            placed.join(leaders, "key")
            .where(F.col("comp") != F.col("main"))
            .select("id", "lower", F.explode("leaders").alias("leader"))
            .select(F.col("id").alias("a"), F.col("lower").alias("la"), F.col("leader.id").alias("b"), F.col("leader.lower").alias("lb"))
            .where("la = 0 or lb = 0")
            .distinct()
            .join(side("a"), ["a", "la"])
            .join(side("b"), ["b", "lb"])
            .mapInArrow(agreeing, "a bigint, b bigint, share double")
            .groupBy("a")
            .agg(F.max(F.struct("share", "b"))["b"].alias("b"))
        )
        found = _joined(found, cut_lineage(verified(led)))
    placed = _placed(entries, found)
    own = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    costs = (
        placed.join(_buckets(placed.withColumn("lower", F.lit(0)), 0), "key")
        .join(own, ["key", "comp"])
        .groupBy("id")
        .agg(F.collect_list(F.struct("key", (F.col("n") - F.col("c")).alias("cost"))).alias("told"))
    )
    allocated = cut_lineage(
        sets.join(costs, "id")
        .select("id", "n", "shingles", F.col("told.key").alias("keys"), F.col("told.cost").alias("costs"))
        .mapInArrow(looked_up, "key bigint, id bigint, kind int")
    )
    signs = sets.mapInArrow(signs_of, "id bigint, lower int, n bigint, sign binary")
    discard(entries)
    met = _blocks(_placed(allocated, found), signs, block).mapInArrow(compare, "a bigint, b bigint")
    found = _joined(found, cut_lineage(verified(met.distinct())))
    discard(wide, allocated, signs)

    rooted = classes.join(found, "id", "left").select("f1", "f2", "n", F.coalesce("component", "id").alias("component"))
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return signed.join(rooted, ["f1", "f2", "n"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
    )


def _placed(entries: DataFrame, found: DataFrame | None) -> DataFrame:
    """Entries with their component so far."""
    if found is None:
        return entries.withColumn("comp", F.col("id"))
    return entries.join(found, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")


def _buckets(placed: DataFrame, turn: int) -> DataFrame:
    """Keys that different components share: entries, the largest component and some of its members,
    in every turn other ones."""
    member = F.struct("id", "lower")
    some = [F.max_by(member, F.xxhash64("id", F.lit(LEADERS * turn + k))).alias(f"m{k}") for k in range(LEADERS)]
    per = placed.groupBy("key", "comp").agg(F.count("*").alias("c"), *some)
    leaders = F.array(*(F.col(f"m{k}") for k in range(LEADERS))).alias("leaders")
    return (
        per.select("key", "comp", "c", leaders)
        .groupBy("key")
        .agg(F.count("*").alias("k"), F.sum("c").alias("n"), F.max(F.struct("c", "comp", "leaders")).alias("top"))
        .where("k > 1")
        .select("key", "n", F.col("top.comp").alias("main"), F.array_distinct("top.leaders").alias("leaders"))
    )


def _joined(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (id, component) after more links between ids."""
    if found is None:
        return cut_lineage(components(links))
    label = lambda side: F.coalesce(F.col(f"{side}c"), F.col(side))
    lifted = (
        links.join(found.select(F.col("id").alias("a"), F.col("component").alias("ac")), "a", "left")
        .join(found.select(F.col("id").alias("b"), F.col("component").alias("bc")), "b", "left")
        .select(label("a").alias("a"), label("b").alias("b"))
    )
    stars = cut_lineage(components(lifted))
    above = stars.select(F.col("id").alias("component"), F.col("component").alias("root"))
    known = found.join(above, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    fresh = above.select(F.col("component").alias("id"), F.col("root").alias("component"))
    both = cut_lineage(known.union(fresh.join(found.select("id"), "id", "left_anti")))
    discard(links, stars, found)
    return both


def _meets(kind: Column, others: Column) -> Column:
    """Whether an entry of this kind may pair with one of others' kinds (see ``_meet``)."""
    has = lambda c, bits: c.bitwiseAND(bits) > 0
    looks = LOOKS | LOOKS_WITHOUT
    equal = (has(kind, FULL) & has(others, looks)) | (has(kind, looks) & has(others, FULL))
    return equal | (has(kind, WITHOUT) & has(others, NEAR)) | (has(kind, NEAR) & has(others, WITHOUT))


def _blocks(placed: DataFrame, signs: DataFrame, block: int) -> DataFrame:
    """Entries of mixed buckets in pairs of blocks: visitors are the entries outside the bucket's largest
    component or those that look for others, whichever are fewer, since every pair has one of each. Every
    block of visitors meets every block. A pair of blocks is bounded. Entries that can pair with no other
    component of their bucket are left out."""
    looking = F.col("kind").bitwiseAND(LOOKS | NEAR | LOOKS_WITHOUT) > 0
    bits = (FULL, LOOKS, NEAR, WITHOUT, LOOKS_WITHOUT)
    held = lambda kinds, bit: F.col(kinds).bitwiseAND(bit) > 0
    beside = lambda bit: F.col(f"with{bit}") > held("top.kinds", bit).cast("int")
    per = placed.groupBy("key", "comp").agg(
        F.count("*").alias("c"), F.count_if(looking).alias("looking"), F.bit_or("kind").alias("kinds")
    )
    buckets = (
        per.groupBy("key")
        .agg(
            F.count("*").alias("k"), F.sum("c").alias("n"), F.sum("looking").alias("looking"),
            F.max(F.struct("c", "comp", "kinds")).alias("top"), F.bit_or("kinds").alias("every"),
            *[F.count_if(held("kinds", bit)).alias(f"with{bit}") for bit in bits],
        )
        .where((F.col("k") > 1) & (F.col("looking") > 0))
        .withColumn("outside", F.col("n") - F.col("top.c"))
        .select(
            "key", F.col("top.comp").alias("main"), "every",
            reduce(Column.bitwiseOR, [F.when(beside(bit), bit).otherwise(0) for bit in bits]).alias("others"),
            (F.col("outside") <= F.col("looking")).alias("out"),
            F.ceil(F.col("n") / block).cast("int").alias("blocks"),
            F.greatest(F.ceil(F.least("outside", "looking") / block), F.lit(1)).cast("int").alias("guests"),
        )
    )
    outside = F.col("comp") != F.col("main")
    spread = lambda n: F.pmod(F.xxhash64("id", "key"), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    rows = (
        placed.join(buckets, "key")
        .where(_meets(F.col("kind"), F.when(outside, F.col("every")).otherwise(F.col("others"))))
        .withColumn("lower", F.col("kind").bitwiseAND(LOWER))
        .join(signs, ["id", "lower"])
        .withColumn("guest", F.when(F.col("out"), outside).otherwise(looking))
        .withColumn("home", spread(F.col("blocks")))
        .withColumn("seat", F.when(F.col("guest"), spread(F.col("guests"))))
    )
    # as a guest: its seat with every home block; as a host: its home block with every seat
    visits = rows.where("guest").withColumn("two", F.explode(every(F.col("blocks")))).withColumn("one", F.col("seat"))
    hosts = rows.withColumn("one", F.explode(every(F.col("guests")))).withColumn("two", F.col("home"))
    columns: list[Column | str] = ["key", "one", "two", "id", "comp", "kind", "n", "sign"]
    return (
        visits.select(*columns, F.lit(True).alias("visits"))
        .union(hosts.select(*columns, F.lit(False).alias("visits")))
        .repartition("key", "one", "two")
        .sortWithinPartitions("key", "one", "two")
    )


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a binary column end to end, and start and length of each value."""
    values = column.to_pylist()
    length = np.fromiter(map(len, values), np.int64, len(values))
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(length) - length, length


def _close(
    x: np.ndarray, y: np.ndarray, one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...], nx: np.ndarray, ny: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows may reach the threshold, and in how many cells each pair differs."""
    apart = np.zeros(len(x), np.int64)
    step = max(1, _FEW // int(one[2].max(initial=1)))
    for lo in range(0, len(x), step):
        p, q = x[lo : lo + step], y[lo : lo + step]
        m = np.minimum(one[2][p], two[2][q])
        at = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        other = one[0][np.repeat(one[1][p], m) + at] ^ two[0][np.repeat(two[1][q], m) + at]
        differ = (other > 15).astype(np.int64) + (other & 15 > 0)
        apart[lo : lo + step] = np.add.reduceat(differ, np.cumsum(m) - m)
    fit = 100 * np.minimum(nx[x], ny[y]) >= percent * np.maximum(nx[x], ny[y])
    return np.flatnonzero(fit & (apart <= (100 - percent) * (nx[x] + ny[y]) // (100 + percent))), apart


def _meet(table: pa.Table, percent: int) -> pa.RecordBatch:
    """Pairs of a visitor and a host of each group of ``table`` that may reach the threshold."""
    table = table.combine_chunks()
    column = lambda name: np.asarray(table[name])
    key, one, two = column("key"), column("one"), column("two")
    ids, comp, kind, n, visits = column("id"), column("comp"), column("kind"), column("n"), column("visits")
    new = np.ones(len(ids), bool)
    new[1:] = (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    group = np.cumsum(new)
    packed = _packed(table["sign"])
    found, active, k = [], np.arange(len(ids)), 1
    while True:
        active = active[active + k < len(ids)]
        active = active[group[active] == group[active + k]]
        if not len(active):
            break
        x, y = active, active + k
        k += 1
        a, b = kind[x], kind[y]
        fit = (visits[x] != visits[y]) & (comp[x] != comp[y]) & ((a & b & LOWER) == 0)
        fit &= 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
        equal = ((a & b & FULL) > 0) & (((a | b) & LOOKS) > 0)
        less = ((a & WITHOUT) > 0) & ((b & NEAR) > 0) | ((b & WITHOUT) > 0) & ((a & NEAR) > 0)
        less |= ((a & LOOKS_WITHOUT) > 0) & ((b & FULL) > 0) | ((b & LOOKS_WITHOUT) > 0) & ((a & FULL) > 0)
        fit &= equal | less
        x, y = x[fit], y[fit]
        keep, _ = _close(x, y, packed, packed, n, n, percent)
        found.append((ids[x[keep]], ids[y[keep]]))
    if found:
        a, b = (np.concatenate(c) for c in zip(*found))
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
    else:
        pairs = np.zeros((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of Jaccard similarity 0.9 or more on 3-word shingles."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""MinHash near-duplicate detection with sequential Bayesian verification.

Documents with equal shingle sets are one class; only class representatives are compared. Bands of a
MinHash signature bring candidates together. A candidate pair's signatures are compared batch by
batch: after m of n positions agree, the posterior probability that the similarity reaches the
threshold (uniform prior) is P(Binomial(n + 1, threshold) <= m), and the pair is pruned once this is
below ``miss``. Survivors are verified exactly on their full shingle sets.

Only components matter, so pairs inside one component need no test. First every document is compared
with the leaders of its buckets; then pairs of different components that share a bucket: the best few
of each document, and at last all that are left. Large buckets are cut into blocks: members of the
largest component stay in one block, the others visit all. Pairs are formed inside tasks and only
survivors of the pruning become rows.

With 32 bands of 4 a pair at the threshold 0.75 is missed by all bands with probability 5e-6; ``miss``
adds at most 1e-6 for each of the 32 batches. Documents in a shared bucket get ``extra`` positions more
than the bands need, so that few pairs below the threshold reach the exact test. Defined results: null and empty texts have no shingles and are linked with
nothing; fewer words than a shingle form one shingle; a row without doc_id has component null and is
kept; rows sharing a doc_id are judged each by its own text (where several of them represent a class,
they are one node); extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrays import Texts, gram_hash, letters, mix, prefix, slices, span_hash, window_owner
from tidemark.llm.exchange import Batches
from tidemark.llm.graph import components
from tidemark.runtime import cut_lineage

WORDS, THRESHOLD, BANDS, ROWS, BATCH = 5, 0.75, 32, 4, 32
MISS, EXTRA, BLOCK, BEST = 1e-6, 896, 512, 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z


def shingles(texts: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted, and the bounds of each text."""
    starts, ends, first = texts.words()
    hashes = span_hash(prefix(letters(0)[_LOWER[texts.data]], 0), starts, ends, 0)
    count = np.diff(first)
    at, owner = window_owner(count, words)
    grams = gram_hash(hashes, words, 1)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < words))
    whole = span_hash(prefix(hashes, 1), first[short], first[short + 1], 1)
    grams, owner = np.concatenate((grams, whole)), np.concatenate((owner, short))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def signatures(sets: np.ndarray, bounds: np.ndarray, size: int, first: int = 0) -> np.ndarray:
    """``size`` minima per non-empty set, beginning with hash function ``first``."""
    seeds = mix(np.arange(1, 2 * (first + size) + 1, dtype=np.uint64))[2 * first :]
    at = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(at), size), np.uint64)
    if len(at):
        for k in range(size):
            out[:, k] = np.minimum.reduceat((sets ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1)), at)
    return out


def short(minima: np.ndarray) -> np.ndarray:
    """Eight bits of every minimum; unequal minima agree once in 256, which prunes only less."""
    return (mix(minima) & np.uint64(255)).astype(np.uint8)


def least_matches(threshold: float, batch: int, size: int, miss: float) -> list[int]:
    """For each number of compared positions the least agreement that is not pruned."""
    out = []
    for n in range(batch, size + 1, batch):
        total, m = 0.0, 0
        while total < miss:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            m += 1
        out.append(m - 1)
    return out


def whole_groups(batches: Batches, names: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from a partition sorted by ``names``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(n)) for n in names]
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        cuts = np.flatnonzero(change)
        if held:
            last = [held[-1].column(n)[-1].as_py() for n in names]
            if last != [k[0] for k in keys]:
                yield pa.Table.from_batches(held)
                held = []
        if len(cuts):
            yield pa.Table.from_batches([*held, batch.slice(0, cuts[-1])])
            held = [batch.slice(cuts[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    words: int = WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
    miss: float = MISS,
    extra: int = EXTRA,
    block: int = BLOCK,
    best: int = BEST,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    size = bands * rows
    percent = round(100 * threshold)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sign(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            counts, prints, sigs, keys = [], [], [], []
            for texts in slices(batch.column("text")):
                sets, bounds = shingles(texts, words)
                n = np.diff(bounds)
                counts.append(n)
                full = n > 0
                at = bounds[:-1][full]
                both = np.zeros((len(n), 2), np.uint64)
                if len(at):
                    both[full, 0] = np.add.reduceat(sets, at)
                    both[full, 1] = np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), at)
                prints.append(both)
                mins = signatures(sets, bounds, size)
                brief = short(mins)
                parts = mix(mins.reshape(-1, rows) * mix(np.arange(1, rows + 1, dtype=np.uint64)))
                key = mix(np.add.reduce(parts, axis=1).reshape(-1, bands) + np.arange(1, bands + 1, dtype=np.uint64))
                pick = np.cumsum(full) - 1
                sigs += [brief[p].tobytes() if f else None for p, f in zip(pick, full)]
                keys += [key[p].view(np.int64) if f else None for p, f in zip(pick, full)]
            prints = np.concatenate(prints).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(counts).astype(np.int64)),
                 pa.array(np.ascontiguousarray(prints[:, 0])), pa.array(np.ascontiguousarray(prints[:, 1])),
                 pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n", "f1", "f2", "sig", "bands"],
            )

    def full_sets(batches: Batches) -> Batches:
        for batch in batches:
            parts, lengths, sigs = [], [], []
            for texts in slices(batch.column("text")):
                sets, bounds = shingles(texts, words)
                parts.append(sets.view(np.int64))
                lengths.append(np.diff(bounds))
                brief, full = short(signatures(sets, bounds, extra, size)), lengths[-1] > 0
                sigs += [brief[p].tobytes() if f else bytes(extra) for p, f in zip(np.cumsum(full) - 1, full)]
            if parts:
                offsets = np.concatenate(([0], np.cumsum(np.concatenate(lengths)))).astype(np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), arrays, pa.array(sigs, pa.binary())], names=["id", "shingles", "more"]
                )

    # signatures, and one representative per class of equal sets
    signed = cut_lineage(
        docs.mapInArrow(sign, "doc_id bigint, n bigint, f1 bigint, f2 bigint, sig binary, bands array<bigint>")
    )
    classes = (
        signed.where("n > 0 and doc_id is not null")
        .groupBy("f1", "f2", "n")
        .agg(F.min("doc_id").alias("id"), F.min_by("sig", "doc_id").alias("sig"), F.min_by("bands", "doc_id").alias("bands"))
    )
    classes = cut_lineage(classes)
    members = classes.select("id", F.posexplode("bands").alias("band", "bh")).withColumn("band", F.col("band").cast("int"))
    buckets = members.groupBy("bh").agg(
        F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id").alias("p"), "id"))["id"].alias("leader")
    ).where("n > 1")
    shared = cut_lineage(members.join(buckets.select("bh", "leader"), "bh"))
    involved = shared.select("id").distinct()
    signs = cut_lineage(classes.join(involved, "id", "left_semi").select("id", "n", "sig", "bands"))
    chosen = docs.join(involved, docs["doc_id"] == involved["id"]).select("id", "text")
    sets = cut_lineage(chosen.mapInArrow(full_sets, "id bigint, shingles array<bigint>, more binary"))

    limits = least_matches(threshold, BATCH, size + extra, miss)

    def agree(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows not pruned, and how many positions of each agree."""
        left, total = np.arange(len(a)), np.zeros(len(a), np.int64)
        for step, limit in enumerate(limits[: a.shape[1] // BATCH]):
            part = slice(step * BATCH, (step + 1) * BATCH)
            total[left] += (a[left, part] == b[left, part]).sum(axis=1)
            left = left[total[left] >= limit]
        return left, total

    def prune(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                left, total = agree(_matrix(table["sa"], np.uint8, size), _matrix(table["sb"], np.uint8, size))
                yield _pairs(np.asarray(batch.column("a"))[left], np.asarray(batch.column("b"))[left], total[left])

    def compare(top: int | None) -> Callable[[Batches], Batches]:
        def inside(batches: Batches) -> Batches:
            for table in whole_groups(batches, ["bh", "block"]):
                yield _compare_groups(table, agree, size + extra, bands, top)

        return inside

    def verified(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s"))
        two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("t"))
        shared_n = F.size(F.array_intersect("s", "t"))
        return (
            pairs.join(one, "a").join(two, "b")
            .select("a", "b", shared_n.alias("i"), (F.size("s") + F.size("t") - shared_n).alias("u"))
            .where(100 * F.col("i") >= percent * F.col("u"))
            .select("a", "b")
        )

    # first links: every document with the best of its leaders
    led = shared.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    led = (
        led.join(signs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
        .join(signs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
        .select("a", "b", "sa", "sb")
        .mapInArrow(prune, "a bigint, b bigint, m bigint")
        .groupBy("a")
        .agg(F.max(F.struct("m", "b"))["b"].alias("b"))
    )
    links = cut_lineage(verified(led))
    found = cut_lineage(components(links))
    for top in (best, None):
        placed = shared.join(found, "id", "left").select("bh", "band", "id", F.coalesce("component", "id").alias("comp"))
        mixed = (
            placed.groupBy("bh", "comp").agg(F.count("*").alias("c"))
            .groupBy("bh").agg(F.count("*").alias("k"), F.sum("c").alias("n"), F.max_by("comp", F.struct("c", "comp")).alias("main"))
            .where("k > 1")
            .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
        )
        home = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        rowset = (
            placed.join(mixed, "bh")
            .withColumn("query", F.col("comp") != F.col("main"))
            .withColumn("home", home)
            .withColumn(
                "block",
                F.explode(F.when(F.col("query"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("home"))),
            )
            .withColumn("home", F.col("home") == F.col("block"))
            .join(signs.select("id", "sig", "bands"), "id")
            .join(sets.select("id", "more"), "id")
            .select("bh", "block", "band", "id", "comp", "query", "home", F.concat("sig", "more").alias("sig"), "bands")
            .repartition("bh", "block")
            .sortWithinPartitions("bh", "block")
        )
        links = cut_lineage(verified(rowset.mapInArrow(compare(top), "a bigint, b bigint, m bigint").select("a", "b")))
        label = lambda side: F.coalesce(F.col(f"{side}c"), F.col(side))
        lifted = (
            links.join(found.select(F.col("id").alias("a"), F.col("component").alias("ac")), "a", "left")
            .join(found.select(F.col("id").alias("b"), F.col("component").alias("bc")), "b", "left")
            .select(label("a").alias("a"), label("b").alias("b"))
        )
        above = components(lifted).select(F.col("id").alias("component"), F.col("component").alias("root"))
        known = found.join(above, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
        fresh = above.select(F.col("component").alias("id"), F.col("root").alias("component"))
        found = cut_lineage(known.union(fresh.join(found.select("id"), "id", "left_anti")))

    rooted = classes.select("f1", "f2", "n", "id").join(found, "id", "left").select(
        "f1", "f2", "n", F.coalesce("component", "id").alias("component")
    )
    joined = signed.select("doc_id", "n", "f1", "f2").join(rooted, ["f1", "f2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _pairs(a: np.ndarray, b: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(m)], names=["a", "b", "m"])


def _compare_groups(table: pa.Table, agree: Callable, size: int, bands: int, top: int | None) -> pa.RecordBatch:
    """Surviving pairs of different components in each (bucket, block) of ``table``.

    A pair is judged in the first band it shares only; two visitors meet in the home block of the
    smaller id.
    """
    column = lambda name: np.asarray(table[name].combine_chunks())
    ids, comp, band = column("id"), column("comp"), column("band")
    query, home = column("query"), column("home")
    bh, blk = column("bh"), column("block")
    sig = _matrix(table["sig"], np.uint8, size)
    keys = np.asarray(table["bands"].combine_chunks().flatten()).reshape(-1, bands)
    new = np.ones(len(ids), bool)
    new[1:] = (bh[1:] != bh[:-1]) | (blk[1:] != blk[:-1])
    group = np.cumsum(new)
    found, active, k = [], np.arange(len(ids)), 1
    while True:
        active = active[active + k < len(ids)]
        active = active[group[active] == group[active + k]]
        if not len(active):
            break
        x, y = active, active + k
        low = np.where(ids[x] < ids[y], x, y)
        fit = (comp[x] != comp[y]) & (query[x] | query[y]) & ((~query[x] | ~query[y]) | home[low])
        x, y = x[fit], y[fit]
        if len(x):
            first = (keys[x] == keys[y]).argmax(axis=1) == band[x]
            x, y = x[first], y[first]
            left, total = agree(sig[x], sig[y])
            found.append((ids[x[left]], ids[y[left]], total[left]))
        k += 1
    if not found:
        none = np.zeros(0, np.int64)
        return _pairs(none, none, none)
    a, b, m = (np.concatenate(c) for c in zip(*found))
    if top is not None and len(a):
        strangers, keep = np.unique(ids[query]), np.zeros(len(a), bool)
        for side in (a, b):
            order = np.lexsort((-m, side))
            head = np.ones(len(a), bool)
            head[1:] = side[order][1:] != side[order][:-1]
            start = np.maximum.accumulate(np.where(head, np.arange(len(a)), 0))
            keep[order] |= (np.arange(len(a)) - start < top) & np.isin(side[order], strangers)
        a, b, m = a[keep], b[keep], m[keep]
    return _pairs(np.minimum(a, b), np.maximum(a, b), m)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

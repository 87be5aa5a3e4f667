"""SimHash near-dedup with pigeonring filtering.

Fingerprints are compared as rings of eight 8-bit segments. If two differ in at
most T = 3 bits there is a segment from which on every chain of l neighbouring
segments differs in at most l * T / 8 bits (the pigeonring principle). Chains
of one and two segments must then agree and chains of up to five may differ in
one bit; of the third to fifth segment one half therefore agrees too. Start,
half and these 28 bits are the key under which candidates meet; every pair that
meets is held against the budgets of all chain lengths before its full Hamming
distance is taken.

Distinct fingerprints are compared, so copies cost nothing. A key's members are
compared in blocks; where there are very many, their remaining bits are split
in four parts of which one must agree, which is exact. A key gives a spanning
forest of its links, not all pairs, and the forests are joined into components
by alternating large and small stars in the shared folder.

Defined cases: a text without words (null, empty, white space) has fingerprint
zero and is linked like any other; fewer than three words make one shingle;
repeated rows have the same fingerprint; a null doc_id takes part but never
names a component unless all of its ids are null; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import drop_materialized, materialize, slices

SHINGLE, SEED, DISTANCE = 3, 42, 3
SEGMENTS, SEGMENT_BITS = 8, 8
#: Members of a key that are compared all with all; more are split by their remaining bits first.
BLOCK = 1024
_BYTE_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of every shingle of a lower-cased text."""
    import xxhash

    words = text.split()  # on [\x20\x09-\x0D]
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    hash_ = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([hash_(whole, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    spans = zip(starts[: -SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    return np.array([hash_(whole[s:e], SEED) for s, e in spans], np.uint64)


def fingerprint(text: str | None) -> int:
    """The bits that more than half of the shingle hashes have."""
    hashes = shingle_hashes((text or "").encode().lower())
    if not len(hashes):
        return 0
    return int(majority(hashes, np.array([0, len(hashes)]))[0])


def majority(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of hashes (offsets ``at``, none empty): the bits that more than half of them have."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.stack([np.add.reduce(bits[i:j], axis=0, dtype=np.int32) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]) if len(at) > 1 else np.zeros((0, 64), np.int32)
    return np.packbits(2 * ones > np.diff(at)[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def ring_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, index of the fingerprint) of all starts and halves."""
    keys = []
    for start in range(SEGMENTS):
        turned = rotate(fps, start)
        for half in range(2):
            low = turned & np.uint64(0xFFFF)
            mid = turned >> np.uint64(16 + 12 * half) & np.uint64(0xFFF)
            keys.append(np.uint64(start * 2 + half) << np.uint64(28) | low << np.uint64(12) | mid)
    return np.concatenate(keys), np.tile(np.arange(len(fps)), 2 * SEGMENTS)


def rotate(fps: np.ndarray, start: int) -> np.ndarray:
    """The ring turned so that segment ``start`` comes first."""
    by = np.uint64(start * SEGMENT_BITS)
    return fps if not start else fps >> by | fps << (np.uint64(64) - by)


def within(left: np.ndarray, right: np.ndarray, start: int) -> np.ndarray:
    """Which pairs keep every chain budget from ``start`` and the full distance; shapes broadcast."""
    differing = rotate(np.bitwise_xor(left, right), start)
    total = np.zeros(differing.shape, np.uint8)
    good = np.ones(differing.shape, bool)
    for length in range(1, SEGMENTS + 1):
        segment = (differing >> np.uint64(SEGMENT_BITS * (length - 1)) & np.uint64(0xFF)).astype(np.uint8)
        total += _BYTE_ONES[segment]
        good &= total * SEGMENTS <= length * DISTANCE
    return good  # the chain of all segments is the full Hamming check


def _links_of(fps: np.ndarray, start: int, free: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Append index pairs of all links among fps; ``free`` are the bits in which they may differ."""
    n = len(fps)
    if n <= BLOCK or len(free) <= 12:
        for low in range(0, n, BLOCK):
            for other in range(low, n, BLOCK):
                good = within(fps[low : low + BLOCK, None], fps[None, other : other + BLOCK], start)
                a, b = np.nonzero(np.triu(good, 1) if low == other else good)
                if len(a):
                    found.append((a + low, b + other))
        return
    for part in np.array_split(free, 4):  # three differing bits leave one of four parts the same
        mask = np.bitwise_or.reduce(np.uint64(1) << part)
        values = fps & mask
        order = np.argsort(values, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], values[order][1:] != values[order][:-1], [True]]))
        rest = np.setdiff1d(free, part)
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if high - low > 1:
                member = order[low:high]
                inner: list[tuple[np.ndarray, np.ndarray]] = []
                _links_of(fps[member], start, rest, inner)
                found += [(member[a], member[b]) for a, b in inner]


def forest(fps: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least of its linked set) for a key's members that are linked with others."""
    start, half = (key >> 28) // 2, (key >> 28) % 2
    fixed = [*range(16), *range(16 + 12 * half, 28 + 12 * half)]
    free = np.array([(b + start * SEGMENT_BITS) % 64 for b in range(64) if b not in fixed], np.uint64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    _links_of(fps, start, free, found)
    label = np.arange(len(fps))
    if found:
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        while True:
            before = label.copy()
            least = np.minimum(label[a], label[b])
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            label = label[label]
            if (label == before).all():
                break
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def links(distinct: DataFrame, partitions: int) -> DataFrame:
    """(u, v) with v < u: spanning forests of the links between distinct fingerprints, by key."""

    def spread(batches):
        for batch in batches:
            keys, index = ring_keys(np.asarray(batch.column("fp")).view(np.uint64))
            fps = np.asarray(batch.column("fp"))[index]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fps)], ["key", "fp"])

    def meet(batches):
        held_key, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in _with_end(batches):
            if batch is not None:
                held_key = np.concatenate([held_key, np.asarray(batch.column("key"))])
                held = np.concatenate([held, np.asarray(batch.column("fp"))])
                done = int(np.searchsorted(held_key, held_key[-1])) if len(held_key) else 0
            else:
                done = len(held_key)
            if not done:
                continue
            keys, fps = held_key[:done], held[:done]
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            out = []
            for i in np.flatnonzero(np.diff(cuts) > 1):
                members = np.unique(fps[cuts[i] : cuts[i + 1]].view(np.uint64))
                if len(members) > 1:
                    out.append(forest(members, int(keys[cuts[i]])))
            held_key, held = held_key[done:], held[done:]
            if out:
                u, v = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    keyed = distinct.select("fp").mapInArrow(spread, "key long, fp long")
    return keyed.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(meet, "u long, v long").distinct()


def _with_end(batches):
    yield from batches
    yield None


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes that are not their component's root, by alternating large and small stars.

    Each round joins the edges with the least neighbour of a node, so no node's
    neighbours are ever collected. Rounds are written to the shared folder.
    """
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "star")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(smallest, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        after = materialize(small.filter("u <> v").distinct(), "star")
        mark = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        same = mark(edges) == mark(after)
        drop_materialized(edges)
        edges = after
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that can be reached)."""
    spark = docs.sparkSession
    found = materialize(fingerprints(docs), "simhash-fp")
    distinct = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    roots = components(links(distinct, partitions))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "simhash-roots")
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = named.join(best, "root").select(F.col("fp").alias("n_fp"), "component_id")
    return found.join(label, F.col("fp") == F.col("n_fp")).select("doc_id", "fp", "component_id")


def op8_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

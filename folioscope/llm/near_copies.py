"""Near copies by SimHash, pigeonring chains and exact similarity: texts whose sets of five-word shingles have Jaccard similarity 0.8 or more.

Equal sets are one node. A set is laid on a ring of segments by the upper bits
of its shingles' hashes. Two sets that similar differ in T shingles at most, T
being a ninth of both sizes together, so on a ring of T + 1 segments there is
one from which on every chain of l segments differs in at most l - 1 shingles
(the pigeonring principle); the bound is exact, so no link can be missed. The
chain of one segment must agree: start and content are the key under which
candidates meet. The next seven go along as parities of eight bits each, whose
differing bits never outnumber the differing shingles, and every pair that meets
is held against the budgets of these chains before anything else is compared.
The number of segments is that of the size class of the smaller set: a set is on
the ring of its own class, and as a guest on that of the class below, where two
guests do not count as a pair.

Pairs that keep the budgets are held against the Hamming distance of their
128-bit SimHash fingerprints (simhash.py); sets whose similarity is 0.8 differ in
19 bits on average, with a deviation of 4, unrelated ones in 64, and DISTANCE is
five deviations above the former. At so wide a distance no segment of the
fingerprints need agree, which is why the ring is laid through the shingles and
not through the fingerprints. Fingerprints of fewer than SMALL shingles say
too little and are not asked. Beside them go the parities of a set's shingles in
512 buckets. What is left is compared set against set.

Three rounds keep large groups of copies linear. The first links the members of
a key in chains, by turned fingerprints, with another turn for each key, under
some FIRST keys of a ring. The second ties each member that is not of its key's
greatest component, if that is large, to the nearest fingerprints outside its
own. The third takes all pairs that are still in different components. A key
with more than GROUP members is split in blocks: chains run inside blocks, the
other rounds take every pair of blocks.

Defined cases: letters A-Z are taken in lower case; fewer than five words make
one shingle, and texts without words (null, empty, white space) are copies of
each other; a null doc_id takes part but never names a component unless all of
its ids are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import NULL_ID, PolyHash, byte_rows, drop_materialized, fresh_names, materialize, mix64, slices, word_spans
from folioscope.llm.simhash import components, majority, rotate

WORDS = 5
#: Bits in which fingerprints of similar sets may differ, and shingles from which fingerprints count.
DISTANCE, SMALL = 40, 16
#: Keys of a ring in the first round, on average; members that are compared at once, members of one group.
FIRST, BLOCK, GROUP = 8, 512, 1 << 16
#: Nearest fingerprints that the second round tries for a member, and members that a key's greatest component must have for it.
NEAREST, TIED = 4, 8
#: Segments of a chain after the one that is the key, one byte of a word each; the bit above them marks guests.
NEXT = 7
_CHAINS = [np.uint64((1 << 8 * length) - 1) for length in range(1, NEXT + 1)]
_GUEST = np.uint64(1 << 8 * NEXT)
#: Bytes of a shingle's hash that are compared; two shingles of two sets of 1,000 agree in them by chance once in 10 ** 8 pairs of sets.
PACKED = 6
#: Pairs in one batch.
PAIRS = 1 << 18

_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


def least_overlap(total):
    """Shingles that sets of ``total`` shingles together share at similarity 0.8."""
    return -(-4 * total // 9)


def _size_classes() -> np.ndarray:
    lows = [1]
    while lows[-1] < 1 << 32:
        lows.append(max(lows[-1] + 1, lows[-1] * 5 // 4))
    return np.array(lows)


#: Least sizes of the classes, and the segments of their rings: one more than a set of the class and one as large or larger may differ in.
LOWS = _size_classes()
SEGMENTS = (LOWS[1:] - 1) // 4 + 1


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle) of every distinct shingle of a row, in order, and the rows' offsets among them."""
    data, offsets = byte_rows(column)
    starts, ends, at = word_spans(data, offsets)
    words = mix64(PolyHash(_LOWER[data]).ranges(starts, ends))
    count = np.diff(at)
    many = np.where(count > 0, np.maximum(count - WORDS + 1, 1), 0)
    row = np.repeat(np.arange(len(count)), many)
    first = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + at[:-1][row]
    values = mix64(PolyHash(words).ranges(first, np.minimum(first + WORDS, at[1:][row])))
    bare = np.flatnonzero(many == 0)
    row, values = np.concatenate([row, bare]), np.concatenate([values, np.zeros(len(bare), np.uint64)])
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    if len(row):
        fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (values[1:] != values[:-1])])
        row, values = row[fresh], values[fresh]
    return row, values, np.searchsorted(row, np.arange(len(count) + 1))


#: Longs of a signature: two of the fingerprint, eight of the parities.
PARITIES = 512
SIGNATURE = ["fp0", "fp1", *(f"p{i}" for i in range(PARITIES // 64))]
_SALT = np.uint64(0xA24BAED4963EE407)


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fingerprint and parities of runs of shingles (offsets ``at``), a row of longs each."""
    rows = len(at) - 1
    place = np.repeat(np.arange(rows), np.diff(at)) * PARITIES + (values >> np.uint64(40)).astype(np.int64) % PARITIES
    odd = (np.bincount(place, minlength=rows * PARITIES).reshape(-1, PARITIES) & 1).astype(bool)
    parity = np.packbits(odd, axis=1, bitorder="little").view("<u8").reshape(rows, -1)
    return np.column_stack([majority(values, at), majority(mix64(values ^ _SALT), at), parity]).view(np.int64)


_SIGNED = f"doc_id long, hash long, sig long, n long, {', '.join(f'{c} long' for c in SIGNATURE)}"


def _signed(rows: DataFrame) -> DataFrame:
    """doc_id, hash, sig, n and the signature: a row's id, hash of its text, hash, size and SIGNATURE of its set."""
    names = [x.split()[0] for x in _SIGNED.split(", ")]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                _, values, at = shingle_sets(part.column("text"))
                n = np.diff(at)
                sig = mix64(np.add.reduceat(mix64(values + np.uint64(1)), at[:-1]) + n.astype(np.uint64))
                found = [pa.array(x, pa.int64()) for x in (sig.view(np.int64), n, *signatures(values, at).T)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("hash"), *found], names)

    return rows.mapInArrow(run, _SIGNED)


def rings(values: np.ndarray, at: np.ndarray):
    """By ring that sets (ordered shingles, offsets ``at``) are on: (set, key, chain, first) of each segment."""
    n = np.diff(at)
    own = np.searchsorted(LOWS, n, side="right") - 1
    for below in range(len(LOWS)):
        kind = np.maximum(own - below, 0)
        sets = np.flatnonzero((own >= below) & (5 * (LOWS[kind + 1] - 1) >= 4 * n))
        if not len(sets):
            return
        kind, size, m = kind[sets], n[sets], SEGMENTS[kind[sets]]
        begin = np.cumsum(m) - m
        mine = values[np.repeat(at[sets] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        place = np.repeat(begin, size) + ((mine >> np.uint64(32)).astype(np.int64) * np.repeat(m, size) >> 32)
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        content, parity = np.zeros(m.sum(), np.uint64), np.zeros(m.sum(), np.uint64)
        content[place[starts]] = np.add.reduceat(mix64(mine + np.uint64(1)), starts)
        parity[place[starts]] = np.bitwise_xor.reduceat(np.uint64(1) << (mine & np.uint64(7)), starts)
        whole, begin = np.repeat(m, m), np.repeat(begin, m)
        segment = np.arange(len(whole)) - begin
        key = mix64(content + mix64((np.repeat(kind, m) << 32 | segment).astype(np.uint64) + np.uint64(1)))
        chain = np.full(len(whole), _GUEST if below else 0, np.uint64)
        for step in range(1, NEXT + 1):
            after = parity[begin + (segment + step) % whole] << np.uint64(8 * (step - 1))
            chain |= np.where(step < whole, after, np.uint64(0))
        yield np.repeat(sets, m), key, chain, (key >> np.uint64(32)).astype(np.int64) * whole < FIRST << 32


def _on_rings(sets: DataFrame) -> DataFrame:
    """key, sig, chain of every segment of a set's rings, and whether the first round takes it."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                _, values, at = shingle_sets(part.column("text"))
                sig = np.asarray(part.column("sig"))
                for row, key, chain, first in rings(values, at):
                    columns = [key.view(np.int64), sig[row], chain.view(np.int64), first]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "sig", "chain", "first"])

    return sets.select("sig", "text").mapInArrow(run, "key long, sig long, chain long, first boolean")


def _apart(words: np.ndarray, a, b, which: range) -> np.ndarray:
    """Differing bits of the given words of two members' signatures."""
    return sum(np.bitwise_count(words[i][a] ^ words[i][b]).astype(np.int16) for i in which)


def viable(differing: np.ndarray) -> np.ndarray:
    """Which differing bits of chains keep the budget of every length."""
    return np.logical_and.reduce([np.bitwise_count(differing & low) <= length for length, low in enumerate(_CHAINS, 1)])


def plausible(n: np.ndarray, chains: np.ndarray, words: np.ndarray, a, b, asked=True) -> np.ndarray:
    """Which of the asked pairs of members (index arrays that broadcast) chains, sizes, fingerprints and parities allow; words: the signatures by word."""
    differing = chains[a] ^ chains[b]
    good = asked & (np.bitwise_count(differing & _CHAINS[0]) <= 1) & (chains[a] & chains[b] < _GUEST)  # the shortest chain settles most
    at = np.nonzero(good)
    a, b = (np.broadcast_to(x, good.shape)[at] for x in (a, b))
    low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    keep = np.flatnonzero(viable(differing[at]) & (5 * low >= 4 * high))
    a, b, low, total = a[keep], b[keep], low[keep], (low + high)[keep]
    left = (_apart(words, a, b, range(2)) <= DISTANCE) | (low < SMALL)
    left &= _apart(words, a, b, range(2, len(SIGNATURE))) <= total - 2 * least_overlap(total)
    good[at] = False
    good[tuple(x[keep[left]] for x in at)] = True
    return good


def chain(key: int, own: np.ndarray, n: np.ndarray, label: np.ndarray, chains: np.ndarray, words: np.ndarray):
    """Pairs of neighbours by fingerprints, turned in the key's own way."""
    order = np.argsort(rotate(words[key // 8 % 2], key % 8), kind="stable")
    a, b = order[:-1], order[1:]
    good = plausible(n, chains, words, a, b)
    yield a[good], b[good]


def reach(key: int, own: np.ndarray, n: np.ndarray, label: np.ndarray, chains: np.ndarray, words: np.ndarray):
    """For members outside the most frequent label, the nearest fingerprints of other labels."""
    names, which, count = np.unique(label, return_inverse=True, return_counts=True)
    if len(names) == 1 or count.max() < TIED:
        return
    few = np.flatnonzero(which != np.argmax(count))
    for low in range(0, len(few), BLOCK):
        a = few[low : low + BLOCK]
        near = np.full((len(a), NEAREST), -1)
        best = np.full((len(a), NEAREST), 999, np.int64)
        for other in range(0, len(n), BLOCK):
            b = np.arange(other, min(other + BLOCK, len(n)))
            i, j = np.nonzero(plausible(n, chains, words, a[:, None], b[None, :], label[a][:, None] != label[b][None, :]))
            apart = np.full((len(a), len(b)), 999, np.int64)
            apart[i, j] = _apart(words, a[i], b[j], range(2))
            both, who = np.concatenate([best, apart], 1), np.concatenate([near, np.broadcast_to(b, apart.shape)], 1)
            pick = np.argpartition(both, NEAREST - 1, axis=1)[:, :NEAREST]
            best, near = np.take_along_axis(both, pick, 1), np.take_along_axis(who, pick, 1)
        i, j = np.nonzero(best < 999)
        yield a[i], near[i, j]


def across(key: int, own: np.ndarray, n: np.ndarray, label: np.ndarray, chains: np.ndarray, words: np.ndarray):
    """All plausible pairs of different labels; of two blocks, those with one of each."""
    if (label == label[0]).all():
        return
    two = (own != own[0]).any()
    order = np.argsort(n, kind="stable")
    size = n[order]
    for low in range(0, len(n), BLOCK):
        a = order[low : low + BLOCK]
        top = np.searchsorted(4 * size, 5 * size[min(low + BLOCK, len(n)) - 1], side="right")
        for other in range(low, top, BLOCK):
            b = order[other : other + BLOCK]
            asked = label[a][:, None] != label[b][None, :]
            if two:
                asked &= own[a][:, None] != own[b][None, :]
            i, j = np.nonzero(plausible(n, chains, words, a[:, None], b[None, :], np.triu(asked, 1) if low == other else asked))
            if len(i):
                yield a[i], b[j]


_MET = ["key", "low", "high", "own", "sig", "n", "label", "chain", *SIGNATURE]


def _candidates(shared: DataFrame, roots: DataFrame | None, partitions: int, pairs, cross: bool) -> DataFrame:
    """Distinct (u, v) with v < u of the pairs that meet under a key."""
    blocks = F.ceil(F.col("members") / GROUP)
    met = shared.withColumn("own", F.pmod(F.xxhash64("sig", "key"), blocks))
    if roots is None:
        met = met.withColumn("label", F.col("sig"))
    else:
        met = met.join(roots, F.col("sig") == F.col("node"), "left").withColumn("label", F.coalesce("root", "sig"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)) if cross else F.col("own")
    met = met.withColumn("other", other).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    met = met.select(*(F.col(c).cast("long").alias(c) for c in _MET))

    def meet(batches):
        held, out, made = None, [], 0
        for batch in _with_end(batches):
            if batch is not None:
                new = [np.asarray(batch.column(i)) for i in range(len(_MET))]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if held is None or not len(held[0]):
                continue
            fresh = np.logical_or.reduce([x[1:] != x[:-1] for x in held[:3]])
            cuts = np.concatenate([[0], np.flatnonzero(fresh) + 1])
            done = len(held[0]) if batch is None else int(cuts[-1])
            if not done:
                continue
            cuts = np.append(cuts[cuts < done], done)
            for i in np.flatnonzero(np.diff(cuts) > 1):
                at = slice(cuts[i], cuts[i + 1])
                own, sig, n, label, *more = (x[at] for x in held[3:])
                chains, *words = (x.view(np.uint64) for x in more)
                for a, b in pairs(int(held[0][cuts[i]]), own, n, label, chains, words):
                    out.append((sig[a], sig[b]))
                    made += len(a)
                    if made >= PAIRS:
                        yield _pairs_of(out)
                        out, made = [], 0
            held = [x[done:] for x in held]
        if made:
            yield _pairs_of(out)

    return met.repartition(partitions, "key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(meet, "u long, v long").distinct()


def _pairs_of(out: list) -> pa.RecordBatch:
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])


def _with_end(batches):
    yield from batches
    yield None


def _packed(sets: DataFrame) -> DataFrame:
    """sig and the set's shingles, six bytes each."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                _, values, at = shingle_sets(part.column("text"))
                six = values.view(np.uint8).reshape(-1, 8)[:, :PACKED]
                packed = [six[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("sig"), pa.array(packed, pa.binary())], ["sig", "packed"])

    return sets.select("sig", "text").mapInArrow(run, "sig long, packed binary")


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // PACKED, 8), np.uint8)
    out[:, :PACKED] = np.frombuffer(raw, np.uint8).reshape(-1, PACKED)
    return out.view(np.uint64).reshape(-1)


def _links(sets: DataFrame, pairs: DataFrame, partitions: int) -> DataFrame:
    """The pairs whose similarity is 0.8 or more."""

    def verify(batches):
        for batch in batches:
            good = []
            for one, two in zip(batch.column("packed_u").to_pylist(), batch.column("packed_v").to_pylist(), strict=True):
                one, two = unpacked(one), unpacked(two)
                good.append(len(np.intersect1d(one, two, assume_unique=True)) >= least_overlap(len(one) + len(two)))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    ends = pairs.select(F.col("u").alias("sig")).unionByName(pairs.select(F.col("v").alias("sig"))).distinct()
    packed = materialize(_packed(sets.join(ends, "sig", "left_semi")), "near-packed")
    both = pairs
    for end in ("u", "v"):
        both = both.join(packed.select(F.col("sig").alias(end), F.col("packed").alias(f"packed_{end}")), end)
    links = materialize(both.select("u", "v", "packed_u", "packed_v").mapInArrow(verify, "u long, v long"), "near-links")
    drop_materialized(packed)
    return links


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), root (of its component) and component_id (the smallest doc_id that can be reached) of every row."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), F.col("text").cast("string").alias("text"))
    signed = materialize(_signed(rows), "near-signed")
    of = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash", "n", *SIGNATURE)).alias("of")
    nodes = materialize(signed.groupBy("sig").agg(of).select("sig", "of.doc_id", "of.hash", "of.n", *(f"of.{c}" for c in SIGNATURE)), "near-nodes")
    key = [F.coalesce("doc_id", F.lit(NULL_ID)).alias("its_id"), F.col("hash").alias("its_hash")]
    # one row of each text, so copies without an id or with the same id don't meet themselves
    sets = materialize(rows.select(*key, "text").join(nodes.select(*key, "sig"), ["its_id", "its_hash"]).select("sig", "text").dropDuplicates(["sig"]), "near-sets")
    members = F.count(F.lit(1)).over(Window.partitionBy("key"))
    shared = _on_rings(sets).repartition(partitions, "key").withColumn("members", members).filter("members > 1")
    held = materialize(shared, "near-shared")
    shared = held.join(nodes.select("sig", "n", *SIGNATURE), "sig").select("key", "sig", "chain", "first", "members", "n", *SIGNATURE)
    tried, links, roots = None, None, None
    for pairs, cross in ((chain, False), (reach, True), (across, True)):
        met = _candidates(shared.filter("first") if pairs is chain else shared, roots, partitions, pairs, cross)
        if tried is not None:
            met = met.join(tried, ["u", "v"], "left_anti")
        met = materialize(met, "near-pairs")
        tried = met if tried is None else tried.unionByName(met)
        found = _links(sets, met, partitions)
        links = found if links is None else links.unionByName(found)
        roots = components(links)
    for table in (sets, held):  # the texts are the bulk of what has been written
        drop_materialized(table)
    named = nodes.join(roots, F.col("sig") == F.col("node"), "left").select("sig", "doc_id", F.coalesce("root", "sig").alias("root"))
    best = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    label = named.join(best, "root").select("sig", "root", "component_id")
    return signed.join(label, "sig").select("doc_id", "hash", "root", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest id, of equal ids and texts any one; an id that is null comes last."""
    place = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "hash")
    labels = materialize(near_copies(docs), "near-labels")
    texts = labels.groupBy("root", "doc_id", "hash").agg(F.count(F.lit(1)).alias("copies"))
    least = texts.groupBy("root").agg(F.min(place).alias("least"))
    marked = texts.join(least, "root").withColumn("stays", place == F.col("least")).filter("NOT stays OR copies > 1")
    names = dict(zip(("doc_id", "hash"), fresh_names(docs, "_near_id", "_near_hash"), strict=True))
    marked = materialize(marked.select(F.col("doc_id").alias(names["doc_id"]), F.col("hash").alias(names["hash"]), "stays"), "near-marked")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(names["doc_id"])) & (F.xxhash64(docs["text"]) == F.col(names["hash"]))
    out = docs.join(marked.drop("stays"), same, "left_anti")
    again = marked.filter("stays").drop("stays")
    if not again.isEmpty():
        out = out.unionByName(docs.join(again, same).dropDuplicates(list(names.values())).select(*docs.columns))
    return out

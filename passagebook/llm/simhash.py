"""SimHash near-dedup with pigeonring filtering.

A fingerprint has 64 bits; a bit is set if it is set in over half the hashes of a text's
word shingles. Two fingerprints that differ in at most t bits are linked.

The 64 bits are cut into m = 2t + 1 segments on a ring. If the differences of all segments
sum to at most t, then some segment starts a chain of which every prefix of l segments has
at most l * t / m differences: chains of one and two segments have none, a chain of three
or four has at most one. So two neighbouring segments agree and, of the next two, at least
one. These three segments are the key under which fingerprints meet, once for each start
and choice. Within a key the budgets of all longer chains are checked, the last of which
is the full Hamming distance.

A key leaves 64 bits less three segments open, so no group can pass that many distinct
fingerprints. Small groups are compared directly. Large ones are first cut by the parts of
the open bits, then by flipping single bits: members that meet after one flip each differ
in two bits at most. Either way the work of a group is near its size, and what is sent on
is a star for each set of linked members, never all pairs.

Defined results: a null text is empty, and texts without words have fingerprint zero, which
is linked like any other. Fewer words than a shingle make one shingle of all words. Repeated
rows and repeated ids each come back. A null id is never the name of a component unless
no row of the component has an id. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagebook.llm.common import LOWER, mix, texts_of
from passagebook.llm.components import components
from passagebook.sources.session import Scratch, materialize

SEED = 42
#: Groups above this size are not compared pair by pair.
WIDE = 48
#: Shingles hashed at once.
STRIP = 1 << 17

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)
_HASH = xxhash.xxh64_intdigest


def shingle_hashes(text: bytes, size: int):
    """XXH64 of each shingle, in strips, so that a very long text needs little more room
    than its words."""
    words = text.translate(LOWER).split()
    if not words:
        return
    if len(words) < size:
        yield np.array([_HASH(b" ".join(words), SEED)], dtype=np.uint64)
        return
    for s in range(0, len(words) - size + 1, STRIP):
        part = words[s : s + STRIP + size - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = (ends[: len(part) - size + 1] - [len(w) + 1 for w in part[: len(part) - size + 1]]).tolist()
        stops = (ends[size - 1 :] - 1).tolist()
        yield np.array([_HASH(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64)


def fingerprint(text: bytes, size: int) -> int:
    counts, total = np.zeros((8, 256), np.float64), 0
    for hashes in shingle_hashes(text, size):
        octets = hashes.view(np.uint8).reshape(-1, 8)
        for i in range(8):
            counts[i] += np.bincount(octets[:, i], minlength=256)
        total += len(hashes)
    if not total:
        return 0
    set_bits = (counts @ _BITS).reshape(64) * 2 > total
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 5, ident: str = "doc_id", text: str = "text", beside: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fp) of every row and the longs `beside`; fp holds the 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            prints = np.fromiter((fingerprint(t, size) for t in texts_of(batch.column(1))), np.uint64, batch.num_rows)
            others = [batch.column(2 + i) for i in range(len(beside))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), *others], ["doc_id", "fp", *beside])

    kinds = ", ".join(f"{c} long" for c in ("doc_id", "fp", *beside))
    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"), *beside).mapInArrow(run, kinds)


class Ring:
    """Segments, keys and budgets for a distance."""

    def __init__(self, most: int):
        if not 1 <= most <= 6:
            raise ValueError("the distance must be from 1 to 6")
        self.most, self.segments = most, 2 * most + 1
        cuts = [round(i * 64 / self.segments) for i in range(self.segments + 1)]
        self.masks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(self.segments)]

    def chain(self, start: int, length: int) -> int:
        mask = 0
        for i in range(start, start + length):
            mask |= self.masks[i % self.segments]
        return mask

    def keys(self) -> list[tuple[int, int]]:
        """(start, mask of the bits that agree)."""
        out = []
        for i in range(self.segments):
            two = self.chain(i, 2)
            # On a ring of three segments the chain of four is the ring itself, once round.
            nexts = (2, 3) if self.segments > 3 else ()
            out += [(i, two | self.masks[(i + j) % self.segments]) for j in nexts] or [(i, two)]
        return out

    def budgets(self, start: int) -> list[tuple[int, int]]:
        """(mask, most differences) of the chains longer than two."""
        return [(self.chain(start, n), n * self.most // self.segments) for n in range(3, self.segments + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _stars(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index linked to each index, over all paths."""
    root = np.arange(count)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            break
    return root


def _within(x: np.ndarray, budgets) -> np.ndarray:
    """Which differences x keep the budgets of all chains."""
    keep = np.ones(len(x), bool)
    for mask, most in budgets:
        keep[keep] = np.bitwise_count(x[keep] & np.uint64(mask)) <= most
    return keep


def _pairs(fps: np.ndarray, group: np.ndarray, budgets) -> tuple[np.ndarray, np.ndarray]:
    """Linked index pairs of small groups; group holds the number of each row's group."""
    left, right = [], []
    for d in range(1, WIDE):
        i = np.flatnonzero(group[d:] == group[:-d])
        if not len(i):
            break
        i = i[_within(fps[i] ^ fps[i + d], budgets)]
        left.append(i)
        right.append(i + d)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def _large(fps: np.ndarray, free: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a large group whose members differ in the free bits only, by flips.

    At most `most` differing bits means at most half of them, rounded up, on one side and
    the rest on the other: the two meet when each is flipped so often. Where members meet,
    that with the fewest flips is near enough to all others that any of them may be linked
    to there, so each is compared with it alone.
    """
    order = np.argsort(fps, kind="stable")
    links_a, links_b = [], []

    def meet(index: np.ndarray, bits: list[int], flips: int):
        values, who = [fps[index]], [index]
        for _ in range(flips):
            more, owner = [], []
            for bit in bits:
                more.append(values[-1] ^ np.uint64(1 << bit))
                owner.append(who[-1])
            values.append(np.concatenate(more))
            who.append(np.concatenate(owner))
        flipped = np.repeat(np.arange(len(values)), [len(v) for v in values])
        v, w = np.concatenate(values), np.concatenate(who)
        by = np.lexsort((w, flipped, v))
        v, w = v[by], w[by]
        same = np.flatnonzero(v[1:] == v[:-1])
        first = np.maximum.accumulate(np.where(np.r_[True, v[1:] != v[:-1]], np.arange(len(v)), 0))
        x, y = w[first[same + 1]], w[same + 1]
        good = (np.bitwise_count(fps[x] ^ fps[y]) <= most) & (x != y)
        links_a.append(x[good])
        links_b.append(y[good])

    if len(fps) <= 1 << 14 or most > 2:
        meet(order, free, (most + 1) // 2)
    else:
        # Three parts of the open bits, of which at most two differ.
        for part in np.array_split(np.array(free), 3):
            mask = np.uint64(sum(1 << int(b) for b in part))
            key = fps & mask
            by = np.argsort(key, kind="stable")
            for index in np.split(by, np.flatnonzero(np.diff(key[by])) + 1):
                if len(index) > 1:
                    meet(index, [b for b in free if not int(mask) >> b & 1], 1)
    return np.concatenate(links_a), np.concatenate(links_b)


def _link_groups(ring: Ring, keys: list[tuple[int, int]]):
    """Over rows (table, key, fp) sorted so: a star (a, b) for each set of linked members."""

    def finish(tables, key, fps):
        edges_a, edges_b = [], []
        change = np.r_[True, (key[1:] != key[:-1]) | (tables[1:] != tables[:-1])]
        group = np.cumsum(change) - 1
        sizes = np.bincount(group)
        own = sizes[group]
        for t in np.unique(tables):
            start, _ = keys[t]
            small = np.flatnonzero((tables == t) & (own > 1) & (own <= WIDE))
            if len(small):
                f = fps[small]
                root = _stars(len(f), *_pairs(f, group[small], ring.budgets(start)))
                linked = np.flatnonzero(root != np.arange(len(f)))
                edges_a.append(f[linked])
                edges_b.append(f[root[linked]])
        for g in np.flatnonzero(sizes > WIDE):
            where = np.flatnonzero(group == g)
            f, t = fps[where], int(tables[where[0]])
            mask = keys[t][1]
            free = [b for b in range(64) if not mask >> b & 1]
            root = _stars(len(f), *_large(f, free, ring.most))
            linked = np.flatnonzero(root != np.arange(len(f)))
            edges_a.append(f[linked])
            edges_b.append(f[root[linked]])
        a = np.concatenate(edges_a) if edges_a else np.empty(0, np.uint64)
        b = np.concatenate(edges_b) if edges_b else np.empty(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            rows[2] = rows[2].view(np.uint64)
            if held is not None:
                rows = [np.concatenate(p) for p in zip(held, rows)]
            if not len(rows[0]):
                continue
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            held = [r[cut:] for r in rows]
            if cut:
                yield finish(*[r[:cut] for r in rows])
        if held is not None and len(held[0]):
            yield finish(*held)

    return run


def links(prints: DataFrame, most: int = 2) -> DataFrame:
    """(a, b): links that join just those distinct fingerprints that paths of at most `most`
    differing bits join."""
    ring = Ring(most)
    keys = ring.keys()
    tables = F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key")) for t, (_, mask) in enumerate(keys)
    ])).alias("at")
    met = prints.select("fp").distinct().select("fp", tables).select("at.t", "at.key", "fp")
    return (
        met.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
        .mapInArrow(_link_groups(ring, keys), "a long, b long").distinct()
    )


def near_duplicates(docs: DataFrame, size: int = 5, most: int = 2, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest id its links reach."""
    prints = materialize(fingerprints(docs, size, ident, text), "prints")
    least = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints-least")
    roots = components(links(least, most))
    named = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(names, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


# ---- similarity ----------------------------------------------------------------------
#
# A share of common shingles of 0.8 moves ten of 64 bits on average, beyond any distance
# that a ring can find in large data. So sets of shingles are joined by a prefix filter. Let
# all shingles have one order. Two sets x and y with a share of t or more have a shingle in
# common among the first |x| - ceil(t |x|) + 1 of x and as many of y; the sizes differ by t
# at most, and behind the first common one there is room for all the others they must have.
# Any order will do, so it costs only work that frequencies are taken from a sample: shingles
# that are frequent there come last, and a passage found in many documents brings nothing
# together. No pair is left out for want of room. First every text is compared with one
# other of its shingles' holders, which joins most copies; then all pairs that meet and are
# not joined yet. Each comparison is of whole sets.

#: Shingles of the sample that gives their order.
SAMPLE = 4_000_000
#: Ids that may be broadcast: 16 bytes each. Beyond it the join is a shuffle.
BROADCAST_IDS = 1 << 20
#: Parts in which the rows of a group meet its first one.
ROOT_PARTS = 8
#: Pairs in an Arrow batch that leaves a task.
PAIRS = 1 << 16


def shingle_set(text: bytes, size: int) -> np.ndarray:
    parts = [np.unique(h) for h in shingle_hashes(text, size)]
    return np.unique(mix(np.concatenate(parts))) if parts else np.empty(0, np.uint64)


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _ident(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def profile(text: bytes, size: int) -> tuple[bytes, bytes]:
    """Digest of the set of shingles, and the hashes of all of them."""
    hashes = shingle_set(text, size)
    return _digest(hashes), hashes.tobytes()


def _numbers(hashes: bytes) -> np.ndarray:
    return np.frombuffer(hashes, np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common shingles of two sets."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(both) - common)


def _keyed(docs: DataFrame, ident: str, text: str) -> DataFrame:
    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.xxhash64(F.col(ident), F.col(text)).alias("k1"), F.col(text).alias("text"))


def tally(hashes: np.ndarray) -> bytes:
    """How many shingles of a set fall in each of equal ranges of the hash, about four in one:
    a byte each, and none at all if some count does not fit."""
    width = min(16, max(5, (len(hashes) // 4).bit_length()))
    counts = np.bincount((hashes >> np.uint64(64 - width)).astype(np.int64), minlength=1 << width)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def may_reach(least: float, a: bytes, b: bytes, n: int, m: int) -> bool:
    """Whether two sets of n and m shingles with these tallies can be as similar: they share in
    each range no more than the lesser count. Never false where they are."""
    if not a or not b:
        return True
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) != len(y):  # the finer one is added up to the coarser
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x.reshape(len(y), -1).sum(axis=1, dtype=np.int64)
    common = int(np.minimum(x, y).sum(dtype=np.int64))
    return common >= least * (n + m - common) - 1e-9


def profiles(docs: DataFrame, size: int, ident: str, text: str) -> DataFrame:
    """(doc_id, k1, node, id, n, tally) of every row: the digest of its shingles, the first half
    of it, how many they are, and their tally."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, size) for t in texts_of(batch.column(2))]
            nodes = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2], pa.array(nodes, pa.binary()), pa.array([_ident(d) for d in nodes], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()), pa.array([tally(s) for s in sets], pa.binary()),
                ],
                ["doc_id", "k1", "node", "id", "n", "tally"],
            )

    return _keyed(docs, ident, text).mapInArrow(run, "doc_id long, k1 long, node binary, id long, n int, tally binary")


def frequencies(texts: DataFrame, size: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in two texts of a sample or more, sorted, and in how many."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, size) for t in texts_of(batch.column(0))]
            h = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            for s in range(0, len(h), STRIP):
                yield pa.RecordBatch.from_arrays([pa.array(h[s : s + STRIP])], ["h"])

    found = (texts.sample(share, seed=11) if share < 1 else texts).mapInArrow(run, "h long")
    many = found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h", F.least("n", F.lit(1 << 30)).cast("int").alias("n")).toArrow()
    h = many.column(0).to_numpy().view(np.uint64)
    by = np.argsort(h)
    return h[by], many.column(1).to_numpy()[by]


#: Shingles that bring together more pairs of different roots than so many for each of their
#: rows. Their texts are first compared with one more partner each, so many times at most and
#: as long as that joins any; what is left of them meets with tallies at hand.
DENSE, TURNS = 16, 3
#: Texts of different roots that one shingle may bring together, and how often those that
#: bring more are moved to the end of the order. What is left then is shared by texts that
#: consist of such shingles for the most part, which makes them similar to one another.
HOT, ORDERS = 256, 3


def _moved_back(known: tuple[np.ndarray, np.ndarray], hot: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The frequencies with these shingles behind all others, by the number of their roots.
    Each of them stands for HOT rows that met, so they are few beside the rows."""
    h = hot.column("h").to_numpy().view(np.uint64)
    n = (1 << 29) + np.minimum(hot.column("roots").to_numpy(), 1 << 29)
    others = ~np.isin(known[0], h)
    h, n = np.concatenate([known[0][others], h]), np.concatenate([known[1][others], n.astype(np.int32)])
    by = np.argsort(h)
    return h[by], n[by]


def prefix(hashes: np.ndarray, least: float, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of a set among which every set as similar has one, rarest first."""
    n = len(hashes)
    if not n:
        return hashes
    often = np.zeros(n, np.int32)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        often = np.where(known[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, often))[: n - int(np.ceil(least * n - 1e-9)) + 1]]


def _prefixes(sent, size: int, least: float):
    def run(batches):
        known, counts = sent.value
        for batch in batches:
            rows = []
            for t in texts_of(batch.column(0)):
                hashes = shingle_set(t, size)
                first = prefix(hashes, least, known, counts)
                if len(first):
                    rows.append((first, np.full(len(first), _ident(_digest(hashes))), np.full(len(first), len(hashes), np.int32), np.arange(len(first), dtype=np.int32)))
            if rows:
                h, ident, n, pos = (np.concatenate(c) for c in zip(*rows))
                for s in range(0, len(h), STRIP):
                    e = slice(s, s + STRIP)
                    yield pa.RecordBatch.from_arrays([pa.array(h[e].view(np.int64)), pa.array(ident[e]), pa.array(n[e]), pa.array(pos[e])], ["h", "id", "n", "pos"])

    return run


def _may(least: float, n, pos, i, j) -> np.ndarray:
    """Whether two holders of a shingle can be similar if it is the first they share."""
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    room = np.minimum(n[i] - pos[i], n[j] - pos[j])
    return (small >= least * large - 1e-9) & (room >= least / (1 + least) * (small.astype(np.int64) + large) - 1e-9)


def _grouped(finish, unique: bool):
    """Runs finish on whole groups of rows that are sorted by their first column."""

    def run(batches):
        held = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(p) for p in zip(held, rows)]
            if not len(rows[0]):
                continue
            if unique:  # rows (h, id, ...) of texts with the same shingles
                new = np.r_[True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])]
                rows = [r[new] for r in rows]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            held = [r[cut:] for r in rows]
            if cut:
                yield from finish(*[r[:cut] for r in rows])
        if held is not None:
            yield from finish(*held)

    return run


def _near(group: np.ndarray, rows: np.ndarray):
    """Index pairs of the rows that share a small group, by their distance."""
    g = group[rows]
    for d in range(1, WIDE):
        i = np.flatnonzero(g[d:] == g[:-d]) if d < len(g) else ()
        if not len(i):
            return
        yield rows[i], rows[i + d]


def _holders(least: float):
    """Over rows (h, id, n, pos) sorted so: those that may be similar to another of their
    shingle, with one of its holders as their centre."""

    def finish(h, ident, n, pos):
        group = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1
        sizes = np.bincount(group)
        keep = sizes[group] > WIDE
        for i, j in _near(group, np.flatnonzero((sizes[group] > 1) & ~keep)):
            good = _may(least, n, pos, i, j)
            keep[i[good]] = True
            keep[j[good]] = True
        firsts = np.r_[0, np.cumsum(sizes)[:-1]]
        centre = ident[firsts[group]]
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (h, ident, n, pos, centre)], ["h", "id", "n", "pos", "centre"])

    return _grouped(finish, True)


def _partners(least: float, turn: int):
    """Over rows (h, root, id, n, pos) sorted by h: each text with the next one of its shingle
    that is of another root, in an order of texts that is another one every turn."""

    def finish(h, root, ident, n, pos):
        place = mix(ident.view(np.uint64) ^ np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        by = np.lexsort((place, h))
        start = np.flatnonzero(np.r_[True, h[by][1:] != h[by][:-1]])
        stop = np.r_[start[1:], len(by)]
        following = np.arange(1, len(by) + 1)
        following[stop - 1] = start  # the last one of a shingle meets its first
        i, j = by, by[following]
        good = (root[i] != root[j]) & _may(least, n, pos, i, j)
        a, b = ident[i[good]], ident[j[good]]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return _grouped(finish, False)


def _meetings(least: float):
    """Over rows (h, root, id, n, pos) sorted so: all pairs of a shingle that may be similar
    and are not of one root."""

    def batch(a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def finish(h, root, ident, n, pos):
        group = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1
        sizes = np.bincount(group)
        own = sizes[group]
        for i, j in _near(group, np.flatnonzero((own > 1) & (own <= WIDE))):
            good = (root[i] != root[j]) & _may(least, n, pos, i, j)
            yield batch(ident[i[good]], ident[j[good]])
        stops = np.cumsum(sizes)
        for g in np.flatnonzero(sizes > WIDE):
            start, stop = stops[g] - sizes[g], stops[g]
            ends = start + np.searchsorted(root[start:stop], root[start:stop], side="right")
            left, right, held = [], [], 0
            for i in range(start, stop):
                j = np.arange(ends[i - start], stop)
                j = j[_may(least, n, pos, i, j)]
                left.append(np.full(len(j), ident[i]))
                right.append(ident[j])
                held += len(j)
                if held >= PAIRS or i == stop - 1:
                    yield batch(np.concatenate(left), np.concatenate(right))
                    left, right, held = [], [], 0

    return _grouped(finish, False)


class _Tallies:
    """The tallies of a group's members, added up to each length that is asked for."""

    def __init__(self, tallies: np.ndarray):
        self.length = np.array([len(t) for t in tallies])
        self.rows, self.at = {}, np.zeros(len(tallies), np.int64)
        for length in np.unique(self.length):
            own = np.flatnonzero(self.length == length)
            self.at[own] = np.arange(len(own))
            self.rows[length, length] = np.frombuffer(b"".join(tallies[own]), np.uint8).reshape(len(own), length).astype(np.int16)

    def of(self, members: np.ndarray, own: int, length: int) -> np.ndarray:
        """Those of members, all `own` long, added up to a length."""
        if (own, length) not in self.rows:
            self.rows[own, length] = self.rows[own, own].reshape(-1, length, own // length).sum(axis=2, dtype=np.int16)
        return self.rows[own, length][self.at[members]]

    def may_reach(self, least: float, i: int, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of the members j those whose tallies allow the similarity to member i."""
        good = np.ones(len(j), bool)
        for own in np.unique(self.length[j]):
            length = min(own, self.length[i])
            if length:
                some = np.flatnonzero(self.length[j] == own)
                mine = self.of(np.array([i]), self.length[i], length)
                common = np.minimum(mine, self.of(j[some], own, length)).sum(axis=1, dtype=np.int64)
                good[some] = common >= least * (int(n[i]) + n[j[some]] - common) - 1e-9
        return good


def _dense_meetings(least: float):
    """As _meetings, over rows (h, root, id, n, pos, tally) of shingles that bring together many
    texts of different roots: pairs that their tallies rule out are not made."""

    def finish(h, root, ident, n, pos, tally):
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        for start, stop in zip(starts, np.r_[starts[1:], len(h)]):
            part = slice(start, stop)
            r, ids, size, place, tallies = root[part], ident[part], n[part], pos[part], _Tallies(tally[part])
            ends = np.searchsorted(r, r, side="right")
            left, right, held = [], [], 0
            for i in range(len(ids)):
                j = np.arange(ends[i], len(ids))
                j = j[_may(least, size, place, i, j)]
                j = j[tallies.may_reach(least, i, j, size)] if len(j) else j
                left.append(np.full(len(j), ids[i]))
                right.append(ids[j])
                held += len(j)
                if held >= PAIRS or i == len(ids) - 1:
                    a, b = np.concatenate(left), np.concatenate(right)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
                    left, right, held = [], [], 0

    return _grouped(finish, False)


def _slices(batches, rows: int = 512):
    """Batches in parts: sets are many times larger than other rows."""
    for batch in batches:
        for s in range(0, batch.num_rows, rows):
            yield batch.slice(s, rows)


def _sets(keyed: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for part in _slices(batches):
            found = [profile(t, size) for t in texts_of(part.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_ident(f[0]) for f in found], pa.int64()), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], ["id", "node", "hashes"]
            )

    return keyed.select("text").mapInArrow(run, "id long, node binary, hashes binary")


def _possible(pairs: DataFrame, tallies: DataFrame, least: float) -> DataFrame:
    """(a, b): the pairs of ids whose tallies allow the similarity. Most that only share a
    passage go here, before any set is made."""

    def run(batches):
        for batch in batches:
            rows = zip(texts_of(batch.column(2)), texts_of(batch.column(3)), batch.column(4).to_pylist(), batch.column(5).to_pylist())
            yield batch.select(["a", "b"]).filter(pa.array([may_reach(least, *row) for row in rows], pa.bool_()))

    both = (
        pairs.join(tallies.withColumnsRenamed({"id": "a", "tally": "s", "n": "m"}), "a")
        .join(tallies.withColumnsRenamed({"id": "b", "tally": "t", "n": "k"}), "b").select("a", "b", "s", "t", "m", "k")
    )
    return both.mapInArrow(run, "a long, b long")


#: Partners of a set that meet it in one group.
PARTNERS = 256


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, x, y): the pairs of ids whose whole sets are as similar, with their digests.

    The set of b travels once for every group of its partners, and is held while theirs pass."""

    def run(batches):
        key, held, digest = None, None, None
        for batch in _slices(batches):
            out = ([], [], [], [])
            for b, part, a, node, hashes in zip(*[batch.column(c).to_pylist() for c in ("b", "part", "a", "node", "hashes")]):
                if a is None:
                    key, held, digest = (b, part), _numbers(hashes), node
                elif key == (b, part) and similarity(_numbers(hashes), held) >= least:
                    for column, value in zip(out, (a, b, node, digest)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["a", "b", "x", "y"])

    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    dealt = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"))
    theirs = dealt.join(sets.withColumnRenamed("id", "a"), "a").select("b", "part", "a", "node", "hashes")
    own = many.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    own = own.join(sets.withColumnRenamed("id", "b"), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "node", "hashes")
    together = own.unionByName(theirs).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return together.mapInArrow(run, "a long, b long, x binary, y binary")


def _crowds(rooted: DataFrame) -> DataFrame:
    """(h, n, pairs): for each shingle its rows, and its pairs of rows of different roots."""
    n = F.col("n")
    by_root = rooted.groupBy("h", "root").agg(F.count("*").alias("n"))
    by_h = by_root.groupBy("h").agg(F.sum(n).alias("n"), F.sum(n * n).alias("same"))
    return by_h.select("h", "n", ((n * n - F.col("same")) / 2).alias("pairs"))


def similar_groups(docs: DataFrame, size: int = 5, least: float = 0.8, ident: str = "doc_id", text: str = "text", sample: int = SAMPLE, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(doc_id, k1, root) of every row; rows are of one root if links of a similarity of at
    least `least` join them, and only then. k1 hashes id and text. Texts with equal sets of
    shingles are always of one root."""
    if not 0 < least <= 1:
        raise ValueError("the similarity must be above 0 and at most 1")
    found = materialize(profiles(docs, size, ident, text), "profiles")
    keyed = _keyed(docs, ident, text)
    total = found.agg(F.sum("n")).first()[0] or 0
    known = frequencies(keyed.select("text"), size, min(1.0, sample / max(1, total)))

    def meet() -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(known)
        firsts = keyed.select("text").mapInArrow(_prefixes(sent, size, least), "h long, id long, n int, pos int")
        met = firsts.repartition("h").sortWithinPartitions("h", "id").mapInArrow(_holders(least), "h long, id long, n int, pos int, centre long")
        return materialize(met, "met")

    def compared(pairs: DataFrame, ruled: DataFrame | None = None) -> DataFrame:
        # Sets are made of the texts that still have a partner, and of one text for each set.
        # The pairs of `ruled` have been held against their tallies already.
        with Scratch(docs.sparkSession) as scratch:
            pairs = materialize(pairs, "pairs")
            ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
            tallies = found.join(ids, "id").groupBy("id").agg(F.first("n").alias("n"), F.first("tally").alias("tally"))
            possible = _possible(pairs, materialize(tallies, "tallies"), least)
            possible = materialize(possible if ruled is None else possible.unionByName(ruled).distinct(), "possible")
            ids = possible.select(F.col("a").alias("id")).unionByName(possible.select(F.col("b").alias("id"))).distinct()
            wanted = materialize(found.join(ids, "id").groupBy("node").agg(F.min("k1").alias("k1")).select("k1").distinct(), "wanted")
            wanted = F.broadcast(wanted) if wanted.count() <= broadcast_ids else wanted
            sets = _sets(keyed.join(wanted, "k1", "left_semi"), size).dropDuplicates(["node"])
            return scratch.keep(materialize(_similar(possible, materialize(sets, "sets"), least), "similar"))

    # One comparison for each text, with the centre that it meets most often.
    met = meet()
    one = met.filter("id <> centre").groupBy("id", "centre").agg(F.count("*").alias("n")).groupBy("id").agg(F.max_by("centre", F.struct("n", "centre")).alias("b"))
    some = compared(one.select(F.col("id").alias("a"), "b"))
    roots = components(some.select("a", "b")).withColumnRenamed("node", "id")

    def by_root() -> DataFrame:
        return met.drop("centre").join(roots, "id", "left").select("h", F.coalesce("root", "id").alias("root"), "id", "n", "pos")

    # Near copies of each other that are no near copies of their centre: one partner more at a
    # time joins most of them, so that few pairs are left to be compared.
    def crowded() -> DataFrame:
        dense = materialize(_crowds(rooted).filter(F.col("pairs") > DENSE * F.col("n")).select("h"), "dense")
        return materialize(rooted.join(dense, "h", "left_semi"), "crowded")

    rooted = materialize(by_root(), "rooted")
    for turn in range(1, TURNS + 1):
        some_rows = crowded()
        if some_rows.isEmpty():
            break
        partners = some_rows.repartition("h").sortWithinPartitions("h").mapInArrow(_partners(least, turn), "a long, b long")
        nearest = partners.groupBy("a", "b").agg(F.count("*").alias("n")).groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
        more = compared(nearest)
        if more.isEmpty():
            break
        some = some.unionByName(more)
        roots = components(some.select("a", "b")).withColumnRenamed("node", "id")
        rooted = materialize(by_root(), "rooted")

    # A shingle that the sample did not show to be frequent may be held by many texts that are
    # not similar. Such shingles go to the end of the order, and all texts meet anew.
    before = None
    for _ in range(ORDERS):
        hot = rooted.groupBy("h").agg(F.count_distinct("root").alias("roots")).filter(F.col("roots") > HOT).toArrow()
        if not hot.num_rows or before is not None and hot.num_rows > before / 2:
            break
        known, before = _moved_back(known, hot), hot.num_rows
        met = meet()
        rooted = materialize(by_root(), "rooted")

    dense = crowded()
    plain = rooted.join(dense.select("h").distinct(), "h", "left_anti").repartition("h").sortWithinPartitions("h", "root", "id")
    pairs, ruled = plain.mapInArrow(_meetings(least), "a long, b long").distinct(), None
    if not dense.isEmpty():
        tallies = found.join(dense.select("id").distinct(), "id").groupBy("id").agg(F.first("tally").alias("tally"))
        dense = dense.join(tallies, "id").select("h", "root", "id", "n", "pos", "tally")
        dense = dense.repartition("h").sortWithinPartitions("h", "root", "id")
        ruled = dense.mapInArrow(_dense_meetings(least), "a long, b long")
    rest = compared(pairs, ruled)
    same = components(some.unionByName(rest).select(F.col("x").alias("a"), F.col("y").alias("b")))
    return found.select("doc_id", "k1", "node").join(same, "node", "left").select("doc_id", "k1", F.coalesce("root", "node").alias("root"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, least: float = 0.8, ident: str = "doc_id", text: str = "text", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The rows of docs, of each group of near-duplicates only one: that of the smallest id,
    a missing id being larger than any."""
    with Scratch(docs.sparkSession) as scratch:
        groups = scratch.keep(materialize(similar_groups(docs, size, least, ident, text, broadcast_ids=broadcast_ids), "groups"))
    return _one_of_each(docs, groups, ident, text, broadcast_ids)


def drop_linked(docs: DataFrame, size: int = 5, most: int = 3, ident: str = "doc_id", text: str = "text", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The same for groups that fingerprints link, at up to `most` differing bits."""
    with Scratch(docs.sparkSession) as scratch:
        groups = scratch.keep(materialize(linked_groups(docs, size, most, ident, text), "groups"))
    return _one_of_each(docs, groups, ident, text, broadcast_ids)


def linked_groups(docs: DataFrame, size: int = 5, most: int = 3, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, k1, root) of every row; rows are of one root if links of their fingerprints
    join them, and only then. k1 hashes id and text."""
    k1 = F.xxhash64(F.col(ident), F.col(text)).alias("k1")
    prints = materialize(fingerprints(docs.select(F.col(ident), F.col(text), k1), size, ident, text, ["k1"]), "prints")
    roots = components(links(prints, most)).withColumnRenamed("node", "fp")
    # A fingerprint may be that of most rows: its root meets them in parts.
    roots = roots.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(ROOT_PARTS - 1))))
    parts = prints.withColumn("part", F.pmod(F.xxhash64("doc_id", "k1"), F.lit(ROOT_PARTS)).cast("int"))
    return parts.join(roots, ["fp", "part"], "left").select("doc_id", "k1", F.coalesce("root", "fp").alias("root"))


def _one_of_each(docs: DataFrame, groups: DataFrame, ident: str, text: str, broadcast_ids: int) -> DataFrame:
    """The first row of each group (doc_id, k1, root)."""
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1")).alias("first"), F.count("*").alias("n"))
    # A group of copies may hold most rows: its first one meets them in parts.
    firsts = first.filter("n > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(ROOT_PARTS - 1))))
    shared = groups.withColumn("part", F.pmod(F.xxhash64("doc_id", "k1"), F.lit(ROOT_PARTS)).cast("int")).join(firsts, ["root", "part"])
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("k1") == F.col("first.k1"))
    # Rows that go, and rows that stay but occur more than once.
    listed = shared.groupBy(F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("no_id"), "k1").agg(
        F.count("*").alias("times"), F.max(own).alias("stays")
    ).filter("not stays or times > 1")
    listed = materialize(listed, "listed")
    marks = F.broadcast(listed) if listed.count() <= broadcast_ids else listed
    names = docs.columns
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(ident).cast("long"), F.lit(0)).alias("d"),
        F.col(ident).isNull().alias("no_id"), F.xxhash64(F.col(ident), F.col(text)).alias("k1"),
    )
    marked = keyed.join(marks, ["d", "no_id", "k1"], "left")
    once = marked.filter("stays is null").select("row.*")
    again = marked.filter("stays").groupBy("d", "no_id", "k1").agg(F.first("row").alias("row")).select("row.*")
    return once.unionByName(again)

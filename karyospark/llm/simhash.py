"""SimHash near-duplicates through deletion-variant signatures.

A signature is cut into so few segments that two linked signatures must agree in one segment up to
at most one bit. Every segment is indexed once per bit with that bit wiped out (its one-wildcard
variants), equal variants meet in one bucket, and each bucket verifies the true distance. A task returns
only edges that span what its buckets link, so that a group of copies costs its size and not its
square. Buckets of very many members are dealt as pairs of blocks. Components come from alternating
star contractions that never leave the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, bound_batches, checkpoint, repeated, row_key, table, texts

SEED = 42
#: Shingles hashed at a time, so that a very long text needs bounded memory.
BLOCK = 1 << 15
#: Buckets of up to this size are compared offset by offset, larger ones by forest search.
SMALL = 24
#: Buckets above this size are searched by exact blocks of the bits in which their members differ.
LARGE = 4096
#: Rows of a bucket from which on it is dealt as pairs of blocks; keys of such buckets that are broadcast.
CHUNK = 1 << 16
BROADCAST_KEYS = 100_000
#: Linked nodes that a task groups before it hands on their edges.
GROUPED = 1 << 20


@dataclass(frozen=True)
class Plan:
    """How signatures are made, indexed and linked.

    verify: (words per shingle, number of 64-bit words) of the signature whose distance decides.
    index: the same for the signature that is cut into segments; None: the verified one.
    segments: (64-bit word, lowest bit, width) of each segment.
    distinct: whether the index signature counts each shingle once.
    """

    verify: tuple[int, int]
    max_distance: int
    segments: tuple[tuple[int, int, int], ...]
    index: tuple[int, int] | None = None
    distinct: bool = False


#: 64 bits over four words at distance 4: of three segments one differs in one bit at most.
CONTRACT = Plan((4, 1), 4, ((0, 0, 22), (0, 22, 21), (0, 43, 21)))
#: The same of sets of five-word shingles, to find candidates: at distance 5 a pair still shares a variant for sure, up to 10 often.
COPIES = Plan((5, 1), 10, CONTRACT.segments, distinct=True)


@dataclass(frozen=True)
class Jaccard:
    """Links of texts by the Jaccard similarity of their sets of shingles.

    First candidates share a deletion variant (variants); the sets decide. What these links leave apart is searched by bands:
    further candidates agree in all minima of a band; a sketch of one byte a minimum sorts them out, the sets decide.
    """

    width: int
    least: float
    bands: int
    rows: int
    minima: int
    variants: Plan = COPIES


#: At 0.8 and more a pair misses all 16 bands of 4 minima once in 4600, wherever its edits stand.
NEAR = Jaccard(5, 0.8, 16, 4, 128)
#: What a sketch's estimate may lack of the limit: 3.4 standard deviations. In a large bucket, so many candidates at most
#: for a member that no estimate at the limit links.
SLACK = 0.12
BEST = 8
#: Shingles whose minima are taken at a time.
MINIMA_BLOCK = 1 << 12


def shingles(text: str, width: int) -> tuple[bytes, list[int], list[int]]:
    """The text's words, A-Z lower-cased and joined by one space, and where each shingle starts and ends."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if not words:
        return joined, [], []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) <= width:
        return joined, [0], [len(joined)]
    return joined, starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()


BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def ones_of(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 64:
        return np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.concatenate([np.bincount(octets[:, j], minlength=256) @ BITS for j in range(8)])


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as signature() has them for distinct shingles."""
    return int(np.packbits(2 * ones_of(hashes) > len(hashes), bitorder="little").view("<i8")[0])


def signature(text: str, width: int, n_words: int = 1, distinct: bool = False) -> list[int]:
    """Majority bits of the shingles' hashes, in 64-bit words.

    The first word's hashes are XXH64 with seed 42; each further word's are the ones before, mixed once more.
    """
    joined, starts, ends = shingles(text, width)
    parts = list({joined[s:e] for s, e in zip(starts, ends)}) if distinct else None
    n = len(parts) if distinct else len(starts)
    ones, hashed = np.zeros((n_words, 64), np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        if distinct:
            got = [hashed(p, SEED) for p in parts[at : at + BLOCK]]
        else:
            got = [hashed(joined[s:e], SEED) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])]
        hashes = np.array(got, np.uint64)
        for k in range(n_words):
            if k:
                hashes = mixed(hashes)
            ones[k] += ones_of(hashes)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that makes each bit depend on all bits."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def signatures(docs: DataFrame, plan: Plan, *keep: str) -> DataFrame:
    """The kept columns with longs v0.. (verified signature) and i0.. (indexed signature); no text."""
    bound_batches(docs.sparkSession)
    rows = texts(docs, *keep)
    width, n = plan.verify
    more = plan.index or (0, 0)
    names = [f"v{k}" for k in range(n)] + [f"i{k}" for k in range(more[1])]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for text in b.column(b.num_columns - 1):
                t = text.as_py()
                got.append(signature(t, width, n) + (signature(t, more[0], more[1], plan.distinct) if plan.index else []))
            made = np.array(got, np.int64).reshape(len(got), len(names))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(made[:, k]) for k in range(len(names))]], names=[*b.schema.names[:-1], *names])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in rows.dtypes[:-1]], *[f"{c} bigint" for c in names]])
    return rows.mapInArrow(sign, schema)


def segment_value(prefix: str, word: int, low: int, width: int) -> Column:
    return F.shiftrightunsigned(F.col(f"{prefix}{word}"), low).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def variant_key(s: Column, j: Column, value: Column) -> Column:
    """Segment s's value with bit j wiped out, as a long that also holds s and j."""
    wiped = value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("bigint"), j)))
    return wiped + F.call_function("shiftleft", F.call_function("shiftleft", s.cast("bigint"), F.lit(5)) + j, F.lit(32))


def variants(plan: Plan) -> Column:
    """All one-wildcard variants of all segments, each a long that also holds segment and wildcard."""
    prefix = "i" if plan.index else "v"
    keys = []
    for s, (word, low, width) in enumerate(plan.segments):
        part = segment_value(prefix, word, low, width)
        for j in range(width):
            wiped = part.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << j)).cast("bigint"))
            keys.append(wiped + F.lit(((s << 5) | j) << 32).cast("bigint"))
    return F.array(*keys)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def forest(sigs: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among sigs (n, words): search from member to unseen members."""
    rest = np.arange(len(sigs))
    left, right = [], []
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = distance(sigs[rest], sigs[at]) <= limit
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), at))
                right.append(found)
                queue.extend(found.tolist())
                rest = rest[~near]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def bucket_links(sigs: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what is linked in one bucket.

    A large bucket is first cut by blocks of the bits in which its members differ at all: with one block more than
    bits that may differ, linked members share a block.
    """
    if len(sigs) <= LARGE:
        return forest(sigs, plan.max_distance)
    varying = np.bitwise_or.reduce(sigs) & ~np.bitwise_and.reduce(sigs)
    bits = [(w, b) for w in range(sigs.shape[1]) for b in range(64) if int(varying[w]) >> b & 1]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for block in np.array_split(np.array(bits, np.int64).reshape(-1, 2), plan.max_distance + 1):
        mask = np.zeros(sigs.shape[1], np.uint64)
        for w, b in block.tolist():
            mask[w] |= np.uint64(1 << b)
        held = sigs & mask
        order = np.lexsort(held.T)
        cuts = np.flatnonzero((held[order][1:] != held[order][:-1]).any(1)) + 1
        for part in np.split(order, cuts):
            if len(part) > 1:
                a, b = forest(sigs[part], plan.max_distance)
                left.append(part[a])
                right.append(part[b])
    return np.concatenate(left), np.concatenate(right)


class Groups:
    """Connected numbers by union-find; the smallest of a group is its centre."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    def join(self, left: list[int], right: list[int]) -> None:
        for a, b in zip(left, right):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def edges(self) -> pa.RecordBatch:
        """One edge (a, b) from each member but the centre to the centre, and forgets them."""
        found = [(x, r) for x in list(self.up) if (r := self.root(x)) != x]
        self.up = {}
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def by_pairs_of_blocks(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (key, nid, ..) with new keys where a key has more than CHUNK rows by counts (key, n).

    Such a key's rows fall into blocks by the hash of their nid, and every pair of blocks is a bucket: two rows of a key
    still meet, and no bucket has many more than CHUNK rows, however many the key has. Copies of a row are as many as
    blocks. Few such keys are broadcast, more are joined.
    """
    hot = checkpoint(counts.where(F.col("n") > CHUNK).select(F.col("key").alias("hot"), F.ceil(F.col("n") * 2 / CHUNK).cast("int").alias("blocks")))
    n = hot.count()
    if not n:
        return rows
    joined = rows.join(F.broadcast(hot) if n <= BROADCAST_KEYS else hot, rows["key"] == F.col("hot"), "left")
    own = F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    return joined.withColumn("key", F.explode(F.when(F.col("hot").isNull(), F.array("key")).otherwise(pairs))).select(*rows.columns)


def bucket_counts(nodes: DataFrame, plan: Plan) -> DataFrame:
    """(key, n) of the variants' buckets that may be above CHUNK.

    Values of whole segments are counted, three a node and not one for each variant; a bucket holds the nodes of two
    values, those with its wildcard bit set and not set. Values at most as many as segments can have are left.
    """
    prefix = "i" if plan.index else "v"
    values = [F.struct(F.lit(s).alias("s"), segment_value(prefix, *seg).alias("value")) for s, seg in enumerate(plan.segments)]
    counted = nodes.select(F.explode(F.array(*values)).alias("x")).groupBy("x.s", "x.value").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK // 2)
    widths = F.array(*[F.lit(w) for _, _, w in plan.segments])
    wild = F.transform(F.sequence(F.lit(0), F.get(widths, F.col("s")) - 1), lambda j: variant_key(F.col("s"), j, F.col("value")))
    return counted.select(F.explode(wild).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("k")).select("key", F.when(F.col("k") > 1, F.col("n")).otherwise(F.col("n") + CHUNK // 2).alias("n"))


def links(nodes: DataFrame, plan: Plan) -> DataFrame:
    """Edges (a, b) between nodes (nid and signatures) that span what verified links connect.

    Buckets return no pairs: what a task's buckets link becomes groups first, and each member's edge to the group's
    smallest nid goes on, so that a group of copies costs its size.
    """
    n = plan.verify[1]
    columns = [F.col(f"v{k}") for k in range(n)]
    # exploding costs rows, not bytes: an explicit number of partitions isn't merged into few
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = nodes.repartition(parts, "nid")
    dealt = nodes.select(F.explode(variants(plan)).alias("key"), "nid", *columns)
    dealt = by_pairs_of_blocks(dealt, bucket_counts(nodes, plan)).repartition("key").sortWithinPartitions("key")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        groups = Groups()

        def buckets(keys, nids, sigs):
            starts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1))
            sizes = np.diff(np.concatenate((starts, [len(keys)])))
            small = np.repeat(sizes <= SMALL, sizes)
            left, right = [], []
            for d in range(1, min(SMALL, int(sizes.max()))):
                at = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
                if not len(at):
                    break
                at = at[distance(sigs[at], sigs[at + d]) <= plan.max_distance]
                left.append(nids[at])
                right.append(nids[at + d])
            for s, m in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
                a, b = bucket_links(sigs[s : s + m], plan)
                left.append(nids[s + a])
                right.append(nids[s + b])
            if left and sum(map(len, left)):
                pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
                groups.join(pairs[:, 0].tolist(), pairs[:, 1].tolist())

        for batch in batches:
            got = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2 + n)]
            if not len(got[0]):
                continue
            kept.append((got[0], got[1], np.stack(got[2:], 1).view(np.uint64)))
            if kept[0][0][0] == got[0][-1] or sum(len(k[0]) for k in kept) < (1 << 17):
                continue
            keys, nids, sigs = (np.concatenate(x) for x in zip(*kept))
            cut = int(np.searchsorted(keys, keys[-1]))
            buckets(keys[:cut], nids[:cut], sigs[:cut])
            kept = [(keys[cut:], nids[cut:], sigs[cut:])]
            if len(groups.up) > GROUPED:
                yield groups.edges()
        if kept:
            buckets(*(np.concatenate(x) for x in zip(*kept)))
        yield groups.edges()

    return dealt.mapInArrow(search, "a bigint, b bigint").distinct()


def beside(rows: DataFrame, least: DataFrame) -> DataFrame:
    """Rows (u, v) with m of their u. Both sides are dealt anew by the complement of u: a side that comes straight from an
    aggregation by u could not be split where one u has very many rows.
    """
    marked = least.select(F.bitwise_not("u").alias("not_u"), "m")
    return rows.join(marked, F.bitwise_not(rows["u"]) == marked["not_u"]).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b); the root is the smallest node of its component.

    Alternating large-star and small-star contractions: each round ties nodes to their smallest known
    neighbour, by joins and partial minima only, until a round changes nothing.
    """
    seal = None

    def contracted(now: DataFrame) -> DataFrame | None:
        nonlocal seal
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seal:
            return None
        seal = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = beside(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = beside(large, low).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        return small.union(low.select("u", F.col("m").alias("v"))).distinct()

    first = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    return repeated(first, contracted).select(F.col("u").alias("node"), F.col("v").alias("root"))


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """The hashes of the text's distinct shingles, ascending."""
    joined, starts, ends = shingles(text, width)
    return np.array(sorted({xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends)}), np.uint64)


def minima(hashes: np.ndarray, n: int) -> np.ndarray:
    """The least of the hashes under each of n permutations; the highest number where there are none."""
    draw = np.arange(1, 2 * n + 1, dtype=np.uint64)
    flip, times = mixed(draw[:n])[:, None], (mixed(draw[n:]) | np.uint64(1))[:, None]
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), MINIMA_BLOCK):
        least = np.minimum(least, ((hashes[None, at : at + MINIMA_BLOCK] ^ flip) * times).min(1))
    return least


def sketches(docs: DataFrame, plan: Jaccard, *keep: str) -> DataFrame:
    """The kept columns with nid (the hash of the set of shingles), v0 (the set's SimHash), sketch, and the key of each band."""
    bound_batches(docs.sparkSession)
    rows = texts(docs, *keep)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nids, bits, marks, keys = [], [], [], []
            for text in b.column(b.num_columns - 1):
                hashes = shingle_hashes(text.as_py(), plan.width)
                least = minima(hashes, plan.minima)
                nids.append(mixed(hashes).sum(dtype=np.uint64))
                bits.append(majority(hashes))
                marks.append(mixed(least).astype(np.uint8).tobytes())
                key = np.arange(plan.bands, dtype=np.uint64)
                for k in range(plan.rows):
                    key = mixed(key ^ least[k * plan.bands : (k + 1) * plan.bands])
                keys.append(key.view(np.int64))
            made = [pa.array(np.array(nids, np.uint64).view(np.int64)), pa.array(bits, pa.int64()), pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*b.schema.names[:-1], "nid", "v0", "sketch", "keys"])

    return rows.mapInArrow(sign, ", ".join([*[f"`{c}` {t}" for c, t in rows.dtypes[:-1]], "nid bigint, v0 bigint, sketch binary, keys array<bigint>"]))


def spanning(marks: np.ndarray, order: np.ndarray, strict: int) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
    """Edges of a spanning forest of sketches that agree in strict minima, searched in this order, and members alone."""
    rest, left, right, alone = order, [], [], []
    while len(rest):
        start, size = int(rest[0]), 1
        queue, rest = [start], rest[1:]
        while queue and len(rest):
            at = queue.pop(0)
            near = (marks[rest] == marks[at]).sum(1) >= strict
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), at))
                right.append(found)
                queue.extend(found.tolist())
                size += len(found)
                rest = rest[~near]
        if size == 1:
            alone.append(start)
    return left, right, alone


def candidates_of(marks: np.ndarray, plan: Jaccard, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of one bucket's sketches (n, minima): in a small bucket all within the slack.

    A large one gives two spanning forests of what the estimates link, one from the members that agree most with what the
    bucket's sketches have in common, which is near the text that others were copied from, one from a member that
    differs from bucket to bucket; and for each member that they leave alone the best within the slack.
    """
    n = len(marks)
    loose, strict = int((plan.least - SLACK) * plan.minima), int(plan.least * plan.minima)
    if n <= SMALL:
        a, b = np.triu_indices(n, 1)
        near = (marks[a] == marks[b]).sum(1) >= loose
        return a[near], b[near]
    common = np.array([np.bincount(marks[:, k], minlength=256).argmax() for k in range(plan.minima)], np.uint8)
    left, right, alone = spanning(marks, np.argsort(-(marks == common).sum(1), kind="stable"), strict)
    more = spanning(marks, np.roll(np.arange(n), -(first % n)), strict)
    left, right = left + more[0], right + more[1]
    for at in alone:
        same = (marks == marks[at]).sum(1)
        same[at] = -1
        best = np.argpartition(-same, BEST)[:BEST]
        best = best[same[best] >= loose]
        left.append(np.full(len(best), at))
        right.append(best)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def shared_bands(nodes: DataFrame) -> DataFrame:
    """(u, v, m): each band key u that several nodes hold, its holder v, and how many hold it."""
    keys = nodes.select(F.explode("keys").alias("u"), F.col("nid").alias("v"))
    counts = checkpoint(keys.groupBy("u").agg(F.count("*").alias("m")).where("m > 1"))
    return checkpoint(beside(keys, counts))


def open_buckets(shared: DataFrame, tree: DataFrame) -> DataFrame:
    """The rows (u, v, m) of shared_bands() with comp, v's component, of keys whose holders lie in several components."""
    shared = shared.select("u", "v", "m")
    named = checkpoint(shared.join(tree, shared["v"] == tree["node"], "left").select("u", "v", "m", F.coalesce("root", "v").alias("comp")))
    split = named.groupBy("u").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(F.bitwise_not("u").alias("open"))  # see beside()
    return checkpoint(named.join(split, F.bitwise_not(named["u"]) == split["open"], "left_semi"))


def candidates(nodes: DataFrame, shared: DataFrame, plan: Jaccard) -> DataFrame:
    """Pairs (a, b) of nodes of different components that share a band and whose sketches are close enough for the sets to be compared.

    Sketches go only with the keys that nodes of several components hold (open_buckets()).
    """
    held = shared.groupBy(F.col("v").alias("holder")).agg(F.min("comp").alias("comp"), F.collect_list("u").alias("held"))  # as many as bands
    rows = nodes.join(held, nodes["nid"] == held["holder"]).select(F.explode("held").alias("key"), "nid", "sketch", "comp")
    counts = shared.where(F.col("m") > CHUNK).select(F.col("u").alias("key"), F.col("m").alias("n")).distinct()
    dealt = by_pairs_of_blocks(rows, counts).repartition("key").sortWithinPartitions("key")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(keys, nids, marks, comps):
            left, right = [], []
            starts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
            for i in np.flatnonzero(np.diff(starts) > 1):
                s, e = starts[i], starts[i + 1]
                held = np.frombuffer(b"".join(marks[s:e]), np.uint8).reshape(e - s, plan.minima)
                a, b = candidates_of(held, plan, int(keys[s]))
                new = comps[s + a] != comps[s + b]
                left.append(nids[s + a[new]])
                right.append(nids[s + b[new]])
            if left and sum(map(len, left)):
                a, b = np.concatenate(left), np.concatenate(right)
                both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        kept: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(3).to_numpy()))
            if sum(len(k[0]) for k in kept) < (1 << 15) or kept[0][0][0] == kept[-1][0][-1]:
                continue
            keys, nids, comps = (np.concatenate([k[i] for k in kept]) for i in (0, 1, 3))
            marks = [m for k in kept for m in k[2]]
            cut = int(np.searchsorted(keys, keys[-1]))
            yield from pairs(keys[:cut], nids[:cut], marks[:cut], comps[:cut])
            kept = [(keys[cut:], nids[cut:], marks[cut:], comps[cut:])]
        if kept:
            keys, nids, comps = (np.concatenate([k[i] for k in kept]) for i in (0, 1, 3))
            yield from pairs(keys, nids, [m for k in kept for m in k[2]], comps)

    return dealt.mapInArrow(search, "a bigint, b bigint").distinct()


def sets_of(wanted: DataFrame, signed: DataFrame, docs: DataFrame, plan: Jaccard) -> DataFrame:
    """(nid, hashes) of the wanted nodes (node): the sorted hashes of their distinct shingles, made from their texts only.

    A node's copies come down to one row before anything is joined; few nodes' keys are broadcast, more are joined.
    """
    first = signed.groupBy("nid").agg(F.min(F.struct("__key_id", "__key_text")).alias("row"))
    rows = first.join(wanted, first["nid"] == wanted["node"], "left_semi")
    rows = checkpoint(rows.select("nid", F.col("row.__key_id").alias("its_id"), F.col("row.__key_text").alias("its_text")))
    if rows.count() <= BROADCAST_KEYS:
        rows = F.broadcast(rows)
    held = docs.join(rows, (docs["__key_id"] == rows["its_id"]) & (docs["__key_text"] == rows["its_text"])).select("nid", F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shingle_hashes(t.as_py(), plan.width).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["nid", "hashes"])

    return checkpoint(held.mapInArrow(collect, "nid bigint, hashes binary").dropDuplicates(["nid"]))


def similar(pairs: DataFrame, sets: DataFrame, plan: Jaccard) -> DataFrame:
    """The pairs whose sets of shingles have the least similarity or more."""
    one, two = [sets.select(F.bitwise_not("nid").alias(f"not_{c}"), F.col("hashes").alias(f"of_{c}")) for c in "ab"]
    both = pairs.join(one, F.bitwise_not("a") == one["not_a"]).join(two, F.bitwise_not("b") == two["not_b"]).select("a", "b", "of_a", "of_b")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            passed = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                passed.append(shared >= plan.least * (len(x) + len(y) - shared))
            yield b.select([0, 1]).filter(pa.array(passed, pa.bool_()))

    return both.mapInArrow(decide, "a bigint, b bigint")


def unsettled(shared: DataFrame, tree: DataFrame) -> DataFrame:
    """(nid, comp): the members of buckets above SMALL that verified links leave in several components, and theirs."""
    return checkpoint(open_buckets(shared.where(F.col("m") > SMALL), tree).select(F.col("v").alias("nid"), "comp").distinct())


def meetings(members: DataFrame, sets: DataFrame, plan: Jaccard) -> DataFrame:
    """Pairs (a, b) of members (nid, comp) of different components that can reach the least similarity, by an exact prefix filter.

    Shingles are ordered from rare to frequent; those of one component alone come first and never leave their row. Of a
    linked pair the shorter set's first ninth and the longer one's first fifth share a shingle (at 0.8). What the texts
    of one template share is frequent and stands behind, so strangers of a template don't meet.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for nid, comp, held in zip(*[b.column(k).to_pylist() for k in range(3)]):
                hashes = np.frombuffer(held, np.int64)
                rows = [hashes, np.full(len(hashes), nid), np.full(len(hashes), comp), np.full(len(hashes), len(hashes))]
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["key", "nid", "comp", "size"])

    tokens = sets.join(members, "nid").select("nid", "comp", "hashes").mapInArrow(unpack, "key bigint, nid bigint, comp bigint, size bigint")
    common = tokens.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    common = checkpoint(common.select("key", "n"))
    marked = common.select(F.bitwise_not("key").alias("not_key"), "n")  # see beside()
    ranked = tokens.join(marked, F.bitwise_not(tokens["key"]) == marked["not_key"]).groupBy("nid", "comp", "size").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("own"))
    rows = ranked.select("nid", "comp", "size", (F.col("size") - F.size("own")).alias("private"), F.posexplode("own").alias("place", "token"))
    # a little less than the bound, so that rounding never shortens a prefix
    first = lambda share: F.col("size") - F.ceil(F.col("size") * share - 1e-6) + 1
    rank = F.col("private") + F.col("place")
    rows = rows.where(rank < first(plan.least)).select(F.col("token.key").alias("key"), "nid", "comp", "size", (rank < first(2 * plan.least / (1 + plan.least))).alias("early"))
    dealt = by_pairs_of_blocks(rows, common).repartition("key").sortWithinPartitions("key")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(keys, nids, comps, sizes, early):
            starts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
            for i in np.flatnonzero(np.diff(starts) > 1):
                s, e = starts[i], starts[i + 1]
                node, comp, size, soon = nids[s:e], comps[s:e], sizes[s:e], early[s:e]
                values, places, counts = np.unique(comp, return_inverse=True, return_counts=True)
                if len(values) == 1:
                    continue
                for k in np.flatnonzero(places != counts.argmax()):  # members of the largest component meet the others from their side
                    near = (comp != comp[k]) & (np.minimum(size, size[k]) >= plan.least * np.maximum(size, size[k]) - 1e-6)
                    near &= np.where(size < size[k], soon, np.where(size > size[k], soon[k], soon & soon[k]))
                    if near.any():
                        a, b = np.maximum(node[near], node[k]), np.minimum(node[near], node[k])
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        kept: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(k[0]) for k in kept) < (1 << 16) or kept[0][0][0] == kept[-1][0][-1]:
                continue
            whole = [np.concatenate(x) for x in zip(*kept)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))
            yield from pairs(*[x[:cut] for x in whole])
            kept = [[x[cut:] for x in whole]]
        if kept:
            yield from pairs(*[np.concatenate(x) for x in zip(*kept)])

    return dealt.mapInArrow(meet, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, signed: DataFrame, docs: DataFrame, plan: Jaccard) -> DataFrame:
    """Those of the checkpointed pairs that are linked, by the sets of their texts."""
    return similar(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), signed, docs, plan), plan)


def grown(tree: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (node, root) of a tree and further edges (a, b)."""
    edges = checkpoint(edges)
    return tree if edges.isEmpty() else components(tree.select(F.col("node").alias("a"), F.col("root").alias("b")).union(edges))


def copies_tree(signed: DataFrame, docs: DataFrame, plan: Jaccard) -> DataFrame:
    """(node, root) of the nodes of sketches() that deletion variants link: a task's groups give each member's edge to
    the smallest nid, and the sets decide on these edges."""
    return components(verified(checkpoint(links(signed.select("nid", "v0").distinct(), plan.variants)), signed, docs, plan))


def jaccard_tree(docs: DataFrame, plan: Jaccard) -> tuple[DataFrame, DataFrame]:
    """The keys of every row of docs (with row_key()) and its nid, and (node, root) of linked nodes.

    Rows with equal sets of shingles are one node; null and empty texts have the empty set. Deletion variants link first;
    bands search what that leaves apart. Estimates only choose what is compared first: where verified links leave a large
    bucket in several components, its members are searched again exactly.
    """
    signed = checkpoint(sketches(docs, plan, "__key_id", "__key_text"))
    tree = copies_tree(signed, docs, plan)
    nodes = signed.select("nid", "sketch", "keys").dropDuplicates(["nid"])
    shared = open_buckets(shared_bands(nodes), tree)
    tree = grown(tree, verified(checkpoint(candidates(nodes, shared, plan)), signed, docs, plan))
    members = unsettled(shared, tree)
    if members.isEmpty():
        return signed, tree
    sets = sets_of(members.select(F.col("nid").alias("node")), signed, docs, plan)
    return signed, grown(tree, similar(checkpoint(meetings(members, sets, plan)), sets, plan))


def near_tree(docs: DataFrame, plan: Plan, *keep: str) -> tuple[DataFrame, DataFrame]:
    """Every row's kept columns, signatures and nid (its signature's node), and (node, root) of linked nodes.

    Null and empty texts have the zero signature and link like any other; repeated rows and equal
    signatures are one node. Nulls in the kept columns stay.
    """
    n = plan.verify[1] + (plan.index[1] if plan.index else 0)
    signed = signatures(docs, plan, *keep)
    marks = signed.columns[len(keep) :]
    nid = F.col("v0") if n == 1 else F.xxhash64(*marks)
    signed = checkpoint(signed.withColumn("nid", nid))
    nodes = signed.groupBy("nid").agg(*[F.first(c).alias(c) for c in marks])
    return signed, components(links(nodes, plan))


def simhash_components(docs: DataFrame, plan: Plan = CONTRACT) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the smallest doc_id reachable over links.

    A null doc_id takes part; its component's smallest non-null id counts, null if there is none.
    """
    signed, tree = near_tree(docs, plan, "doc_id")
    nodes = signed.groupBy("nid").agg(F.min("doc_id").alias("least"))
    tree = tree.union(tree.select("root", "root").distinct())  # a root is of its own tree
    roots = checkpoint(nodes.join(tree, nodes["nid"] == tree["node"]).select("nid", "least", "root"))
    least = roots.groupBy(F.col("root").alias("u")).agg(F.min("least").alias("m"))
    linked = beside(roots.select(F.col("root").alias("u"), F.col("nid").alias("v")), least).select(F.col("v").alias("node"), F.col("m").alias("component_id"))
    alone = nodes.join(tree, nodes["nid"] == tree["node"], "left_anti").select(F.col("nid").alias("node"), F.col("least").alias("component_id"))
    named = checkpoint(linked.union(alone))
    made = F.lower(F.concat(*[F.lpad(F.hex(f"v{k}"), 16, "0") for k in range(plan.verify[1])]))
    return signed.join(named, signed["nid"] == named["node"]).select("doc_id", made.alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, plan: Jaccard = NEAR) -> DataFrame:
    """The rows of docs, one of each near-duplicate group: that of the smallest doc_id, null ids last.

    Texts are linked where the Jaccard similarity of their five-word shingles is 0.8 or more, found by deletion variants of their
    SimHash and then by bands; extra columns of any name stay.
    Of equal rows (id and text) one stays. Kept rows are settled on keys alone; texts join them once.
    """
    names, docs = docs.columns, apart(docs, "doc_id", "text")
    marked = docs.select("*", *row_key(docs))
    signed, tree = jaccard_tree(marked, plan)
    # ids order first, null ones last (their key_text holds it); of equal ids the smaller text hash
    least = F.min(F.struct(F.col("__key_text").bitwiseAND(1), "__key_id", "__key_text")).alias("best")
    nodes = signed.groupBy("nid").agg(least)
    best = nodes.join(tree, nodes["nid"] == tree["node"], "left").groupBy(F.coalesce("root", "nid")).agg(F.min("best").alias("best"))
    winners = best.select(F.col("best.__key_id").alias("__kept_id"), F.col("best.__key_text").alias("__kept_text")).distinct()
    chosen = marked.join(winners, (marked["__key_id"] == F.col("__kept_id")) & (marked["__key_text"] == F.col("__kept_text")), "left_semi")
    return chosen.dropDuplicates(["__key_id", "__key_text"]).drop("__key_id", "__key_text").toDF(*names)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, fingerprint, component_id. Null and empty texts have fingerprint zero
    and link like any other; repeated rows stay; rows with a null id take part, a component of only such has a null id.
    """
    return simhash_components(table(spark, sf_dir, "documents"), CONTRACT)


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op1_simhash": op1_simhash}

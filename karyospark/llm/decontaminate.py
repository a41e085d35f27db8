"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping windows. A window of n characters that stands in a text with at
most k edits shares at least n - q + 1 - k q of its q-grams with it, all within k diagonals of each other. Shared
q-grams are counted in overlapping bands of diagonals, bands that reach the bound are retained, and each is
verified by a banded alignment. Texts are read once; they are compared as code points, lower-cased, with
everything but letters and digits as single spaces.
"""

from __future__ import annotations

import bisect
import functools
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, table, texts

Q = 10
#: Characters of a window, the share of them that may be edited, and the least characters of an item.
WINDOW = 96
EDITS = 1 / 16
SHORTEST = 30
#: Characters of benchmark items that one pass holds in memory; more items take more passes.
BLOCK_CHARS = 4 << 20
#: Text positions handled at a time.
PART = 1 << 16
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 22


@functools.lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """For each code point its lower-case one, or 0 for what is neither letter nor digit."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if x.isalnum():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's comparable characters, and the place of each in the text."""
    code = folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = code != 0
    keep[1:] |= code[:-1] != 0
    places = np.flatnonzero(keep)
    return code[places], places


def qgrams(code: np.ndarray) -> np.ndarray:
    n = len(code) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(Q):
        total = total * MULTIPLIER + code[i : i + n]
    return total


@dataclass
class Index:
    """The items' characters, and for each distinct q-gram hash the items and offsets that hold it.

    Every window of an item counts, at whatever offset it starts; an item of fewer characters is one window. Items
    of fewer than SHORTEST characters are held by their number of words and match whole, without edits.
    """

    codes: list[np.ndarray]
    rows: np.ndarray
    sizes: np.ndarray
    allowed: np.ndarray
    least: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    filter: np.ndarray
    short: dict[int, dict[str, list[int]]]

    @staticmethod
    def of(rows: list[tuple[int | None, str]]) -> Index | None:
        """None where no item has a letter or digit."""
        codes, held, short = [], [], {}
        for i, (_, text) in enumerate(rows):
            code, _ = normal((text or "").strip())
            if len(code) >= SHORTEST:
                codes.append(code)
                held.append(i)
            elif words := letters(code).split():
                short.setdefault(len(words), {}).setdefault(" ".join(words), []).append(i)
        if not codes and not short:
            return None
        sizes = np.array([min(WINDOW, len(c)) for c in codes], np.int64)
        budgets = (sizes * EDITS).astype(np.int64)
        found = [qgrams(c) for c in codes]
        grams = np.concatenate([np.zeros(0, np.uint64), *found])
        item = np.repeat(np.arange(len(codes)), [len(f) for f in found])
        offset = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(f)) for f in found]])
        order = np.argsort(grams, kind="stable")
        hashes, starts = np.unique(grams[order], return_index=True)
        mark = np.zeros(1 << FILTER_BITS, bool)
        mark[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        return Index(codes, np.array(held, np.int64), sizes, budgets, sizes - Q + 1 - budgets * Q, hashes, np.append(starts, len(order)), item[order], offset[order], mark, short)

    def all_windows(self) -> list[tuple[int, int]]:
        """(place of the item, offset) of every window."""
        return [(c, at) for c, code in enumerate(self.codes) for at in range(len(code) - int(self.sizes[c]) + 1)]

    @property
    def windows(self) -> list[np.ndarray]:
        return [self.codes[c][at : at + int(self.sizes[c])] for c, at in self.all_windows()]

    @functools.cached_property
    def items(self) -> np.ndarray:
        return np.array([self.rows[c] for c, _ in self.all_windows()])

    @functools.cached_property
    def budgets(self) -> np.ndarray:
        return np.array([self.allowed[c] for c, _ in self.all_windows()])

    def whole(self, code: np.ndarray, places: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The short items' places in the text, from word to word."""
        out = []
        text = letters(code)
        spans = [m.span() for m in re.finditer(r"[^ ]+", text)]
        for n, held in self.short.items():
            for (s, _), (_, e) in zip(spans, spans[n - 1 :]):
                for i in held.get(text[s:e], ()):
                    out.append((i, int(places[s]), int(places[e - 1]) + 1, 0))
        return out

    def regions(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item's row, start, end, edits) of verified windows and short items in the text, in code points."""
        code, places = normal(text)
        out = self.whole(code, places) if self.short else []
        if not self.codes or len(code) < int((self.sizes - self.allowed).min()):
            return out
        grams = qgrams(code)
        at = np.flatnonzero(self.filter[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        which = np.searchsorted(self.hashes, grams[at])
        which[which == len(self.hashes)] = 0
        held = self.hashes[which] == grams[at]
        at, which = at[held], which[held]
        if not len(at):
            return out
        # a window's q-grams stand within its length and twice its edits: positions with too few hits around go
        reach, need = WINDOW + 2 * int(WINDOW * EDITS), int(self.least.min())
        i = np.arange(len(at))
        first = np.searchsorted(at, at - reach)
        full = np.zeros(len(at) + 1, np.int64)
        good = i - first + 1 >= need
        np.add.at(full, first[good], 1)
        np.add.at(full, i[good] + 1, -1)
        alive = np.cumsum(full[:-1]) > 0
        at, which = at[alive], which[alive]
        for a in range(0, len(at), PART):
            lo = max(0, int(np.searchsorted(at, at[a] - 2 * reach))) if a else 0
            out += self.verified(code, places, at[lo : a + PART], which[lo : a + PART])
        return out

    def verified(self, code: np.ndarray, places: np.ndarray, at: np.ndarray, which: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Windows of which enough q-grams stand in one band of diagonals, aligned. Between two verified ones of a band that
        meet each other, windows are not aligned: they add nothing to the region.
        """
        n = self.starts[which + 1] - self.starts[which]
        post = np.repeat(self.starts[which] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        item, offset = self.item[post], self.offset[post]
        span = max(map(len, self.codes))
        width = 4 * int(WINDOW * EDITS) + 2
        shift = (np.repeat(at, n) - offset + span)[None, :] + np.array([[0], [width // 2]])
        band = 2 * (shift // width) + np.array([[0], [1]])
        key, of = np.unique((item[None, :] * (1 << 40) + band).ravel(), return_inverse=True)
        count = np.bincount(of.ravel())
        order = np.argsort(of.ravel(), kind="stable")
        starts = np.concatenate(([0], np.cumsum(count)))
        offsets = np.tile(offset, 2)[order]
        out, seen = [], set()
        for g in np.flatnonzero(count >= self.least[key >> 40]).tolist():
            c, b = int(key[g] >> 40), int(key[g] & ((1 << 40) - 1))
            low = (b // 2) * width - (b & 1) * (width // 2) - span
            size, k = int(self.sizes[c]), int(self.allowed[c])
            hits = np.unique(offsets[starts[g] : starts[g + 1]])
            first = np.arange(len(self.codes[c]) - size + 1)
            enough = np.searchsorted(hits, first + size - Q, "right") - np.searchsorted(hits, first) >= self.least[c]
            first = first[enough]
            todo = first[edits_needed(hits, len(self.codes[c]) - Q + 1, first, first + size - Q) <= k].tolist()

            def placed(o: int) -> bool:
                start, stop = max(0, low + o), min(len(code), low + o + width + size + k)
                got = align(self.codes[c][o : o + size], code[start:stop], k) if stop - start >= size - k else None
                if got is None:
                    return False
                s, e, edits = got
                if (c, o, start + s) not in seen:
                    seen.add((c, o, start + s))
                    out.append((int(self.rows[c]), int(places[start + s]), int(places[start + e - 1]) + 1, edits))
                return True

            i = 0
            while i < len(todo):
                good = placed(todo[i])
                while good:
                    j = bisect.bisect_right(todo, todo[i] + size // 2) - 1
                    if j > i and placed(todo[j]):
                        i = j
                        continue
                    good, failed = False, j
                    while failed - i > 1:  # where the region ends
                        mid = (i + failed) // 2
                        if placed(todo[mid]):
                            i = mid
                        else:
                            failed = mid
                    i = max(i, j)
                i += 1
        return out


def edits_needed(hits: np.ndarray, n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least edits of windows whose q-grams stand at offsets first to last, of which those in hits are unharmed.

    Each of the n offsets that isn't in hits holds an edit; one edit harms only q-grams that overlap it. So edits are
    counted from harmed q-gram to the next one beyond its reach.
    """
    harmed = np.setdiff1d(np.arange(n), hits, assume_unique=True)
    beyond = np.append(np.searchsorted(harmed, harmed + Q), len(harmed))
    harmed = np.append(harmed, np.iinfo(np.int64).max)
    at, total = np.searchsorted(harmed, first), np.zeros(len(first), np.int64)
    while (inside := harmed[at] <= last).any():
        total += inside
        at = np.where(inside, beyond[at], at)
    return total


def letters(code: np.ndarray) -> str:
    return code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").replace("\0", " ")


def align(pattern: np.ndarray, text: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best place of the whole pattern in the text, None beyond k edits.

    The text is one band of diagonals and the edits that may lead out of it. Equal places are found first. A column of
    the alignment is two numbers of a bit for each character of the pattern, where the cost goes up and where down.
    """
    raw, whole = pattern.astype("<u4").tobytes(), text.astype("<u4").tobytes()
    at = whole.find(raw)
    while at >= 0 and at % 4:
        at = whole.find(raw, at + 1)
    if at >= 0:
        return at // 4, at // 4 + len(pattern), 0
    own, held = pattern.tolist(), text.tolist()
    end, edits = least_cost(own, held, anchored=False)
    if edits > k:
        return None
    length, _ = least_cost(own[::-1], held[:end][::-1], anchored=True)
    return end - length, end, edits


def least_cost(pattern: list[int], text: list[int], anchored: bool) -> tuple[int, int]:
    """The first end of the text's characters to which the pattern aligns at the least cost, and that cost.

    anchored: the pattern aligns from the text's first character on; else from any.
    """
    at: dict[int, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    full, top, first = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1), int(anchored)
    up, down, cost = full, 0, len(pattern)
    best, end = cost, 0
    for j, c in enumerate(text, 1):
        same = at.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        rise, fall = down | (full & ~(across | up)), up & across
        cost += bool(rise & top) - bool(fall & top)
        if cost < best:
            best, end = cost, j
        rise, fall = (rise << 1 | first) & full, (fall << 1) & full
        same |= down
        up, down = fall | (full & ~(same | rise)), rise & same
    return end, best


def indexes(benchmark: DataFrame) -> Iterator[tuple[list[int], Index]]:
    """Item ids and index of each block of items; only one block is on the driver at a time.

    Items are dealt to blocks by hash, as many as keep a block near BLOCK_CHARS characters. Null texts are left out;
    items with a null id take part.
    """
    items = benchmark.where("text is not null").select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + total // BLOCK_CHARS
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = sorted({(r["item_id"], r["text"]) for r in block.collect()}, key=lambda r: (r[0] is None, r))
        index = Index.of(rows)
        if index is not None:
            yield [r[0] for r in rows], index


def merged(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Overlapping regions of an item as one, with the most edits of any of its windows."""
    out: list[tuple[int, int, int, int]] = []
    for item, s, e, x in sorted(found):
        if out and out[-1][0] == item and s <= out[-1][2]:
            out[-1] = (item, out[-1][1], max(out[-1][2], e), max(out[-1][3], x))
        else:
            out.append((item, s, e, x))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, *keep: str) -> DataFrame:
    """One row per region of a text that holds a benchmark item or a window of it: the kept columns with item_id,
    start, end (code points) and edits. Null texts have none; repeated rows have theirs each.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = texts(docs, *keep)
    schema = ", ".join([*[f"`{c}` {t}" for c, t in rows.dtypes[:-1]], "item_id bigint, start int, end int, edits int"])
    out = spark.createDataFrame([], schema)
    for ids, index in indexes(benchmark):
        shared = spark.sparkContext.broadcast((ids, index))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, index = shared.value
            for b in batches:
                where, got = [], []
                for i, x in enumerate(b.column(b.num_columns - 1)):
                    found = merged(index.regions(x.as_py()))
                    where += [i] * len(found)
                    got += found
                rest = b.select(range(b.num_columns - 1)).take(pa.array(where, pa.int64()))
                made = [pa.array([ids[g[0]] for g in got], pa.int64()), *[pa.array([g[k] for g in got], pa.int32()) for k in (1, 2, 3)]]
                yield pa.RecordBatch.from_arrays([*rest.columns, *made], names=[*rest.schema.names, "item_id", "start", "end", "edits"])

        out = out.union(rows.mapInArrow(search, schema))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any leak; every other row goes, whole."""
    spark = docs.sparkSession
    bound_batches(spark)
    columns = docs.columns
    docs = docs.select(*[c for c in columns if c != "text"], "text")
    for _, index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def choose(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not shared.value.regions(x.as_py() or "") for x in b.column(b.num_columns - 1)], pa.bool_()))

        docs = docs.mapInArrow(choose, docs.schema)
    return docs.select(*columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each region of a document that holds a benchmark item or a window of it: doc_id, item_id, start, end,
    edits. Null and empty texts and items have none, null ids stay, a repeated row has its regions each time, and a text
    that quotes several items has a region for each.
    """
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id")


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op10_decontaminate": op10_decontaminate}

"""The index beside a BAM file, by the published format: bins of six widths and a linear table of 16 KB windows."""

from __future__ import annotations

import struct
from collections.abc import Iterable

# The format's magic number; each level's first bin and the bits of its bins' width; what positions it can hold.
MAGIC = b"BAI\1"
LEVELS = ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26), (0, 29))
LINEAR_BITS, LONGEST = 14, 1 << 29
#: Bins from here on hold no reads.
LAST_BIN = 37449


def bin_of(start: int, end: int) -> int:
    """The least bin that holds [start, end)."""
    for first, bits in LEVELS:
        if start >> bits == (end - 1) >> bits:
            return first + (start >> bits)
    raise ValueError(f"position beyond what the index can hold: {end}")


def is_in(number: int, start: int, end: int) -> bool:
    """Whether the bin may hold a read that overlaps [start, end)."""
    first, bits = next(level for level in LEVELS if level[0] <= number)
    return start >> bits <= number - first <= (end - 1) >> bits


class Index:
    """For each reference its bins' chunks, pairs of virtual offsets, and the least offset of each window's reads."""

    def __init__(self, n_refs: int):
        self.bins: list[dict[int, list[list[int]]]] = [{} for _ in range(n_refs)]
        self.linear: list[list[int]] = [[] for _ in range(n_refs)]
        self.unplaced = 0

    def add(self, ref: int, start: int, end: int, begin: int, stop: int) -> None:
        """A read over [start, end) that lies at the virtual offsets [begin, stop); reads come in order."""
        if ref < 0:
            self.unplaced += 1
            return
        start = max(start, 0)  # a read without a place lies at the first one
        end = max(end, start + 1)
        if end > LONGEST:
            raise ValueError(f"position beyond what the index can hold: {end}")
        chunks = self.bins[ref].setdefault(bin_of(start, end), [])
        if chunks and chunks[-1][1] == begin:
            chunks[-1][1] = stop
        else:
            chunks.append([begin, stop])
        windows = self.linear[ref]
        last = (end - 1) >> LINEAR_BITS
        windows.extend([0] * (last + 1 - len(windows)))
        for w in range(start >> LINEAR_BITS, last + 1):
            windows[w] = windows[w] or begin

    def to_bytes(self) -> bytes:
        out = [MAGIC, struct.pack("<i", len(self.bins))]
        for bins, linear in zip(self.bins, self.linear):
            out.append(struct.pack("<i", len(bins)))
            for number, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            out.append(struct.pack("<i", len(linear)) + struct.pack(f"<{len(linear)}Q", *linear))
        return b"".join([*out, struct.pack("<Q", self.unplaced)])

    @staticmethod
    def from_bytes(data: bytes) -> Index:
        if data[:4] != MAGIC:
            raise ValueError("no BAM index")
        at = 4

        def take(kinds: str) -> tuple:
            nonlocal at
            got = struct.unpack_from("<" + kinds, data, at)
            at += struct.calcsize("<" + kinds)
            return got

        out = Index(take("i")[0])
        for ref in range(len(out.bins)):
            for _ in range(take("i")[0]):
                number, n = take("Ii")
                ends = take(f"{2 * n}Q")
                if number < LAST_BIN:
                    out.bins[ref][number] = [list(c) for c in zip(ends[::2], ends[1::2])]
            out.linear[ref] = list(take(f"{take('i')[0]}Q"))
        out.unplaced = take("Q")[0] if at + 8 <= len(data) else 0
        return out

    def chunks(self, refs: Iterable[int], start: int, end: int) -> list[tuple[int, int]]:
        """Where the reads that begin in [start, end) of the references can lie, in the file's order."""
        found = []
        start, end = max(start, 0), min(end, LONGEST)
        for ref in refs if start < end else ():
            window = start >> LINEAR_BITS
            # no read overlaps a window beyond the last, so none begins there
            if window < len(self.linear[ref]):
                least = self.linear[ref][window]
                found += [(a, b) for number, own in self.bins[ref].items() if is_in(number, start, end) for a, b in own if b > least]
        return sorted(found)


def groups(chunks: list[tuple[int, int]], most: int) -> list[list[tuple[int, int]]]:
    """Sorted chunks, cut where so many compressed bytes are together; one that has more by itself is a group of its own.
    What overlaps an earlier chunk is left out, neighbours within a group are joined.
    """
    out: list[list[tuple[int, int]]] = []
    size, reach = most, 0
    for a, b in chunks:
        a = max(a, reach)
        if a >= b:
            continue
        reach, own = b, max(1, (b >> 16) - (a >> 16))
        if size >= most or own >= most:
            out.append([])
            size = 0
        size += own
        if out[-1] and out[-1][-1][1] == a:
            out[-1][-1] = (out[-1][-1][0], b)
        else:
            out[-1].append((a, b))
    return out

"""Change points of contigs that no task holds: sparse Bayesian learning over blocks of windows.

Each round of learning solves a tridiagonal system over all candidates of a contig. A block reduces it to its edges: the
corners of its own inverse and its own solution there. A small step joins a contig's edges and hands back to each
block its neighbours' pivots and unknowns, from which the block finishes its part of the round by itself. Blocks' states
go from round to round as Parquet in the shared checkpoint folder. Candidates fall to few after some dozen rounds; a contig whose
candidates fit in a task is finished there, elimination included, across all seams.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Params
from ..session import checkpoint, checkpoint_folder, remove, ship
from .blocks import FEW, dealt_join
from .segmentation import eliminate_points, geometry, learn_from, posterior, thomas

#: Windows of a block, and candidates up to which a contig's learning is finished in one task.
BLOCK, FINISH = 1 << 16, 1 << 18
#: Rounds without a drop after which contigs of FINISH candidates at most are finished in a task too: what survives stands
#: still only after hundreds of rounds, which cost a job each here. Contigs that dropped nothing yet wait for so many rounds.
PATIENCE, WAIT = 8, 100

#: What a block tells of itself: its candidates, the first and last of them, all and those that would be kept, how far a round
#: moved, and the corners of its inverse with its own solution there.
TOLD = ("n", "a_at", "a_alpha", "a_z", "z_at", "z_alpha", "z_z", "kept", "ka_at", "ka_alpha", "ka_z", "kz_at", "kz_alpha", "kz_z", "moved", "g11", "g1k", "gk1", "gkk", "p1", "pk")
#: What a block is told: its neighbours' last and first candidates (position 0 or m beyond the ends), pivots and unknowns.
HEARD = ("l_at", "l_alpha", "l_z", "r_at", "r_alpha", "r_z", "pivot", "rhs", "back", "next", "prune")
STATE = ("at", "alpha", "weight", "z")


def corners(at, alpha, z, heard, m, v) -> tuple:
    """The corners (1,1), (1,k), (k,1), (k,k) of the inverse of the block's own system and its solution at both ends."""
    if not len(at):
        return (0.0,) * 6
    h0, left, right, w0 = geometry(at, z, m, (heard["l_at"], heard["l_z"]), (heard["r_at"], heard["r_z"]))
    inner = right[:-1]
    diag, upper, lower = 1 + v * h0 * alpha, v * inner * alpha[1:], v * inner * alpha[:-1]
    x, forward, backward = thomas(lower, diag, upper, w0)
    gkk = 1 / forward[-1]
    with np.errstate(under="ignore"):
        gk1, g1k = gkk * np.prod(-lower / forward[:-1]), gkk * np.prod(-upper / forward[:-1])
    return 1 / backward[0], g1k, gk1, gkk, x[0], x[-1]


def summary(at, alpha, z, p: Params) -> dict:
    kept = np.flatnonzero(alpha < p.segment_max_alpha)
    out = {"n": float(len(at)), "kept": float(len(kept))}
    for mark, i in (("a", 0), ("z", -1)):
        for c, x in (("at", at), ("alpha", alpha), ("z", z)):
            out[f"{mark}_{c}"] = float(x[i]) if len(at) else 0.0
            out[f"k{mark}_{c}"] = float(x[kept[i]]) if len(kept) else 0.0
    return out


def neighbours(blocks: pd.DataFrame, m: float, prune: bool) -> list[dict]:
    """For each block of a contig, in order, the candidates next to it in others, of those kept where prune."""
    k = "k" if prune else ""
    has = (blocks["kept" if prune else "n"] > 0).tolist()
    rows = blocks.to_dict("records")
    out: list[dict] = [{} for _ in rows]
    for order, side, mark, edge in ((range(len(rows)), "l", "z", 0.0), (range(len(rows) - 1, -1, -1), "r", "a", m)):
        last = (edge, 0.0, 0.0)
        for i in order:
            out[i] |= dict(zip((f"{side}_at", f"{side}_alpha", f"{side}_z"), last))
            if has[i]:
                last = tuple(rows[i][f"{k}{mark}_{c}"] for c in ("at", "alpha", "z"))
    return out


def joined(blocks: pd.DataFrame, m: float, v: float) -> list[dict]:
    """For each block of a contig, in order, what it needs for its part of the solution: the forward pivot and right side
    of the candidate before it, the backward pivot and the unknown of the one behind it.
    """
    rows, out = blocks.to_dict("records"), neighbours(blocks, m, False)
    live = [i for i, r in enumerate(rows) if r["n"]]

    def coupling(i: int, side: str) -> tuple[float, float]:
        """The entries that tie the block to its neighbour: in the row above or left of the seam, and in that below it."""
        a, b = (out[i]["l_at"], rows[i]["a_at"]) if side == "l" else (rows[i]["z_at"], out[i]["r_at"])
        h = -np.sqrt(a * (m - a) * b * (m - b)) / (m * (b - a))
        one, two = (out[i]["l_alpha"], rows[i]["a_alpha"]) if side == "l" else (rows[i]["z_alpha"], out[i]["r_alpha"])
        return v * h * two, v * h * one  # upper of the seam, lower of the seam

    for r in out:
        r.update(pivot=1.0, rhs=0.0, back=1.0, next=0.0, prune=0.0)
    ends, pivot, rhs = {}, None, 0.0
    for i in live:
        r = rows[i]
        c = g = 0.0
        if pivot is not None:
            upper, lower = coupling(i, "l")
            out[i] |= {"pivot": pivot, "rhs": rhs}
            c, g = lower * upper / pivot, lower * rhs / pivot
        whole = 1 - c * r["g11"]
        y1, yk = r["p1"] - g * r["g11"], r["pk"] - g * r["gk1"]
        corner = r["gkk"] + c * r["gk1"] * r["g1k"] / whole
        solved = yk + c * r["gk1"] * y1 / whole
        pivot, rhs = 1 / corner, solved / corner
        ends[i] = (y1 / whole, r["g1k"] / whole)  # the first unknown, and how the next one beyond the block moves it
    back = None
    for i in reversed(live):
        r = rows[i]
        c = 0.0
        if back is not None:
            upper, lower = coupling(i, "r")
            out[i] |= {"back": back, "next": first}
            c = upper * lower / back
            y, g = ends[i]
            first = y - upper * first * g
        else:
            first = ends[i][0]
        back = 1 / (r["g11"] + c * r["g1k"] * r["gk1"] / (1 - c * r["gkk"]))
    return out


def advance(at, alpha, weight, z, heard, m, v, p: Params) -> tuple:
    """One round of learning in a block: new precisions and weights, and how far the weights moved."""
    h0, left, right, w0 = geometry(at, z, m, (heard["l_at"], heard["l_z"]), (heard["r_at"], heard["r_z"]))
    before, behind = heard["l_at"] > 0, heard["r_at"] < m
    alphas = np.concatenate(([heard["l_alpha"]] if before else [], alpha, [heard["r_alpha"]] if behind else []))
    own, spread, new = posterior(h0, left, right, alphas, w0, v, (heard["pivot"], heard["rhs"]) if before else None, (heard["back"], heard["next"]) if behind else None)
    fresh = (1 + 2 * p.segment_a) / (new * new + np.maximum(v * spread, 0) + 2 * p.segment_b)
    return fresh, new, float(np.max(np.abs(new - weight)))


def arrays(r: dict) -> list[np.ndarray]:
    return [np.frombuffer(r["at"], np.int64), *(np.frombuffer(r[c], np.float64) for c in STATE[1:])]


def begin(r: dict, p: Params) -> tuple:
    """All places between windows as candidates of no precision yet, from a block's values."""
    y = np.frombuffer(r["y"], np.float64) - r["mean"]
    at = np.arange(r["first"], r["first"] + len(y), dtype=np.int64)
    sums = r["before"] + np.concatenate(([0.0], np.cumsum(y)[:-1]))
    at, sums = at[at > 0], sums[at > 0]
    x, m = at.astype(np.float64), r["m"]
    z, zero = -sums * np.sqrt(m / (x * (m - x))), np.zeros(len(at))
    return (at, zero, zero, z), summary(at, zero, z, p)


def reduce(r: dict, p: Params) -> tuple:
    """The candidates, those that are kept where some go, with the corners of their system."""
    at, alpha, weight, z = arrays(r)
    if r["prune"]:
        kept = alpha < p.segment_max_alpha
        at, alpha, weight, z = at[kept], alpha[kept], weight[kept], z[kept]
    return (at, alpha, weight, z), summary(at, alpha, z, p) | dict(zip(TOLD[-6:], corners(at, alpha, z, r, r["m"], r["v"])))


def update(r: dict, p: Params) -> tuple:
    """A round of learning, and the corners of the next one's system should nothing be dropped."""
    at, alpha, weight, z = arrays(r)
    if not len(at):
        return (at, alpha, weight, z), summary(at, alpha, z, p)
    alpha, weight, moved = advance(at, alpha, weight, z, r, r["m"], r["v"], p)
    return (at, alpha, weight, z), summary(at, alpha, z, p) | {"moved": moved} | dict(zip(TOLD[-6:], corners(at, alpha, z, r, r["m"], r["v"])))


def nothing_yet(blocks: pd.DataFrame, m: float, v: float) -> list[dict]:
    """The neighbours of each block, to reduce it; candidates go where the column prune says so."""
    prune = bool(blocks["prune"].iloc[0]) if "prune" in blocks else False
    return [r | {"pivot": 1.0, "rhs": 0.0, "back": 1.0, "next": 0.0, "prune": float(prune)} for r in neighbours(blocks, m, prune)]


class Learning:
    """The states of all contigs' blocks, round by round."""

    def __init__(self, blocks: DataFrame, keys: tuple[str, ...], p: Params) -> None:
        self.spark, self.keys, self.p = blocks.sparkSession, keys, p
        self.folder, self.step = f"{checkpoint_folder(self.spark)}/learning-{uuid.uuid4().hex}", 0
        kinds = dict(blocks.dtypes)
        self.key_types = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
        self.types = f"{self.key_types}, block bigint, m double, v double, " + ", ".join(f"`{c}` binary" for c in STATE) + ", " + ", ".join(f"`{c}` double" for c in TOLD)
        ship(self.spark)
        self.small = blocks.limit(FEW + 1).count() <= FEW
        self.key_schema = blocks.limit(0).select(*keys).toArrow().schema
        self.state = self.kept(self.mapped(blocks, begin))

    def kept(self, rows: DataFrame) -> DataFrame:
        """rows as Parquet in the shared folder; the step before goes."""
        self.step += 1
        rows.write.parquet(f"{self.folder}/{self.step}")
        if self.step > 1:
            remove(self.spark, f"{self.folder}/{self.step - 1}")
        return self.spark.read.parquet(f"{self.folder}/{self.step}")

    def mapped(self, rows: DataFrame, change) -> DataFrame:
        """Each block's row through change(row, p), which gives its new state and what it tells."""
        keys, names, schema, p = self.keys, (*self.keys, "block", "m", "v"), self.key_schema, self.p

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    state, told = change(r, p)
                    made = [pa.array([r[k]], schema.field(k).type) for k in keys] + [pa.array([r["block"]], pa.int64()), pa.array([r["m"]], pa.float64()), pa.array([r["v"]], pa.float64())]
                    made += [pa.array([x.tobytes()], pa.binary()) for x in state] + [pa.array([float(told.get(c, 0.0))], pa.float64()) for c in TOLD]
                    yield pa.RecordBatch.from_arrays(made, names=[*names, *STATE, *TOLD])

        return rows.mapInArrow(run, self.types)

    def told(self, tell, flags: DataFrame | None = None) -> DataFrame:
        """What tell(blocks, m, v) gives each block of a contig; a contig's blocks are a small table. flags: (keys, prune)."""
        keys = self.keys

        def run(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
            blocks = blocks.sort_values("block").reset_index(drop=True)
            rows = tell(blocks, float(blocks["m"].iloc[0]), float(blocks["v"].iloc[0]))
            return pd.DataFrame({**{k: blocks[k] for k in keys}, "block": blocks["block"], **{c: [float(r[c]) for r in rows] for c in HEARD}})

        small = self.state.select(*keys, "block", "m", "v", *TOLD)
        small = small if flags is None else dealt_join(small, flags, keys, "block")
        return checkpoint(small.groupBy(*keys).applyInPandas(run, f"{self.key_types}, block bigint, " + ", ".join(f"`{c}` double" for c in HEARD)))

    def go(self, heard: DataFrame, change) -> None:
        rows = dealt_join(self.state.select(*self.keys, "block", "m", "v", *STATE), heard, [*self.keys, "block"], "m", small=self.small)
        self.state = self.kept(self.mapped(rows, change))

    def decide(self, rounds: int) -> DataFrame:
        """(keys, done, prune) of each contig after a round: still or out of rounds, or too many candidates to be dropped to go on."""
        p = self.p
        sums = self.state.groupBy(*self.keys).agg(F.max("moved").alias("moved"), F.sum("kept").alias("kept"), F.sum("n").alias("n"), F.first("m").alias("m"))
        done = (F.col("moved") < p.segment_tolerance) | F.lit(rounds >= p.segment_rounds) | (F.col("n") == 0)
        return sums.select(*self.keys, done.alias("done"), (~done & (F.col("kept") < 0.9 * F.col("n"))).alias("prune"), "kept", "n", (F.col("n") < F.col("m") - 1).alias("fell"))

    def run(self, finish: int) -> Iterator[tuple[DataFrame, int]]:
        """(states, rounds) of contigs that are done or whose candidates are finish at most, or FINISH where rounds go on
        without a drop, as they come to be so."""
        rounds, dropped = 0, 0
        self.go(self.told(nothing_yet), reduce)
        while True:
            self.go(self.told(joined), update)
            rounds += 1
            verdict = self.decide(rounds)
            few = f"done or (prune and kept <= {finish})"
            if rounds - dropped >= PATIENCE:
                few += f" or (not prune and n <= {FINISH} and (fell or {rounds} >= {WAIT}))"
            any_ended, any_prune, any_left = verdict.agg(*[F.coalesce(F.max(x), F.lit(False)) for x in (F.expr(few), F.expr(f"prune and not ({few})"), F.expr(f"not ({few})"))]).first()
            if not any_ended and not any_prune:
                continue
            verdict = checkpoint(verdict)
            left = verdict.where(f"not ({few})").select(*self.keys, "prune")
            if any_ended:
                out = dealt_join(self.state, verdict.where(few).select(*self.keys, "done", "prune"), self.keys, "block")
                yield checkpoint(out.select(*self.keys, "block", "m", "v", *STATE, "done", "prune")), rounds
                if not any_left:
                    remove(self.spark, self.folder)
                    return
                self.state = self.kept(dealt_join(self.state, left.select(*self.keys), self.keys, "block"))
            if any_prune:
                dropped = rounds
                self.go(self.told(nothing_yet, left), reduce)


def packed(rows: DataFrame, keys: tuple[str, ...], size: int) -> DataFrame:
    """Each block's values (y) with its first number, the contig's length m, mean and noise variance v, and the centred sum before it."""
    kinds = dict(rows.dtypes)
    key_types = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("_i")["y"].to_numpy(np.float64)
        steps = float(np.sum(0.5 * np.diff(y) ** 2))
        return pd.DataFrame([(*key, y.tobytes(), int(pdf["_i"].min()), len(y), float(y.sum()), float(y[0]), float(y[-1]), steps)], columns=[*keys, "block", "y", "first", "n", "total", "head", "tail", "steps"])

    held = rows.select(*keys, F.floor(F.col("_i") / size).cast("bigint").alias("block"), "_i", "y")
    blocks = checkpoint(held.groupBy(*keys, "block").applyInPandas(pack, f"{key_types}, block bigint, y binary, first bigint, n bigint, total double, head double, tail double, steps double"))

    def scan(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("block")
        m, n = float(b["n"].sum()), b["n"].to_numpy(np.float64)
        mean = float(b["total"].sum()) / m
        seams = float(np.sum(0.5 * (b["head"].to_numpy()[1:] - b["tail"].to_numpy()[:-1]) ** 2))
        centred = b["total"].to_numpy() - mean * n
        return pd.DataFrame({**{k: b[k] for k in keys}, "block": b["block"], "m": m, "mean": mean, "v": (float(b["steps"].sum()) + seams) / (m - 1), "before": np.cumsum(centred) - centred})

    sums = checkpoint(blocks.select(*keys, "block", "n", "total", "head", "tail", "steps").groupBy(*keys).applyInPandas(scan, f"{key_types}, block bigint, m double, mean double, v double, before double"))
    return dealt_join(blocks.select(*keys, "block", "y", "first"), sums, [*keys, "block"], "first")


def long_change_points(rows: DataFrame, keys: tuple[str, ...], p: Params = Params(), size: int = BLOCK, finish: int = FINISH) -> DataFrame:
    """(keys, at): the numbers of the windows at which a new segment begins, as change_points() of each whole contig gives them.

    rows: keys, _i (the window's number within the contig) and y. A task holds a block of size windows, and of a contig its
    candidates once they are finish at most, or FINISH once rounds go on without a drop.
    """
    keys = tuple(keys)
    blocks = packed(rows, keys, size)
    blocks = blocks.where("v > 0 and m > 1")
    kinds = dict(blocks.dtypes)
    key_types = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    found = blocks.limit(0).select(*keys, F.lit(0).cast("bigint").alias("at"))
    if blocks.isEmpty():
        return found

    def ended(rounds: int):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("block")
            at = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["at"]])
            alpha, weight, z = (np.concatenate([np.frombuffer(x, np.float64) for x in pdf[c]]) for c in STATE[1:])
            m, v = int(pdf["m"].iloc[0]), float(pdf["v"].iloc[0])
            if pdf["done"].iloc[0] or pdf["prune"].iloc[0]:
                kept = alpha < p.segment_max_alpha
                at, alpha, weight, z = at[kept], alpha[kept], weight[kept], z[kept]
            if not pdf["done"].iloc[0]:
                at, z = learn_from(at, alpha, weight, z, m, v, rounds, p)
            x = at.astype(np.float64)
            sums = -z / np.sqrt(m / (x * (m - x)))
            points = eliminate_points(at, sums, m, np.sqrt(v), p.segment_threshold, p.segment_min_length)
            return pd.DataFrame({**{k: [key[i]] * len(points) for i, k in enumerate(keys)}, "at": np.array(points, np.int64)})

        return run

    for states, rounds in Learning(blocks, keys, p).run(finish):
        got = checkpoint(states.groupBy(*keys).applyInPandas(ended(rounds), f"{key_types}, at bigint"))
        found = found.unionByName(got)
    return found

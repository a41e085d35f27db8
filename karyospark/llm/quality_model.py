"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The statistics of every text are taken once, in one pass, and kept as a thin table. Random Fourier features
approximate a Gaussian kernel over them; each partition of the training rows sums its part of the normal
equations, and the driver adds a fixed number of such sums and solves them. Ridge scores become probabilities
by isotonic regression over counts in fixed bins.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, checkpoint, fold, held_out, table, texts

#: Random features, kernel width in standard deviations, ridge weight per row, and the seed of the features.
FEATURES = 256
WIDTH = 4.0
RIDGE = 1e-4
SEED = 20240
#: Labelled rows to learn from at most, drawn by a hash of the id; sums of the normal equations; calibration bins.
TRAIN_ROWS = 1_000_000
SUMS = 16
BINS = 1000

SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
NAMES = (
    "words", "word_length", "word_spread", "longest_word", "upper", "digits", "stops", "commas", "shouts", "symbols", "bars",
    "other_marks", "not_ascii", "variety", "same_next", "same_three", "line_words", "same_lines", "entropy", "capitals",
)


def statistics(text: str) -> list[float]:
    """The text's statistics by NAMES; an empty text has finite ones."""
    raw = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, words = max(1, len(raw)), raw.split()
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    upper, lower, digits = int(count[65:91].sum()), int(count[97:123].sum()), int(count[48:58].sum())
    beyond = int(count[128:].sum())
    marks = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    symbols = int(count[SYMBOLS].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = count[count > 0] / n
    three = len(set(zip(words, words[1:], words[2:])))
    return [
        math.log1p(len(words)),
        float(sizes.mean()),
        float(sizes.std()),
        math.log1p(float(sizes.max())),
        upper / max(1, upper + lower),
        digits / n,
        int(count[46]) / m,
        int(count[44]) / m,
        int(count[33]) / m,
        symbols / m,
        int(count[124]) / m,
        max(0, marks - symbols - int(count[33]) - int(count[44]) - int(count[46])) / m,
        beyond / n,
        math.log1p(len(set(words))) / math.log1p(m),
        sum(map(operator.eq, words, words[1:])) / m,
        1 - three / max(1, len(words) - 2) if len(words) > 2 else 0.0,
        math.log1p(len(words) / max(1, len(lines))),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        float(-(share * np.log2(share)).sum()),
        sum(1 for w in words if 65 <= w[0] <= 90) / m,
    ]


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the statistics (x, floats) of the whole text; a null text is an empty one."""
    bound_batches(docs.sparkSession)
    rows = texts(docs, *keep)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([statistics(t.as_py()) for t in b.column(b.num_columns - 1)], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], x], names=[*b.schema.names[:-1], "x"])

    return rows.mapInArrow(measure, ", ".join([*[f"`{c}` {t}" for c, t in rows.dtypes[:-1]], "x array<float>"]))


@dataclass
class Model:
    """Standardisation, the ridge weights over the random features, and the calibration's knots."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    heights: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return lift(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a thousandth of the raw score parts those on one step."""
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, self.knots, self.heights) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def lift(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of the standardised statistics, those statistics, and a constant."""
    x = np.clip((x - mean) / scale, -6, 6)
    draw = np.random.default_rng(SEED)
    directions = draw.standard_normal((x.shape[1], FEATURES)) / WIDTH
    phases = draw.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ directions + phases), x / 10, np.ones((len(x), 1))])


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), len(NAMES))


def pool(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: knots and heights, both ascending."""
    blocks: list[list[float]] = []
    for a, b, n in zip(x, y, w):
        blocks.append([a, a, b, n])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            hi, lo = blocks.pop(), blocks.pop()
            total = lo[3] + hi[3]
            blocks.append([lo[0], hi[1], (lo[2] * lo[3] + hi[2] * hi[3]) / total, total])
    return np.array([e for b in blocks for e in b[:2]]), np.array([b[2] for b in blocks for _ in (0, 1)])


def fit(train: DataFrame) -> Model | None:
    """A model of the rows (x, label, part): ridge over part 1 to 4, calibration over part 0. None without rows.

    Three passes over the thin rows: moments, normal equations, calibration counts.
    """
    k = len(NAMES)
    one = train.agg(F.count("*").alias("n"), *[f(F.get("x", F.lit(i)).cast("double")) for i in range(k) for f in (F.avg, F.stddev_pop)]).first()
    if not one["n"]:
        return None
    values = np.array(one[1:], np.float64).reshape(k, 2)
    mean, scale = values[:, 0], np.maximum(values[:, 1], 1e-6)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = FEATURES + k + 1
        total = np.zeros((size + 1, size))
        n = 0
        for b in batches:
            if b.num_rows:
                z = lift(matrix(b.column(0)), mean, scale)
                total[:size] += z.T @ z
                total[size] += b.column(1).to_numpy(zero_copy_only=False).astype(np.float64) @ z
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["total", "n"])

    parts = train.where("part <> 0").select("x", "label").coalesce(SUMS).mapInArrow(sums, "total binary, n bigint").collect()
    n = sum(p["n"] for p in parts)
    size = FEATURES + k + 1
    total = sum((np.frombuffer(bytes(p["total"])).reshape(size + 1, size) for p in parts), np.zeros((size + 1, size)))
    weights = np.linalg.solve(total[:size] + RIDGE * max(1, n) * np.eye(size), total[size])
    model = Model(mean, scale, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = np.clip(np.floor(model.raw(matrix(b.column(0))) * BINS / 2 + BINS / 4), 0, BINS - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), b.column(1)], names=["bin", "label"])

    counted = train.where("part = 0").select("x", "label").mapInArrow(bins, "bin bigint, label int").groupBy("bin").agg(F.avg("label").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    if counted:
        x = np.array([(r["bin"] + 0.5) * 2 / BINS - 0.5 for r in counted])
        model.knots, model.heights = pool(x, np.array([float(r["y"]) for r in counted]), np.array([float(r["n"]) for r in counted]))
    return model


def training_rows(rows: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """(x, label, part) of the rows outside the held-out fold that have a label, limit at most by hash.

    Rows without an id or a label take no part; labels given twice count twice.
    """
    marks = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("label"))
    marks = marks.where(fold(F.col("label_id")) != 1)
    n = marks.count()
    spread = F.xxhash64(F.col("label_id").cast("string"), F.lit(7))
    if n > limit:
        marks = marks.where(spread.bitwiseAND((1 << 31) - 1) < int((1 << 31) * limit / n))
    return rows.join(marks, rows["doc_id"] == marks["label_id"]).select("x", "label", F.pmod(spread, F.lit(5)).alias("part"))


def with_quality(rows: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """Scores of rows with statistics; 0.5 without a model."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = model.score(matrix(b.column(b.num_columns - 1))) if model and b.num_rows else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.float64())], names=[*b.schema.names[:-1], "score"])

    rows = rows.select(*keep, "x")
    return rows.mapInArrow(score, ", ".join([*[f"`{c}` {t}" for c, t in rows.dtypes[:-1]], "score double"]))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, held_out, score, predicted. Null texts score as empty ones, every text 0.5
    if nothing has a label to learn from; a null id is not held out; repeated rows stay, each with the same score.
    """
    rows = checkpoint(with_statistics(table(spark, sf_dir, "documents"), "doc_id"))
    model = fit(checkpoint(training_rows(rows, table(spark, sf_dir, "labels"))))
    scored = with_quality(rows, model, "doc_id")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op2_quality": op2_quality}

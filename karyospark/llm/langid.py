"""Language ID by rank-order profiles.

Each language's profile is the ranking of its most frequent letter n-grams over the learning documents.
A document's own ranking is compared to every profile by the out-of-place distance: the sum, over the
document's n-grams, of how far their ranks differ, n-grams outside the profile counting the most.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_of, bound_batches, fold, held_out, table, texts

#: Longest n-gram, and n-grams of a ranking.
LONGEST = 3
RANKS = 400
#: Documents of each language to learn from at most; taken by the order of a hash of their id.
LEARN = 3000
#: Languages with a profile at most, the most frequent ones; parts that the n-grams of a language are first ranked in.
LANGUAGES = 1000
PARTS = 64
UNKNOWN = "und"
EDGE = sys.maxunicode + 1
#: Characters counted at a time: longer texts need bounded memory and get the same counts.
PART = 1 << 18


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the lower-cased text and their counts; what isn't a letter is one word boundary, and so are both ends.

    An n-gram is a long of up to three code points, 21 bits each; a boundary is EDGE, beyond all of them. Long texts are counted in parts: of
    each part the last LONGEST - 1 characters go on to the next one, where the n-grams that start in them are counted.
    """
    keys, counts = [], []
    low, held = text.lower(), np.array([EDGE])
    for at in range(0, len(low), PART):
        code = np.frombuffer(low[at : at + PART].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        final = at + PART >= len(low)
        code = np.concatenate((held, np.where(letters()[code], code, EDGE), [EDGE] if final else held[:0]))
        code = code[np.concatenate(([True], (code[1:] != EDGE) | (code[:-1] != EDGE)))]
        starts = len(code) if final else max(0, len(code) - LONGEST + 1)
        held = code[starts:]
        for n in range(1, LONGEST + 1):
            m = min(starts, len(code) - n + 1)
            if m <= 0:
                break
            key = code[:m]
            for k in range(1, n):
                key = (key << 21) | code[k : m + k]
            key, count = np.unique(key if n > 1 else key[key != EDGE], return_counts=True)
            keys.append(key)
            counts.append(count)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(low) <= PART:
        return np.concatenate(keys), np.concatenate(counts)
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def ranking(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams, best first; of equal counts the smaller key comes first."""
    if len(keys) > RANKS:
        least = -np.partition(-counts, RANKS - 1)[RANKS - 1]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))[:RANKS]]


class Profiles:
    """Profiles of all languages, to look up a ranking in all of them at once."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.languages = sorted(profiles)
        self.keys = np.unique(np.concatenate([np.array(profiles[x], np.int64) for x in self.languages] or [np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.languages), len(self.keys) + 1), -1, np.int64)
        for i, x in enumerate(self.languages):
            self.ranks[i, np.searchsorted(self.keys, profiles[x])] = np.arange(len(profiles[x]))

    def distances(self, ranked: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language, as a share of the largest possible."""
        at = np.searchsorted(self.keys, ranked)
        found = at < len(self.keys)
        found[found] = self.keys[at[found]] == ranked[found]
        ranks = self.ranks[:, np.where(found, at, len(self.keys))]
        out = np.where(ranks < 0, RANKS, np.abs(ranks - np.arange(len(ranked))))
        return out.sum(1) / (RANKS * max(1, len(ranked)))

    def predict(self, text: str) -> tuple[str, float]:
        """The nearest language and how near it is, with how clear it is; und where there is no letter.

        Of equally near languages the first by name counts.
        """
        keys, counts = ngrams(text)
        if not self.languages or not len(keys) or not has_letter(text):
            return UNKNOWN, 0.0
        away = self.distances(ranking(keys, counts))
        order = np.argsort(away, kind="stable")
        best = float(away[order[0]])
        next_best = float(away[order[1]]) if len(order) > 1 else 1.0
        return self.languages[int(order[0])], min(1.0, max(0.0, (1 - best) * (1 + min(1.0, 4 * (next_best - best))) / 2))


def learn(docs: DataFrame, per_language: int = LEARN) -> dict[str, list[int]]:
    """Profiles from the documents with a language outside the held-out fold.

    Learns from per_language documents a language at most: ids are drawn first, by hash, so that only
    their texts are read further. N-grams of each document count in proportion to its length.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"], docs["lang"], docs["text"]).where(docs["lang"].isNotNull() & (fold(docs["doc_id"]) != 1))
    rows = texts(drawn(rows, per_language), "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
        for b in batches:
            by: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                by.setdefault(lang, []).append(ngrams(text.as_py()))
            for lang, got in by.items():
                key, where = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
                n = np.bincount(where, np.concatenate([g[1] for g in got]), minlength=len(key)).astype(np.int64)
                yield batch_of({"lang": [lang] * len(key), "gram": key, "n": n}, schema)

    counts = rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the best of each part of a language's n-grams first, so that no task holds them all
    best = (F.desc("n"), F.asc("gram"))
    for by in (["lang", F.pmod("gram", F.lit(PARTS))], ["lang"]):
        counts = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("rank") <= RANKS)
    out: dict[str, list[int]] = {}
    for r in counts.orderBy("lang", "rank").collect():  # RANKS of each of LANGUAGES at most
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def drawn(rows: DataFrame, per_language: int) -> DataFrame:
    """About per_language rows of each language, or all if they are fewer, by a hash of the id.

    A corpus with more than LANGUAGES values of lang has profiles of its most frequent ones; of equal ones the first by name.
    """
    n = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    bounds = n.select(F.col("lang").alias("its_lang"), F.when(F.col("n") <= per_language, F.lit(1 << 31)).otherwise(F.floor(F.lit(float(1 << 31)) * per_language / F.col("n"))).alias("bound"))
    spread = F.xxhash64(rows["doc_id"].cast("string")).bitwiseAND((1 << 31) - 1)
    return rows.join(F.broadcast(bounds), (rows["lang"] == F.col("its_lang")) & (spread < F.col("bound")), "left_semi")


def with_language(docs: DataFrame, profiles: dict[str, list[int]], *keep: str) -> DataFrame:
    """The kept columns with lang_pred and score; a null text or one without letters is und with score 0."""
    bound_batches(docs.sparkSession)
    rows = texts(docs, *keep)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(profiles)
        for b in batches:
            got = [known.predict(x.as_py()) for x in b.column(b.num_columns - 1)]
            columns = [*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], "lang_pred", "score"])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in rows.dtypes[:-1]], "lang_pred string, score double"])
    return rows.mapInArrow(predict, schema)


def keep_known(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """The rows of docs in a known language; those without letters, or as far from all as can be, go."""
    rest = [c for c in docs.columns if c != "text"]
    bound_batches(docs.sparkSession)
    order = docs.select(*rest, "text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(profiles)
        for b in batches:
            good = []
            for x in b.column(b.num_columns - 1):
                lang, score = known.predict(x.as_py() or "")
                good.append(lang != UNKNOWN and score > 0)
            yield b.filter(pa.array(good, pa.bool_()))

    return order.mapInArrow(choose, order.schema).select(*docs.columns)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, held_out, lang_pred, score. Null texts and texts without a letter are und
    with score 0, as is every text if there is nothing to learn from; a null id is not held out; repeated rows stay; of
    equally near languages the first by name counts.
    """
    docs = table(spark, sf_dir, "documents")
    rows = with_language(docs, learn(docs), "doc_id")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op5_langid": op5_langid}

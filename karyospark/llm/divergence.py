"""How a language's sources differ in their words: distances between sources, and the words that stand out in each.

Shares are whole numbers, smoothed, so that all arithmetic is exact. Most terms have no occurrence in most sources;
there a share is the source's baseline, and the distance of two sources is taken as that of their baselines over
all terms, corrected at the terms that occur in either. Words that stand out are found by radix selection: histograms
over the bits of the value, then over the bytes of the word, narrow each group to few candidates.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, checkpoint, table

#: Documents of a language in which a term must occur to be kept.
LEAST = 30
SMOOTH, SCALE = 5, 1_000_000_000
#: Ranks of the part term.
BEST = 50
#: Distinct terms, and bytes of text, that a task counts before it passes its counts on.
HELD, HELD_BYTES = 1 << 18, 128 << 20
#: Copies of a group's totals, among which its terms are dealt.
DEALT = 64
#: A group whose open candidates are at most so many is ranked as it is.
FEW = 256
#: Values are below 2^33; a round of the selection looks at a digit of 11 bits, then at 2 bytes of the item.
DIGITS, BITS, BYTES = 3, 11, 2
#: Sources of one block: a task holds the sums of one pair of blocks at a time.
BLOCK = 256

# letters A-Z become small, letters a-z and bytes of other code points stay, all else parts terms
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term; docs: lang, source, text. Null texts and names
    count as empty ones. Tasks count before anything is shuffled.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict = defaultdict(Counter)
        seen: dict = defaultdict(Counter)

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in n.items():
                k, its = len(terms), seen[lang, source]
                words = pa.array(list(terms), pa.binary()).cast(pa.string())
                values = [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), words, pa.array(terms.values(), pa.int64()), pa.array([its[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(values, schema=COUNTS)
            n.clear()
            seen.clear()

        held = size = 0
        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                found = Counter(text.translate(TERMS).split())
                its = n[lang, source]
                held -= len(its)
                its.update(found)
                held += len(its)
                seen[lang, source].update(found.keys())
                size += len(text)
                if held > HELD or size > HELD_BYTES:
                    yield from told()
                    held = size = 0
        yield from told()

    bound_batches(docs.sparkSession)
    rows = docs.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    terms, above = terms.cast("bigint"), F.lit(SCALE).cast("decimal(10,0)") * wide(count + SMOOTH)
    return F.when(terms > 0, 1 + F.call_function("div", above, wide(total + SMOOTH * terms))).cast("bigint")


def beside(rows: DataFrame, few: DataFrame, on: list[str], deal: str) -> DataFrame:
    """rows joined with few, the table of groups: each group is copied, and rows are dealt among the copies, so that a large
    group is many tasks' work.
    """
    copies = few.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    dealt = rows.withColumn("__deal", F.pmod(F.xxhash64(deal), F.lit(DEALT)).cast("int"))
    return dealt.join(copies, [*on, "__deal"]).drop("__deal")


def ledger(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(terms, groups): each group's kept terms with n, its share p and the language's q; all groups with N, V and baseline b."""
    docs = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    pairs = docs.select("lang", "source").distinct()
    counts = checkpoint(counted(docs))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    terms = checkpoint(counts.drop("docs").join(kept, ["lang", "term"]))
    whole = terms.select("lang", "term", "n_lang").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("m_lang"))
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("m"))
    groups = pairs.join(totals, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0, ["m", "v", "m_lang"])
    groups = checkpoint(groups.withColumn("b", share(F.lit(0).cast("bigint"), F.col("m"), F.col("v"))))
    rows = beside(terms, groups, ["lang", "source"], "term")
    p, q = share(F.col("n"), F.col("m"), F.col("v")), share(F.col("n_lang"), F.col("m_lang"), F.col("v"))
    return checkpoint(rows.select("lang", "source", "term", "n", p.alias("p"), q.alias("q"))), groups


def digit(level: int) -> Column:
    """The digit of (value, item) at this level, so that rows of higher rank have smaller digits."""
    if level < DIGITS:
        at = BITS * (DIGITS - 1 - level)
        return (1 << BITS) - 1 - F.shiftright(F.col("value"), at).bitwiseAND(F.lit((1 << BITS) - 1))
    part = F.substring(F.encode("item", "UTF-8"), 1 + BYTES * (level - DIGITS), BYTES)
    # a byte counts from 1, so that an item that ends comes before all that go on
    byte = lambda i: F.coalesce(F.conv(F.hex(F.substring(part, i, 1)), 16, 10).cast("bigint") + 1, F.lit(0).cast("bigint"))
    place = F.lit(0).cast("bigint")
    for i in range(1, BYTES + 1):
        place = place * 257 + F.when(F.octet_length(part) >= i, byte(i)).otherwise(0)
    return place


def ranked(rows: DataFrame, group: list[str]) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def top(rows: DataFrame, group: list[str], k: int, few: int = FEW) -> DataFrame:
    """The first k rows of each group by value, largest first, then by the bytes of item; with their rank.

    rows: group, item, value from 0 to below 2^33, checkpointed; items of a group differ. Each round counts the open rows by
    the next digit and finds the bin in which the k-th lies: rows before it are candidates, those in it stay
    open, those after it go. No task sees more of a group than the bins of a digit, and k + few candidates.
    """
    found, level = [], 0
    open_ = rows
    left = rows.select(*group).distinct().withColumn("k", F.lit(k).cast("bigint"))
    while True:
        bins = open_.withColumn("digit", digit(level)).groupBy(*group, "digit").agg(F.count("*").alias("n")).join(left, group)
        line, whole = Window.partitionBy(*group).orderBy("digit"), Window.partitionBy(*group)
        bins = bins.withColumns({"upto": F.sum("n").over(line), "total": F.sum("n").over(whole)})
        # the bin of the k-th; a group with few rows left is taken whole
        last = F.min(F.when(F.col("upto") >= F.col("k"), F.col("digit")))
        cut = bins.groupBy(*group).agg(F.first("k").alias("k"), F.first("total").alias("total"), last.alias("last"))
        cut = cut.withColumn("last", F.when(F.col("total") <= few, F.lit(1 << 40)).otherwise(F.coalesce("last", F.lit(1 << 40))))
        inside = bins.join(cut.select(*group, "last"), group).groupBy(*group, "last")
        before, at = F.col("digit") < F.col("last"), F.col("digit") == F.col("last")
        cut = checkpoint(inside.agg(F.first("k").alias("k"), F.coalesce(F.sum(F.when(before, F.col("n"))), F.lit(0)).alias("sure"), F.coalesce(F.sum(F.when(at, F.col("n"))), F.lit(0)).alias("tied")))
        done = (F.col("tied") == 0) | (F.col("sure") + F.col("tied") == F.col("k")) | (F.col("tied") <= few)
        cut = cut.withColumn("goes_on", ~done)
        told = beside(open_.withColumn("digit", digit(level)), cut.select(*group, "last", "goes_on"), group, "item")
        told = checkpoint(told.where(F.col("digit") <= F.col("last")).withColumn("open", F.col("goes_on") & (F.col("digit") == F.col("last"))).drop("digit", "last", "goes_on"))
        found.append(told.where("not open").drop("open"))
        left = cut.where("goes_on").select(*group, (F.col("k") - F.col("sure")).alias("k"))
        if left.isEmpty():
            break
        open_ = told.where("open").drop("open")
        level += 1
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    return ranked(candidates, group).where(F.col("rank") <= k)


def blocks(groups: DataFrame) -> DataFrame:
    """groups with i, the source's place in its language by name, and its block of sources."""
    line = Window.partitionBy("lang").orderBy("source")
    return groups.withColumn("i", F.row_number().over(line) - 1).withColumn("block", F.floor(F.col("i") / BLOCK).cast("int"))


def shared_corrections(terms: DataFrame, placed: DataFrame) -> DataFrame:
    """(lang, i, j, both): over the terms that occur in both sources, i < j, the sum of |p - p'| - |p - b'| - |b - p'| + |b - b'|.

    A term's row for a pair of blocks has the entries of its sources in both. Tasks add up one pair of blocks at
    a time and return the sums, so that pairs of a term are never rows.
    """
    entry = F.struct(F.pmod("i", F.lit(BLOCK)).alias("i"), "p", "b")
    rows = beside(terms.select("lang", "source", "term", "p"), placed.select("lang", "source", "i", "block", "b"), ["lang", "source"], "term")
    rows = rows.groupBy("lang", "term", "block").agg(F.collect_list(entry).alias("at"))  # a block's sources at most
    n = placed.groupBy("lang").agg((F.max("block") + 1).alias("n_blocks"))
    rows = beside(rows, n, ["lang"], "term")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    rows = rows.select("lang", "term", "block", "at", other)
    pair = rows.groupBy("lang", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "term")
    pair = pair.agg(F.first(F.when(F.col("block") <= F.col("other"), F.col("at")), True).alias("a"), F.first(F.when(F.col("block") >= F.col("other"), F.col("at")), True).alias("c"))
    pair = pair.where("a is not null and c is not null").sortWithinPartitions("lang", "first", "second")
    out = pa.schema([("lang", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("both", pa.int64())])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def told() -> Iterator[pa.RecordBatch]:
            lang, first, second = now
            i, j = np.nonzero(sums)
            both = sums[i, j]
            i, j = i + first * BLOCK, j + second * BLOCK
            use = i < j
            i, j, both = i[use], j[use], both[use]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(both, pa.int64())], schema=out)

        def arrays(column: pa.ListArray) -> Iterator[tuple]:
            at = column.offsets.to_numpy().tolist()
            i, p, b = (column.values.field(x).to_numpy(zero_copy_only=False) for x in ("i", "p", "b"))
            return ((i[s:e], p[s:e], b[s:e]) for s, e in zip(at, at[1:]))

        for batch in batches:
            keys = zip(batch.column("lang").to_pylist(), batch.column("first").to_pylist(), batch.column("second").to_pylist())
            for key, (i, p, b), (j, q, d) in zip(keys, arrays(batch.column("a")), arrays(batch.column("c"))):
                if key != now:
                    if now is not None:
                        yield from told()
                    now, sums = key, np.zeros((BLOCK, BLOCK), np.int64)
                p, b = p[:, None], b[:, None]
                sums[np.ix_(i, j)] += abs(p - q) - abs(p - d) - abs(b - q) + abs(b - d)
        if now is not None:
            yield from told()

    bound_batches(terms.sparkSession)
    part = pair.select("lang", "first", "second", "a", "c").mapInArrow(add, "lang string, i int, j int, both bigint")
    return part.groupBy("lang", "i", "j").agg(F.sum("both").alias("both"))


def own_corrections(terms: DataFrame, placed: DataFrame) -> DataFrame:
    """(lang, i, j, own): over the terms of source i, the sum of |p - b'| - |b - b'| against source j's baseline b'.

    A source's distinct shares are at most as many as distinct counts, fewer than twice the root of its words; sorted
    with running sums they answer a block of baselines at a time.
    """
    levels = beside(terms.groupBy("lang", "source", "p").agg(F.count("*").alias("w")), placed.select("lang", "source", "i"), ["lang", "source"], "p")
    levels = levels.groupBy("lang", "i").agg(F.sort_array(F.collect_list(F.struct("p", "w"))).alias("levels")).join(placed.select("lang", "i", "b"), ["lang", "i"])
    others = placed.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("i", "b"))).alias("others"))
    rows = beside(levels, others, ["lang"], "i")  # sources by blocks of sources
    out = pa.schema([("lang", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("own", pa.int64())])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                p, w = (np.array([x[c] for x in r["levels"]], np.int64) for c in ("p", "w"))
                j, d = (np.array([x[c] for x in r["others"]], np.int64) for c in ("i", "b"))
                sums, sizes = (np.concatenate(([0], np.cumsum(x))) for x in (p * w, w))
                cut = np.searchsorted(p, d)
                away = d * sizes[cut] - sums[cut] + (sums[-1] - sums[cut]) - d * (sizes[-1] - sizes[cut])
                own = away - sizes[-1] * abs(r["b"] - d)
                k = len(j)
                yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * k, pa.string()), pa.array([r["i"]] * k, pa.int32()), pa.array(j, pa.int32()), pa.array(own, pa.int64())], schema=out)

    bound_batches(terms.sparkSession)
    return rows.select("lang", "i", "b", "levels", "others").mapInArrow(add, "lang string, i int, j int, own bigint")


def pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of every two sources of a language, both ways; 0 where no term is kept.

    Over all V terms the baselines differ by V |b - b'|; to this come the corrections of both sources' own terms and of the
    shared ones. The rows are the pairs that the result has anyway.
    """
    placed = checkpoint(blocks(groups))
    one, two = (placed.select("lang", F.col("i").alias(i), F.col("source").alias(s), F.col("b").alias(b), "v") for i, s, b in (("i", "source", "b"), ("j", "item", "d")))
    every = beside(one, two.drop("v"), ["lang"], "source").where("i <> j")  # the result's own pairs
    own = checkpoint(own_corrections(terms, placed))
    both = shared_corrections(terms, placed)
    both = both.unionByName(both.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "both"))
    back = own.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), F.col("own").alias("back"))
    got = every.join(own, ["lang", "i", "j"], "left").join(back, ["lang", "i", "j"], "left").join(both, ["lang", "i", "j"], "left")
    part = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    value = F.when(F.col("v") > 0, F.col("v") * F.abs(F.col("b") - F.col("d"))).otherwise(0) + part("own") + part("back") + part("both")
    return got.select("lang", "source", "item", value.cast("bigint").alias("value"))


def standing_out(terms: DataFrame, k: int = BEST, few: int = FEW) -> DataFrame:
    """(lang, source, item, value, rank): each group's k terms whose share most exceeds the language's."""
    rows = checkpoint(terms.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")))
    return top(rows, ["lang", "source"], k, few)


def diverging(docs: DataFrame, least: int = LEAST, k: int = BEST, few: int = FEW) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (lang, source, text), as op13_source_divergence() says."""
    terms, groups = ledger(docs, least)
    names = ("lang", "source", "part", "item", "value", "rank")
    far = ranked(pairs(terms, groups), ["lang", "source"]).withColumn("part", F.lit("pair")).select(*names)
    return far.unionByName(standing_out(terms, k, few).withColumn("part", F.lit("term")).select(*names))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part pair: for each (lang, source) its distance to every other source of the language, largest first; part term: the 50
    kept terms whose share most exceeds the language's. Null text, lang and source count as empty; groups without terms have
    pairs; ties rank by UTF-8 bytes; repeated rows count each; an empty table gives no row.
    """
    return diverging(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op13_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
o AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS m FROM k GROUP BY lang),
g AS (SELECT lang, source, any_value(v) AS v FROM d LEFT JOIN l USING (lang) GROUP BY lang, source),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS m FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(s.m, 0) + 5 * g.v) AS p,
             1 + (1000000000 * (k.n + 5)) // (l.m + 5 * l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
t AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
x AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM e UNION ALL SELECT * FROM t))
SELECT lang, source, part, item, value, rank FROM x WHERE part = 'pair' OR rank <= 50
""",
}
QUERIES = {"op13_source_divergence": op13_source_divergence}

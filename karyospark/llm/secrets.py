"""Secret scans with corpus-wide ownership frequency.

One pass finds base secrets and wider candidates in every text. Candidate values are hashed, and the
distinct repositories and owners of each hash are counted over the corpus: a value that many owners hold in many
repositories is a copied example; one of few owners looks live, in however many of their repositories it stands, and
so does one in few repositories, however many owners these have. Base spans always stay; a wider candidate becomes a
span only where its value looks live.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, bound_batches, checkpoint, row_key, table, texts

# Patterns of the base kinds and the lengths that their matches need.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]{16,}")  # of maximal runs only those of 16 and more
KINDS = ("assign", "access", "hex", "key_block", "prefixed", "mixed")

#: Wider candidates: private key headers, tokens with well-known prefixes, and long mixed strings.
KEY_BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?")
PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})")
#: Web tokens of two or three runs: a whole run before a dot is looked at once, and in it where a token may begin.
RUN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{11,}(?=\.[A-Za-z0-9_-]{8})")
BEGIN = re.compile(r"(?<![A-Za-z0-9])eyJ")
REST = re.compile(r"\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)?")
MIXED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
#: Bits a character that a mixed string must have.
ENTROPY = 3.5
#: Owners and repositories from which on a value is a copied example.
COPIED = 3

HINTS = (b"passw", b"secret", b"token", b"api_key", b"apikey")


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, value) of base secrets in code points, by start and kind."""
    low = text.encode("utf-8", "surrogatepass").lower()
    found = []
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


class Taken:
    """Spans merged to ones that lie apart, to be asked in logarithmic time."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, s: int, e: int) -> bool:
        """Whether any of the spans shares a character with s to e."""
        k = bisect_right(self.ends, s)
        return k < len(self.starts) and self.starts[k] < e


def web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Starts and ends of web tokens, leftmost first and apart; linear in the text."""
    last = 0
    if "eyJ" in text:
        for run in RUN.finditer(text):
            begin = BEGIN.search(text, max(run.start(), last), run.end() - 8)
            if begin:
                last = REST.match(text, run.end()).end()
                yield begin.start(), last


def wider_spans(text: str) -> list[tuple[int, int, int, str]]:
    """Candidates beyond the base kinds; a mixed string has all of digits, upper and lower case and enough entropy,
    and lies in no other candidate.
    """
    found = []
    if "-----BEGIN " in text:
        found += [(m.start(), 3, m.end(), re.sub(r"\s", "", m[0])) for m in KEY_BLOCK.finditer(text)]
    web = list(web_tokens(text))
    apart = Taken(web)
    found += [(s, 4, e, text[s:e]) for s, e in web]
    found += [(m.start(), 4, m.end(), m[0]) for m in PREFIXED.finditer(text) if not apart.meets(m.start(), m.end())]
    sure = Taken((s, e) for s, _, e, _ in found)
    for m in MIXED.finditer(text):
        v = m[0]
        if re.search("[0-9]", v) and re.search("[a-z]", v) and re.search("[A-Z]", v) and entropy(v) >= ENTROPY:
            if not sure.meets(m.start(), m.end()):
                found.append((m.start(), 5, m.end(), v))
    return sorted(found)


def told(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in sorted(spans))


SPAN = "struct<s:int, k:int, e:int, h:bigint>"
NUMBERS = ("n_live", "n_copied", "n_spread", "most_owners", "most_repositories")


def scan(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns with base and wider spans, each with its value's hash; no text. Null texts have none."""
    bound_batches(docs.sparkSession)
    rows = texts(docs, *keep)
    kind = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32()), ("h", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = lambda spans: [{"s": s, "k": k, "e": e, "h": xxhash.xxh64_intdigest(v.encode("utf-8", "surrogatepass")) - (1 << 63)} for s, k, e, v in spans]
        for b in batches:
            base, wider = [], []
            for x in b.column(b.num_columns - 1):
                text = x.as_py()
                own = base_spans(text)
                base.append(mark(own))
                taken = Taken((s, e) for s, _, e, _ in own)
                wider.append(mark(w for w in wider_spans(text) if not taken.meets(w[0], w[2])))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(base, kind), pa.array(wider, kind)], names=[*b.schema.names[:-1], "base", "wider"])

    return rows.mapInArrow(find, ", ".join([*[f"`{c}` {t}" for c, t in rows.dtypes[:-1]], f"base array<{SPAN}>, wider array<{SPAN}>"]))


def ownership(found: DataFrame, repository: str, owner: str) -> DataFrame:
    """For each value's hash the number of distinct repositories and owners that hold it.

    Distinct triples are formed before anything is counted, so that a value held millions of times comes
    down to one row per repository on the map side; a null owner or repository counts as one of its own.
    """
    each = found.select(F.explode(F.concat("base", "wider")["h"]).alias("h"), F.col(repository).alias("r"), F.col(owner).alias("o"))
    owners = each.select("h", "o").distinct().groupBy("h").agg(F.count("*").alias("n_owners"))
    places = each.select("h", "r").distinct().groupBy("h").agg(F.count("*").alias("n_repositories"))
    return owners.join(places, "h")


def is_live(copied: int) -> F.Column:
    """Whether a value's n_owners and n_repositories don't make it a copied example."""
    return (F.col("n_owners") < copied) | (F.col("n_repositories") < copied)


def judged(docs: DataFrame, repository: str = "doc_id", owner: str = "source", copied: int = COPIED) -> DataFrame:
    """Every row's id, base spans, live wider spans (live), how many of its values are live, copied, and live in more than
    one repository (n_spread), and the most owners and repositories of any of them; 0 without values.
    """
    keep = list(dict.fromkeys(["doc_id", repository, owner]))
    found = checkpoint(scan(docs, *keep).withColumn("row", F.monotonically_increasing_id()))
    owned = ownership(found, repository, owner)
    held = found.where((F.size("base") > 0) | (F.size("wider") > 0))
    spans = held.select("row", F.explode(F.concat(F.transform("base", lambda x: F.struct(x.alias("x"), F.lit(True).alias("b"))), F.transform("wider", lambda x: F.struct(x.alias("x"), F.lit(False).alias("b"))))).alias("y"))
    spans = spans.select("row", F.col("y.x").alias("x"), F.col("y.b").alias("b"), F.col("y.x.h").alias("h")).join(checkpoint(owned), "h")
    live = is_live(copied)
    by_row = spans.groupBy("row").agg(
        F.collect_list(F.when(live & ~F.col("b"), F.col("x"))).alias("live"),
        F.sum(live.cast("bigint")).alias("n_live"),
        F.sum((~live).cast("bigint")).alias("n_copied"),
        F.sum((live & (F.col("n_repositories") > 1)).cast("bigint")).alias("n_spread"),
        F.max("n_owners").alias("most_owners"),
        F.max("n_repositories").alias("most_repositories"),
    )
    rows = found.join(by_row, "row", "left")
    numbers = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in NUMBERS]
    return rows.select(*keep, "base", F.coalesce("live", F.array().cast(f"array<{SPAN}>")).alias("live"), *numbers)


def redacted(docs: DataFrame, copied: int = COPIED, mark: str = "[secret]") -> DataFrame:
    """The rows of docs with every live-looking value, base or wider, replaced by the mark; n_chars follows.

    Values that many owners hold in many repositories are copied examples and stay. No row goes; repeated rows stay repeated. Spans come from
    the scan on keys of id and text, and join the texts once.
    """
    names, kinds, docs = docs.columns, dict(docs.dtypes), apart(docs, "doc_id", "text", "source", "n_chars")
    keys = row_key(docs)
    marked = docs.select("*", *keys)
    found = checkpoint(scan(marked, "doc_id", "source", "__key_id", "__key_text"))
    owned = ownership(found, "doc_id", "source").where(is_live(copied)).select("h")
    held = found.where((F.size("base") > 0) | (F.size("wider") > 0)).dropDuplicates(["__key_id", "__key_text"])
    each = held.select("__key_id", "__key_text", F.explode(F.concat("base", "wider")).alias("x")).select("__key_id", "__key_text", "x", F.col("x.h").alias("h"))
    spans = each.join(owned, "h").groupBy("__key_id", "__key_text").agg(F.sort_array(F.collect_list(F.struct("x.s", "x.e"))).alias("__spans"))
    spans = checkpoint(spans.withColumnsRenamed({"__key_id": "__span_id", "__key_text": "__span_text"}))
    rows = marked.join(spans, (marked["__key_id"] == spans["__span_id"]) & (marked["__key_text"] == spans["__span_text"]), "left")
    # spans in order: what lies before each is kept, a span within what is already covered adds nothing
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    gap = lambda a, x: F.substring(F.col("text"), a["at"] + 1, x["s"] - a["at"])
    step = lambda a, x: F.when(x["s"] < a["at"], F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(x["e"].alias("at"), F.concat(a["out"], gap(a, x), F.lit(mark)).alias("out")))
    done = lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text")))
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.aggregate("__spans", first, step, done))
    out = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kinds["n_chars"])))
    return out.select(*docs.columns).toDF(*names)


def written(spans) -> F.Column:
    """Spans as text, kind:start:end by start and then kind."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.transform(F.sort_array(spans), one), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, the base counts and digest, spans, and the verdicts on its values. Null and
    empty texts have no span; a null id or source is a repository or owner of its own; repeated rows stay, and of spans
    that start together the kind listed first comes first.
    """
    rows = judged(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("bigint")
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.concat("base", "live")).alias("spans"),
        *NUMBERS,
    )


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op4_secrets": op4_secrets}

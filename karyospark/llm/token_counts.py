"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes. Texts are split at boundaries that the tokenizer never crosses, so that
a text's count is the sum over its pieces; pieces that occur again are counted once per task, within a
bounded table, and only pieces not yet seen reach the library.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from .common import balanced, batch_of, bound_batches, table, texts

FOLDER = "/opt/tokenizers"
#: Tokens a document may have.
LIMIT = 512
#: Bytes of texts handled at a time, and pieces whose counts are kept.
BATCH = 4 << 20
KEPT = 400_000
#: A letter, then one space and a letter. The byte-level pattern takes a letter run with the one space
#: before it, so a run ends at every such space; special tokens hold no space. Other letters just don't split.
SAFE = re.compile("(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?= [A-Za-zÀ-ÖØ-öø-ÿ])")


def vocabulary(name: str, folder: str | None = None) -> str:
    """The file's path: in the folder, else where the public_tokenizers package has it."""
    if folder is None:
        try:
            import public_tokenizers
        except ImportError:
            folder = FOLDER
        else:
            return public_tokenizers.path(name)
    return f"{folder}/{name}"


@functools.lru_cache(maxsize=4)
def counter(path: str):
    """A function from texts to their token counts, by the library that reads the file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda batch: [len(x) for x in model.encode(batch, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda batch: [len(x.ids) for x in model.encode_batch_fast(batch, add_special_tokens=False)]


def splits(path: str) -> bool:
    """Whether SAFE holds for the file: it does for byte-level pre-tokenizers without a normalizer."""
    if not path.endswith(".json"):
        return False
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])


def count_tokens(batch: list[str], path: str, memo: dict[str, int]) -> list[int]:
    """Token counts of the texts; memo carries counted pieces from call to call and is emptied when full."""
    count = counter(path)
    if not splits_cached(path):
        return count(batch)
    if len(memo) > KEPT:
        memo.clear()
    pieces = [SAFE.split(t) for t in batch]
    fresh = [p for p in set().union(*pieces) if p not in memo]
    for a, b in balanced([len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass")) for p in fresh], BATCH):
        memo.update(zip(fresh[a:b], count(fresh[a:b])))
    return [sum(map(memo.__getitem__, p)) for p in pieces]


splits_cached = functools.lru_cache(maxsize=4)(splits)


def with_token_counts(docs: DataFrame, path: str, *keep: str, limit: int = LIMIT) -> DataFrame:
    """The kept columns with n_bytes, n_tokens and over_limit. Null and empty texts count 0."""
    bound_batches(docs.sparkSession)
    rows = texts(docs, *keep)
    more = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for b in batches:
            column = b.column(b.num_columns - 1)
            sizes = pa.compute.binary_length(column).to_pylist()
            for i, j in balanced(sizes, BATCH):
                n = count_tokens(column.slice(i, j - i).to_pylist(), path, memo)
                made = batch_of({"n_bytes": sizes[i:j], "n_tokens": n, "over_limit": [x > limit for x in n]}, more)
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made.columns], names=[*b.schema.names[:-1], *more.names])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in rows.dtypes[:-1]], "n_bytes bigint, n_tokens bigint, over_limit boolean"])
    return rows.mapInArrow(count, schema)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, n_bytes, n_tokens, over_limit. Null and empty texts count 0; null ids and
    repeated rows stay.
    """
    return with_token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), "doc_id")


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op7_token_counts": op7_token_counts}

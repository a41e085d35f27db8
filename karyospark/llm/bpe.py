"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes before each white space decides where a text is cut, so that passages which
documents share fall into the same chunks wherever they stand. Within a task a chunk is encoded once, however
many documents hold it, and a chunk is made of words that are encoded once too. Where two chunks meet, the
words around the seam are encoded together; if that differs from the chunks' own tokens the window grows until
both agree, and in the worst case the two chunks are encoded as one.

Which chunks documents share is counted over the whole corpus by their hashes. The chunks that save the most, up to
a fixed number of bytes, are encoded once for all and sent to every task; all others are encoded once per task and
kept in bounded caches. Moving every chunk's tokens back to all its documents would shuffle more bytes than the texts.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import balanced, bound_batches, table, texts
from .token_counts import vocabulary

#: A white space is a cut where the top bits of the hash of the eight bytes before it are zero: one in 128.
CUT_BITS = 7
MIX = np.uint64(0x9E3779B97F4A7C15)
WINDOW = 8
#: Bytes of the texts handled at a time, of the chunks kept, and words and seams kept.
BATCH = 5 << 18
KEPT_BYTES = 16 << 20
KEPT_WORDS = 250_000
KEPT_SEAMS = 100_000
#: Shared chunks that are encoded once for the whole corpus: their number, and bytes of their texts.
SHARED = 10_000
SHARED_BYTES = 4 << 20
#: ASCII marks: a run of them after letters, up to a word's end, is a token apart. The apostrophe isn't one of them.
PLAIN = b".,!?;:$%&#*|<>()[]{}\"-_/\\+=~^@`"
#: What only a special token may begin with; such chunks keep their case.
SPECIAL = b"<|"
#: Bytes of words encoded at a time.
BLOCK = 1 << 15


def cuts(raw: bytes) -> list[int]:
    """Content-defined cuts of the text: ascending, from 0 to its length."""
    if len(raw) <= WINDOW:
        return [0, len(raw)]
    byte = np.frombuffer(raw, np.uint8)
    white = np.flatnonzero((byte == 32) | ((byte >= 9) & (byte <= 13)))
    white = white[white >= WINDOW]
    before = np.ndarray((len(raw) - WINDOW + 1,), "<u8", raw, strides=(1,))[white - WINDOW]
    chosen = white[(before * MIX) >> np.uint64(64 - CUT_BITS) == 0]
    return [0, *chosen.tolist(), len(raw)]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return model


class Encoder:
    """Encodes and decodes texts by chunks; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, shared: dict[bytes, tuple[bytes, str]] | None = None):
        self.model = tokenizer(path)
        self.shared = shared or {}
        self.words: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, tuple[bytes, str]] = {}
        self.seams: dict[tuple[bytes, bytes, bytes], bool] = {}
        self.size = 0
        names = sorted(self.model.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.last = np.zeros(names[-1][1] + 1, bool)
        self.last[[i for x, i in names if x.endswith("</w>")]] = True
        self.encoded = 0
        self.reused = 0

    def directly(self, parts: list[bytes]) -> list[bytes]:
        """The library's ids of the parts."""
        got = self.model.encode_batch_fast([p.decode("utf-8", "surrogatepass") for p in parts], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in got]

    def told(self, ids: list[bytes]) -> list[tuple[bytes, str]]:
        """The ids with the library's decoded texts."""
        return list(zip(ids, self.model.decode_batch([np.frombuffer(i, "<u4").tolist() for i in ids], skip_special_tokens=False)))

    def learn(self, words: set[bytes]) -> None:
        """Encodes words not yet known.

        A word's letters and the plain marks after them are tokens apart. Many letter runs are encoded at a
        time: each gives exactly one token that ends a word, which parts them again; where the number of those is
        another one, and for all other words, the library gets each word by itself. So it does where what stands
        before the marks ends in another mark, which would join them, or where both may be a special token.
        """
        fresh = [(w, c, w[len(c) :]) for w in words if w not in self.words for c in (w.rstrip(PLAIN),)]
        letters = [r for r in {c for _, c, _ in fresh} if r and r not in self.words and (r.isalpha() or r.decode("utf-8", "surrogatepass").isalpha())]
        self.alone([m for m in {m for _, _, m in fresh} if m and m not in self.words])
        for a, b in balanced([len(r) + 1 for r in letters], BLOCK):
            block = letters[a:b]
            ids = self.directly([b" ".join(block)])[0]
            ends = np.flatnonzero(self.last[np.frombuffer(ids, "<u4")]) + 1
            if len(ends) != len(block):
                self.alone(block)
                continue
            at = (4 * ends).tolist()
            self.words.update(zip(block, [ids[i:j] for i, j in zip([0, *at], at)]))
        rest = []
        for w, c, m in fresh:
            x = self.words.get(c) if c else b""
            if x is None or (m and c and not self.parts(w, c)):
                rest.append(w)
            elif m:
                self.words[w] = x + self.words[m]
        self.alone([w for w in rest if w not in self.words])

    @staticmethod
    def parts(word: bytes, before: bytes) -> bool:
        """Whether the marks after the word's part before them are tokens apart: it ends in a letter or digit, and both make no special token.

        The tokenizer lower-cases first, and a capital letter may become a letter and a mark, which joins those that follow.
        """
        return SPECIAL not in word and before.decode("utf-8", "surrogatepass").lower()[-1].isalnum()

    def alone(self, words: list[bytes]) -> None:
        for a, b in balanced([len(w) for w in words], BATCH):
            self.words.update(zip(words[a:b], self.directly(words[a:b])))

    def compose(self, chunks: list[bytes]) -> list[tuple[bytes, str]]:
        """Ids and decoded texts of chunks from their words, which white space keeps apart; case makes no difference."""
        split = [(c if SPECIAL in c else c.lower()).split() for c in chunks]
        self.learn(set().union(*split))
        return self.told([b"".join([self.words[w] for w in words]) for words in split])

    def seam(self, left: bytes, right: bytes) -> tuple[bytes, bytes, bytes] | None:
        """The words next to the seam and what stands between them; None where there is no word."""
        a, b = left.rsplit(None, 1)[-1:], right.split(None, 1)[:1]
        if not a or not b:
            return None
        return a[0].rstrip(), left[len(left.rstrip()) :] + right[: len(right) - len(right.lstrip())], b[0].rstrip()

    def check(self, seams: list[tuple[bytes, bytes, bytes]]) -> None:
        """Encodes the words around each new seam together and notes whether that gives the words' own tokens."""
        if len(self.seams) > KEPT_SEAMS:
            self.seams.clear()
        fresh = list({s for s in seams if s not in self.seams})
        self.learn({w for a, _, b in fresh for w in (a, b)})
        for s, ids in zip(fresh, self.directly([b"".join(s) for s in fresh])):
            self.seams[s] = ids == self.words[s[0]] + self.words[s[2]]

    def agrees(self, left: bytes, right: bytes) -> bool:
        """Whether the two chunks' tokens simply follow each other."""
        s = self.seam(left, right)
        if s is None:
            return True
        if s not in self.seams:
            self.check([s])
        return self.seams[s]

    def repaired(self, chunks: list[bytes]) -> list[bytes]:
        """Chunks whose tokens simply follow each other: those that don't agree at a seam become one."""
        out = chunks[:1]
        for c in chunks[1:]:
            if self.agrees(out[-1], c):
                out.append(c)
            else:
                out[-1] += c
                if self.known(out[-1]) is None:
                    self.chunks[out[-1]] = self.told(self.directly([out[-1]]))[0]
        return out

    def known(self, chunk: bytes) -> tuple[bytes, str] | None:
        return self.shared.get(chunk) or self.chunks.get(chunk)

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, str]]:
        """Ids and decoded text of each text."""
        if self.size > KEPT_BYTES:
            self.chunks.clear()
            self.size = 0
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
            self.chunks.clear()
            self.size = 0
        cut = []
        for raw in texts:
            at = cuts(raw)
            cut.append([raw[i:j] for i, j in zip(at, at[1:])])
        fresh = list({c for chunks in cut for c in chunks if c not in self.chunks and c not in self.shared})
        self.encoded += len(fresh)
        self.reused += sum(map(len, cut)) - len(fresh)
        for c, made in zip(fresh, self.compose(fresh)):
            self.chunks[c] = made
            self.size += len(c) + len(made[0]) + len(made[1]) + 300
        self.check([s for chunks in cut for x, y in zip(chunks, chunks[1:]) if (s := self.seam(x, y)) is not None])
        out = []
        for chunks in cut:
            got = [self.known(c) for c in self.repaired(chunks)]
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[0]])))
        return out


def shared_chunks(docs: DataFrame, path: str, most: int = SHARED, most_bytes: int = SHARED_BYTES) -> dict[bytes, tuple[bytes, str]]:
    """Ids and decoded text of the chunks whose reuse saves the most bytes over all documents.

    Chunks are counted by hash, each with the hash of one text that holds it, so that the second scan cuts only
    the texts that the chosen chunks come from. What reaches the driver is bounded by most and most_bytes.
    """
    bound_batches(docs.sparkSession)
    rows = texts(docs).select(F.xxhash64("text").alias("owner"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[int, list[int]] = {}
            for owner, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                at = cuts(text)
                for h, size in {(xxhash.xxh3_64_intdigest(text[i:j]) - (1 << 63), j - i) for i, j in zip(at, at[1:])}:
                    entry = seen.setdefault(h, [0, size, owner])
                    entry[0] += 1
                    entry[2] = min(entry[2], owner)
            columns = [pa.array(seen.keys(), pa.int64()), *[pa.array([e[k] for e in seen.values()], pa.int64()) for k in range(3)]]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "n", "size", "owner"])

    counted = rows.mapInArrow(count, "h bigint, n bigint, size bigint, owner bigint").groupBy("h").agg(F.sum("n").alias("n"), F.min("size").alias("size"), F.min("owner").alias("owner"))
    saved = ((F.col("n") - 1) * F.col("size")).alias("saved")
    best = counted.where("n > 1").select("h", "size", "owner", saved).orderBy(F.desc("saved"), "h").limit(most).collect()
    kept = np.cumsum([r["size"] for r in best]) <= most_bytes if best else []
    chosen = [r for r, k in zip(best, kept) if k]
    if not chosen:
        return {}
    wanted = {r["h"] for r in chosen}
    owners = docs.sparkSession.createDataFrame([(r,) for r in sorted({r["owner"] for r in chosen})], "its_owner bigint")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, done = Encoder(path), set()
        for b in batches:
            got: list[bytes] = []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                at = cuts(text)
                for i, j in zip(at, at[1:]):
                    h = xxhash.xxh3_64_intdigest(text[i:j]) - (1 << 63)
                    if h in wanted and h not in done:
                        done.add(h)
                        got.append(text[i:j])
            made = coder.encode(got)
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.string())], names=["chunk", "ids", "told"])

    found = rows.join(F.broadcast(owners), rows["owner"] == owners["its_owner"], "left_semi").mapInArrow(take, "chunk binary, ids binary, told string")
    return {bytes(r["chunk"]): (bytes(r["ids"]), r["told"]) for r in found.groupBy("chunk").agg(F.first("ids").alias("ids"), F.first("told").alias("told")).collect()}


def encoded(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """The kept columns with ids (binary, 32 bits each), n_tokens and decoded, the decoded text.

    Null and empty texts have no ids and decode to the empty text.
    """
    bound_batches(docs.sparkSession)
    rows = texts(docs, *keep)
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(path, shared.value)
        for b in batches:
            column = b.column(b.num_columns - 1)
            for i, j in balanced(pa.compute.binary_length(column).to_pylist(), BATCH):
                part = b.slice(i, j - i)
                got = coder.encode(part.column(b.num_columns - 1).cast(pa.binary()).to_pylist())
                made = [pa.array([g[0] for g in got], pa.binary()), pa.array([len(g[0]) // 4 for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*b.schema.names[:-1], "ids", "n_tokens", "decoded"])

    return rows.mapInArrow(encode, ", ".join([*[f"`{c}` {t}" for c, t in rows.dtypes[:-1]], "ids binary, n_tokens bigint, decoded string"]))


def decoded(rows: DataFrame, path: str, *keep: str) -> DataFrame:
    """The kept columns and text, decoded from ids as encoded() gives them; null ids give the empty text."""
    bound_batches(rows.sparkSession)
    rows = rows.select(*keep, F.coalesce("ids", F.lit(b"")).alias("ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        for b in batches:
            ids = [np.frombuffer(x.as_py(), "<u4").tolist() for x in b.column(b.num_columns - 1)]
            text = pa.array(model.decode_batch(ids, skip_special_tokens=False), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], text], names=[*b.schema.names[:-1], "text"])

    return rows.mapInArrow(decode, ", ".join([*[f"`{c}` {t}" for c, t in rows.dtypes[:-1]], "text string"]))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, n_tokens and the digests of ids and decoded text. Null and empty texts have
    no ids and the digests of nothing; null ids and repeated rows stay. Of chunks that save equally many bytes the one of
    the smaller hash is shared; which are shared changes no ids.
    """
    rows = encoded(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), "doc_id")
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op3_bpe": op3_bpe}

"""License scans by diagonal voting.

All rolling hashes of a document's word k-grams are joined to the places where they stand in the license
templates. A match at document place p and template place q votes for the diagonal p - q; a copied text puts
its votes on few neighbouring diagonals, edits move it from one to the next. Votes are counted per diagonal,
neighbouring diagonals are merged to spans as long as they are near each other in the text too, and each span is
verified by its words: the longest common subsequence with the template's words has to hold most of the template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, checkpoint, table, texts

# Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Words of a k-gram; how far apart diagonals are merged; the share of a template's k-grams that a span must hold to be
#: verified, and the share of its words that it must hold in order.
K = 4
GAP = 4
VOTED = 0.35
COVER = 0.75
LONGEST_ROWS = 1 << 15

# License texts and notices as published, without title, copyright line and marks. A label of the method is
# "notice:" and the name. Longer texts come from a folder, see read_templates().
TEMPLATES = {
    "mit": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights
        to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to
        whom the software is furnished to do so subject to the following conditions the above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the software the software is provided as
        is without warranty of any kind express or implied including but not limited to the warranties of merchantability
        fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for
        any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in
        connection with the software or the use or other dealings in the software""",
    "mit-grant": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction""",
    "bsd-2-clause": """redistribution and use in source and binary forms with or without modification are permitted provided that
        the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of
        conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice
        this list of conditions and the following disclaimer in the documentation and or other materials provided with the
        distribution this software is provided by the copyright holders and contributors as is and any express or implied
        warranties including but not limited to the implied warranties of merchantability and fitness for a particular
        purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect
        incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or
        services loss of use data or profits or business interruption however caused and on any theory of liability whether
        in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this
        software even if advised of the possibility of such damage""",
    "bsd-3-clause-endorsement": """neither the name of the copyright holder nor the names of its contributors may be used to endorse
        or promote products derived from this software without specific prior written permission""",
    "isc": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies the software is provided as
        is and the author disclaims all warranties with regard to this software including all implied warranties of
        merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential
        damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract
        negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    "zlib": """this software is provided as is without any express or implied warranty in no event will the authors be held liable
        for any damages arising from the use of this software permission is granted to anyone to use this software for any
        purpose including commercial applications and to alter it and redistribute it freely subject to the following
        restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original
        software if you use this software in a product an acknowledgment in the product documentation would be appreciated
        but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being
        the original software 3 this notice may not be removed or altered from any source distribution""",
    "unlicense": """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use
        compile sell or distribute this software either in source code form or as a compiled binary for any purpose
        commercial or non commercial and by any means""",
    "apache-2.0-notice": """licensed under the apache license version 2 0 the license you may not use this file except in compliance
        with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by
        applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        without warranties or conditions of any kind either express or implied see the license for the specific language
        governing permissions and limitations under the license""",
    "gpl-notice": """this program is free software you can redistribute it and or modify it under the terms of the gnu general public
        license as published by the free software foundation either version 3 of the license or at your option any later
        version this program is distributed in the hope that it will be useful but without any warranty without even the
        implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more
        details""",
    "mpl-2.0-notice": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
        distributed with this file you can obtain one at http mozilla org mpl 2 0""",
    "cc-by-4.0-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc0-notice": """the person who associated a work with this deed has dedicated the work to the public domain by waiving all of
        his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent
        allowed by law""",
}

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    """The text's words, A-Z lower-cased: runs of digits, letters and all beyond ASCII."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


MULTIPLIER = 0x9E3779B97F4A7C15


def rolling(words: list[bytes], k: int = K) -> np.ndarray:
    """The polynomial hash of each run of k words."""
    if len(words) < k:
        return np.zeros(0, np.int64)
    one = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    n = len(words) - k + 1
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * np.uint64(MULTIPLIER) + one[i : i + n]
    return total.view(np.int64)


def marks(words: list[bytes]) -> np.ndarray:
    """A number of 32 bits for each word, by which spans are verified."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) & 0x7FFFFFFF for w in words), np.int32, len(words))


def phrase_places(words: list[bytes]) -> list[tuple[int, int]]:
    """(place, phrase) of every base phrase, by place."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for i, (phrase, _) in enumerate(PHRASES):
        needle = b" " + phrase.encode() + b" "
        at, place, counted = joined.find(needle), 0, 0
        while at >= 0:
            place += joined.count(b" ", counted, at)
            counted = at
            found.append((place, i))
            at = joined.find(needle, at + 1)
    return sorted(found)


def read_templates(spark: SparkSession, path: str) -> dict[str, str]:
    """Templates from a folder of license texts, whole ones too, by the files' names without their endings."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[a-zA-Z]+)?$", 1).alias("name"), "value")
    return {r["name"]: r["value"] for r in rows.collect()}


def places(templates: dict[str, str]) -> list[tuple[int, str, int, int]]:
    """(hash, template, place, k-grams of the template) of all templates; their number is fixed by the templates."""
    out = []
    for name, text in templates.items():
        hashes = rolling(words_of(text))
        out += [(int(h), name, q, len(hashes)) for q, h in enumerate(hashes)]
    return out


def matched(docs: DataFrame, templates: dict[str, str], *keep: str) -> DataFrame:
    """Rows of two kinds: one with at null for each document (kept columns, words, phrase places, and where any k-gram may
    match its words' marks), and one for each match of a k-gram (row, at, template, place, size).

    All k-grams of all documents meet the templates' in a broadcast join, of the templates' fixed size.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = texts(docs, *keep).withColumn("row", F.monotonically_increasing_id()).select(*keep, "row", "text")
    kinds = rows.select(*keep).schema
    pairs = pa.list_(pa.struct([("p", pa.int32()), ("f", pa.int32())]))
    more = [("words", pa.int64()), ("hits", pairs), ("marks", pa.list_(pa.int32())), ("at", pa.int32()), ("h", pa.int64())]
    listed = places(templates)
    hashes_known = np.unique(np.array([x[0] for x in listed], np.int64))

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.select([*keep, "row"])
            got, grams, held = [], [], []
            for i, x in enumerate(b.column(b.num_columns - 1)):
                words = words_of(x.as_py())
                got.append((len(words), [{"p": p, "f": f} for p, f in phrase_places(words)]))
                grams.append(rolling(words))
                held.append(marks(words) if np.isin(grams[-1], hashes_known).any() else None)
            n = b.num_rows
            made = [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pairs), pa.array(held, more[2][1]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())]
            names = [*own.schema.names, *[m[0] for m in more]]
            yield pa.RecordBatch.from_arrays([*own.columns, *made], names=names)
            sizes = np.array([len(g) for g in grams])
            where = np.repeat(np.arange(n), sizes)
            at = np.concatenate([np.arange(s) for s in sizes] or [np.zeros(0)]).astype(np.int32)
            hashes = np.concatenate(grams or [np.zeros(0, np.int64)])
            row = own.column(len(keep)).to_numpy()[where] if n else np.zeros(0, np.int64)
            for i in range(0, len(where), LONGEST_ROWS):
                m = len(where[i : i + LONGEST_ROWS])
                blank = [pa.nulls(m, c.type) for c in own.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*blank, pa.array(row[i : i + m]), pa.nulls(m, pa.int64()), pa.nulls(m, pairs), pa.nulls(m, more[2][1]), pa.array(at[i : i + m]), pa.array(hashes[i : i + m])], names=names)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kinds], "row bigint, words bigint, hits array<struct<p:int, f:int>>, marks array<int>, at int, h bigint"])
    known = spark.createDataFrame(listed, "known bigint, template string, place int, size int")
    joined = rows.mapInArrow(gram, schema).join(F.broadcast(known), F.col("h") == F.col("known"), "left")
    return joined.where("at is null or template is not null").drop("h", "known")


def spans(matches: DataFrame, gap: int = GAP, voted: float = VOTED) -> DataFrame:
    """Spans to verify (row, template, first, last) from matches (row, at, template, place, size); last is a k-gram's place.

    Votes are counted by diagonal. Diagonals at most gap apart that are within a template's length of each other in the
    text are one span, which must hold the share voted of the template's k-grams.
    """
    votes = matches.groupBy("row", "template", "size", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set("place").alias("places"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = ((F.col("diagonal") - F.lag("diagonal").over(order)) > gap) | (F.greatest(F.col("first") - F.lag("last").over(order), F.lag("first").over(order) - F.col("last")) > F.col("size"))
    joined = votes.withColumn("fresh", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("fresh").over(order))
    merged = joined.groupBy("row", "template", "size", "span").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"))
    return merged.where(F.col("held") >= voted * F.col("size")).select("row", "template", "first", "last")


def common(a: list[int], b: list[int]) -> int:
    """The length of the longest common subsequence; a bit for each word of a says where a column of its table rises."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        same = row & at.get(x, 0)
        row = ((row + same) | (row - same)) & full
    return len(a) - row.bit_count()


def verified(words: list[int], template: list[int], first: int, last: int, cover: float = COVER) -> list[tuple[int, int, float]]:
    """(first word, last word, score) of the parts of a span that hold the template; the score is the share of its words.

    Only words from one of the template's k-grams to another count as a part, and a part is at most half as long again
    as the template, so that pieces of many repeated notices don't add up to a whole one.
    """
    grams = {tuple(template[q : q + K]) for q in range(len(template) - K + 1)}
    limit, parts = len(template) + len(template) // 2, []
    for p in range(first, last + 1):
        if tuple(words[p : p + K]) in grams:
            if parts and p + K - parts[-1][0] <= limit:
                parts[-1][1] = p + K - 1
            else:
                parts.append([p, p + K - 1])
    scored = [(a, b, common(template, words[a : b + 1]) / len(template)) for a, b in parts]
    return [x for x in scored if x[2] >= cover]


NOTICE = "struct<first:int, last:int, template:string, score:double>"


def licensed(docs: DataFrame, *keep: str, templates: dict[str, str] | None = None) -> DataFrame:
    """Each row's kept columns, words, hits (base places), notices (verified spans) and score.

    The score is the best span's, or 1 where a base phrase stands; 0 without either. Null texts have none.
    """
    templates = TEMPLATES if templates is None else templates
    found = checkpoint(matched(docs, templates, *keep))
    wanted = spans(found.where("at is not null").select("row", "at", "template", "place", "size"))
    by_row = wanted.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "last", "template"))).alias("wanted"))
    rows = found.where("at is null").select(*keep, "row", "words", "hits", "marks").join(by_row, "row", "left").select(*keep, "words", "hits", "marks", "wanted")
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("template", pa.string()), ("score", pa.float64())]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {name: marks(words_of(text)).tolist() for name, text in templates.items()}
        for b in batches:
            n = b.num_columns
            made = []
            for own, spans_of in zip(b.column(n - 2), b.column(n - 1)):
                passed = set()
                if spans_of.is_valid:
                    words = own.values.to_numpy().tolist()
                    for x in spans_of.as_py():
                        passed |= {(s, e, x["template"], score) for s, e, score in verified(words, known[x["template"]], x["first"], x["last"])}
                made.append([{"first": s, "last": e, "template": t, "score": c} for s, e, t, c in sorted(passed)] or None)
            yield pa.RecordBatch.from_arrays([*b.columns[: n - 2], pa.array(made, kind)], names=[*b.schema.names[: n - 2], "notices"])

    rows = rows.mapInArrow(verify, ", ".join([*[f"`{c}` {t}" for c, t in rows.dtypes[:-2]], f"notices array<{NOTICE}>"]))
    score = F.when(F.size("hits") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("notices.score"), F.lit(0.0)))
    return rows.select(*keep, "words", "hits", "notices", score.alias("score"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, n_words, the base places and labels, all labels and the score. Null and
    empty texts have no words, labels or score; null ids stay, repeated rows stay, and notices that overlap all count.
    """
    rows = licensed(table(spark, sf_dir, "documents"), "doc_id")
    names = F.array(*[F.lit(x) for _, x in PHRASES])
    base = F.array_sort(F.array_distinct(F.transform("hits", lambda x: F.get(names, x["f"]))))
    own = F.transform(F.coalesce("notices", F.expr("array()").cast(f"array<{NOTICE}>")), lambda x: F.concat(F.lit("notice:"), x["template"]))
    return rows.select(
        "doc_id",
        F.col("words").alias("n_words"),
        F.size("hits").cast("bigint").alias("n_base"),
        F.array_min(F.col("hits.p")).cast("bigint").alias("first_word"),
        F.array_max(F.col("hits.p")).cast("bigint").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        "score",
    )


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op6_licenses": op6_licenses}

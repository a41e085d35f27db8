"""HTML extraction by consensus host paths.

Every page scores its own containers and votes for the one that holds its text most tightly. Containers go by their
path of tags and classes, generalised so that numbers don't tell pages apart, and votes are counted over all pages of
a host. The host's winning path then says which containers each page is extracted from; a page that lacks it falls
back on its own best container. Reading a page takes time in proportion to its length, however it is malformed.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, checkpoint, table

#: A container stands for its parent if it has at least this share of the parent's score.
TIGHT = 0.8
#: The size up to which winning paths are broadcast; beyond it pages join them by host and one of so many salts.
BROADCAST_BYTES = 16 << 20
SALTS = 64

TAG = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)|!--|[!?])")
#: What ends a tag, or begins a quoted value in it.
END = re.compile(r""">|=\s*(["'])""")
ATTRIBUTE = re.compile(r"""(?<![\w:-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
#: A slash that closes its own tag, not one that ends an unquoted value.
CLOSED = re.compile(r"""(?:\A|[\s"'])/\Z""")
#: Elements whose contents aren't read, and those of them that run to the page's end if nothing closes them.
RAW = frozenset("script style title textarea noscript template svg iframe object select math canvas video audio".split())
TO_THE_END = frozenset("script style title textarea".split())
CLOSING = {tag: re.compile(rf"</{tag}(?![a-zA-Z0-9:-])[^>]*>?", re.IGNORECASE) for tag in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body center dd div main section table td tbody".split())
#: An element that starts closes these, if one of them is the innermost open block.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SKIP_TAGS = frozenset("nav header footer aside form button input label menu dialog head fieldset".split()) | RAW
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
SKIP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus"
    " footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promoted"
    " promotion related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
NEVER_BY_CLASS = frozenset("html body main article".split())


def boilerplate(tag: str, names: str, role: str) -> bool:
    """Whether an element is a menu, header, footer, sidebar, notice, advert, form or reader comments."""
    if tag in SKIP_TAGS or role in SKIP_ROLES:
        return True
    if tag in NEVER_BY_CLASS:
        return False
    for name in names.lower().split():
        part = re.split(r"[^a-z]+", name)
        part = [p for p in part if p]
        if part and part[0] not in ("has", "with", "no", "without") and (part[0] in SKIP_WORDS or part[-1] in SKIP_WORDS):
            return True
    return False


@functools.lru_cache(maxsize=1 << 14)
def kind(tag: str, names: str, ident: str, role: str) -> tuple[bytes, bool]:
    """The element's step in a path, with numbers in its classes generalised, and whether it is boilerplate."""
    own = ".".join([tag, *sorted(re.sub(r"\d+", "#", x) for x in names.lower().split())[:3]])
    return own.encode("utf-8", "surrogatepass"), boilerplate(tag, names + " " + ident, role.lower())


class Page:
    """A page's elements and pieces of text, in page order. A path is the hash of an element's step and its parent's path."""

    def __init__(self, html: str):
        self.tag, self.parent, self.path, self.skip, self.link, self.last = ["#"], [-1], [0], [False], [False], [0]
        self.pieces: list[tuple[int, int, str]] = []
        self.html, self.block = html, 0
        # open elements; the places in that list of each tag and of all blocks
        self.stack, self.places, self.blocks = [0], {}, []
        self.next_end, self.plain, self.unclosed = -2, False, set()
        self.read()
        self.close(0)

    def text_piece(self, piece: str) -> None:
        if piece:
            self.pieces.append((self.stack[-1], self.block, unescape(piece) if "&" in piece else piece))

    def close(self, k: int) -> None:
        """Closes the open elements from place k on."""
        for n in reversed(self.stack[max(k, 1) :]):
            self.last[n] = len(self.tag) - 1
            self.places[self.tag[n]].pop()
            if self.tag[n] in BLOCK:
                self.blocks.pop()
        if not k:
            self.last[0] = len(self.tag) - 1
        del self.stack[max(k, 1) :]

    def leave(self, these: set[str]) -> None:
        """Closes the innermost open block if it is one of these, or the one around an open paragraph."""
        for k in reversed(self.blocks[-2:]):
            tag = self.tag[self.stack[k]]
            if tag in these:
                self.close(k)
                return
            if tag != "p":
                return

    def end_of_tag(self, at: int) -> int:
        """Where the tag that is open at this place ends, past quoted values; -1 if it doesn't.

        Once a quoted value runs out of the page, quotes count no more in the rest of it; so no part is read twice.
        """
        if -1 != self.next_end < at:
            self.next_end = self.html.find(">", at)
        first = self.next_end
        if first < 0 or self.plain:
            return first
        while m := END.search(self.html, at):
            if not m[1]:
                return m.start()
            at = self.html.find(m[1], m.end()) + 1
            if not at:
                break
        self.plain = True
        return first

    def read(self) -> None:
        html, at, search = self.html, 0, 0
        while m := TAG.search(html, search):
            tag = m[2]
            if tag is None and m[0] == "<!--":
                self.text_piece(html[at : m.start()])
                end = html.find("-->", m.end())
                at = search = len(html) if end < 0 else end + 3
                continue
            end = self.end_of_tag(m.end())
            if end < 0:
                break
            self.text_piece(html[at : m.start()])
            at = search = end + 1
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                self.ended(tag)
                continue
            if tag in RAW and tag not in self.unclosed:
                closing = CLOSING[tag].search(html, at)
                if closing or tag in TO_THE_END:
                    self.text_piece(" ")
                    at = search = closing.end() if closing else len(html)
                    continue
                self.unclosed.add(tag)
            self.started(tag, html[m.end() : end])
        self.text_piece(html[at:])

    def ended(self, tag: str) -> None:
        if tag == "br":
            self.text_piece(" ")
            return
        open_ones = self.places.get(tag)
        if tag in BLOCK:
            if open_ones:
                self.close(open_ones[-1])
            self.block += 1
        elif open_ones and (not self.blocks or open_ones[-1] > self.blocks[-1]):
            self.close(open_ones[-1])

    def started(self, tag: str, rest: str) -> None:
        if tag in VOID:
            if tag == "br":
                self.text_piece(" ")
            self.block += tag in BLOCK
            return
        if tag in BLOCK:
            self.block += 1
            if self.blocks and self.tag[self.stack[self.blocks[-1]]] == "p":
                self.close(self.blocks[-1])
        if tag in CLOSES:
            self.leave(CLOSES[tag])
        attributes = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(rest)} if "=" in rest else {}
        step, skipped = kind(tag, attributes.get("class", ""), attributes.get("id", ""), attributes.get("role", ""))
        up = self.stack[-1]
        self.tag.append(tag)
        self.parent.append(up)
        self.path.append(xxhash.xxh64_intdigest(step, self.path[up]))
        self.skip.append(self.skip[up] or skipped)
        self.link.append(self.link[up] or tag == "a")
        self.last.append(len(self.tag) - 1)
        if tag in BLOCK or not CLOSED.search(rest):
            k = len(self.stack)
            self.places.setdefault(tag, []).append(k)
            if tag in BLOCK:
                self.blocks.append(k)
            self.stack.append(len(self.tag) - 1)

    def best(self) -> int | None:
        """The container that holds the page's text most tightly, None where there is no text outside links.

        A container's score is its text outside links less that inside links; boilerplate doesn't count. From the
        whole page on, the best container inside stands for the one around it as long as it has most of its score;
        an article stands for itself.
        """
        score = [0] * len(self.tag)
        for n, _, piece in self.pieces:
            if not self.skip[n] and (size := len(piece.strip())):
                score[n] += -size if self.link[n] else size
        for n in range(len(self.tag) - 1, 0, -1):
            score[self.parent[n]] += score[n]
        around, inner = [0] * len(self.tag), {}
        for n in range(1, len(self.tag)):
            up = self.parent[n]
            around[n] = up if not up or self.tag[up] in CONTAINERS else around[up]
            if self.tag[n] in CONTAINERS and not self.skip[n]:
                rival = inner.get(around[n])
                if rival is None or score[n] > score[rival]:
                    inner[around[n]] = n
        at = 0
        while self.tag[at] != "article" and at in inner and score[inner[at]] > 0 and score[inner[at]] >= TIGHT * score[at]:
            at = inner[at]
        return at if score[at] > 0 else None

    def text(self, elements: list[int]) -> str:
        """The text of the elements, ascending and apart, without boilerplate: blocks with single spaces, joined by line feeds."""
        out, now, parts = [], None, []
        for n, block, piece in self.pieces:
            k = bisect_right(elements, n) - 1
            if self.skip[n] or k < 0 or n > self.last[elements[k]]:
                continue
            if block != now:
                out.append(" ".join("".join(parts).split()))
                now, parts = block, []
            parts.append(piece)
        out.append(" ".join("".join(parts).split()))
        return "\n".join([x for x in out if x])

    def by_path(self, path: int) -> list[int]:
        """The outermost elements of this path that aren't boilerplate."""
        out: list[int] = []
        for n, own in enumerate(self.path):
            if own == path and not self.skip[n] and not (out and n <= self.last[out[-1]]):
                out.append(n)
        return out


def signed(path: int) -> int:
    return path - (1 << 64) if path >> 63 else path


def vote(html: str) -> int | None:
    """The path of the page's best container."""
    page = Page(html)
    best = page.best()
    return None if best is None else signed(page.path[best])


def extract(html: str, path: int | None) -> str:
    """The page's main text from the host's path, else from its own best container, else all that isn't boilerplate."""
    page = Page(html)
    if path is not None:
        got = page.text(page.by_path(path % (1 << 64)))
        if got:
            return got
    return page.text([page.best() or 0])


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path) with the most votes of each host's pages, one vote a page; of equal ones the smaller hash.

    Votes are summed per batch and partition first, so a host of many pages gathers in no task. Pages without a host
    vote for nothing.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select(host_of(pages["url"]).alias("host"), pages["html"].cast("string").alias("html")).where("html is not null and host <> ''")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tally: dict[tuple[str, int], int] = {}
            for host, html in zip(b.column(0).to_pylist(), b.column(1)):
                path = vote(html.as_py())
                if path is not None:
                    tally[host, path] = tally.get((host, path), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in tally], pa.string()), pa.array([k[1] for k in tally], pa.int64()), pa.array(tally.values(), pa.int64())], names=["host", "path", "votes"])

    counted = rows.mapInArrow(count, "host string, path bigint, votes bigint").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    best = counted.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("votes"), "path")).alias("best"))
    return best.select("host", F.col("best.path").alias("path"))


def extracted(pages: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and text, the main text of each page's html; a null or empty html has the empty text.

    Pages without a host go by their own best container; repeated pages stay repeated. Many winning paths are joined
    on the host and a salt, the number of the page's partition, so that a host of very many pages is no single key.
    """
    paths = checkpoint(winning_paths(pages))
    size = paths.agg(F.sum(F.length("host") + 8)).first()[0] or 0
    rows = pages.select(*[pages[c] for c in keep], host_of(pages["url"]).alias("its_host"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("its_html"))
    if size <= BROADCAST_BYTES:
        known = F.broadcast(paths.select("host", F.col("path").alias("its_path")))
        rows = rows.join(known, rows["its_host"] == known["host"], "left")
    else:
        rows = rows.withColumn("its_salt", F.spark_partition_id() % SALTS)
        known = paths.select("host", F.col("path").alias("its_path"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        rows = rows.join(known, (rows["its_host"] == known["host"]) & (rows["its_salt"] == known["salt"]), "left")
    rows = rows.select(*[rows[c] for c in keep], "its_path", "its_html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_columns
            got = [extract(h.as_py(), p.as_py()) for p, h in zip(b.column(n - 2), b.column(n - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[: n - 2], pa.array(got, pa.string())], names=[*b.schema.names[: n - 2], "text"])

    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {t}" for c, t in rows.dtypes[:-2]], "text string"]))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of pages: page_id, url, text and n_chars. Null and empty html give the empty text, null ids
    and urls stay, repeated pages stay repeated; ties of votes go to the smaller path hash.
    """
    return extracted(table(spark, sf_dir, "pages"), "page_id", "url").withColumn("n_chars", F.length("text").cast("bigint"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op8_html": op8_html}

"""Main text of pages, by deducing the template that pages of a host share.

Tokens of a page are its opening tags, each named by its path, and its blocks of
text, named by path and words. Tokens of a host with one occurrence vector over
its pages (the same number of times on each page) form an equivalence class.
Pages of a host that agree in their article count as one, so copies that differ
in an advert, a menu or a title do not make a template of their article. Classes
that are frequent (on at least half of these pages) and hold a tag are valid;
nested by the paths of their tags they are the template of the host.

The elements of the template that stand once on a page bound its slots: a slot is
what lies in one of them and in no inner one. How a slot is filled over the pages
of the host tells what it is. The article is in the innermost element that holds
most of the text outside links (of that in article and main elements, where the
host has them); slots beside it count as well if they hold a good part as much.
Slots of links are menus, slots with the same text on every page are headings of
the site, rights or notices, and small slots outside that element are adverts and
the like. What is left of those slots is the text, without blocks that belong to
the template or that the markup itself sets aside (menus, forms, hidden elements);
words in class and id only tell a minor part of the article, such as its comments.
A page on which nothing is left by its host's template is read by its own.

Occurrence vectors are never built: a vector is the exclusive or of a hash of
each page and count, so tokens of one class agree in it, and a host with a third
of all pages is aggregated in parts like any other.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import col, steps, utf8
from tabloom.llm.html_blocks import Block, Tag, digest, read
from tabloom.session import write_table

# different articles of a host that tell which slots are the same everywhere, and pages with a text that is template by itself
LEAST_PAGES, LEAST_TEXTS = 2, 4
# part of the text that the element of the article holds, and part of that which makes another slot one of the article
MOST, SOME = 0.7, 0.1
# part of a slot's text in links that makes it a menu
LINKS = 0.6
# text tokens of all templates up to which they are sent to every task; beyond, pages are joined by host
SENT_TOKENS = 1_000_000


def host_of(url: Column) -> Column:
    """Host of an address in lower case, empty for none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _text_token(block: Block) -> int:
    return digest(block.path, f"text {block.text}")


def _article(left: list[Block]) -> list[str]:
    """Texts of the article among blocks: those in it, or else all but links."""
    inside = [b.text for b in left if b.main and not b.spare] or [b.text for b in left if b.spare]
    return inside or [b.text for b in left if not b.linked]


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host and page of each page, and a hash of the blocks of its article as the markup tells it."""
    for whole in batches:
        for batch in steps(whole, "html"):
            found = []
            for html in utf8(batch.column("html")).to_pylist():
                texts = _article([b for b in read(html)[0] if not b.aside or b.spare])
                found.append(digest(len(texts), "\n".join(texts)))
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), pa.array(found, pa.int64())], ["host", "page", "content"])


@dataclass(slots=True)
class Filling:
    """What an element holds, with all inside it, on one page or summed over pages: characters by kind."""

    parent: int
    holder: bool = False
    pages: int = 1
    once: int = 1  # pages on which it stands once
    prose: int = 0  # outside links and what the markup sets aside
    links: int = 0
    worded: int = 0  # prose that labels set aside
    main: int = 0  # prose in article and main elements
    same: bool = True  # one text on all pages
    text: int = 0  # hash of it


def fillings(blocks: list[Block], tags: list[Tag]) -> dict[int, Filling]:
    """The elements of one page by path; 0 is the page."""
    out = {0: Filling(-1, True)}
    counts = Counter(t.path for t in tags)
    for tag in tags:
        if tag.path not in out:
            out[tag.path] = Filling(tag.parent, tag.holder, 1, int(counts[tag.path] == 1))
    for block in blocks:
        prose = 0 if block.aside and not block.worded else len(block.text) - block.links
        at = block.path
        while True:
            own = out[at]
            own.prose += prose
            own.links += block.links
            own.worded += prose if block.worded else 0
            own.main += prose if block.main else 0
            own.text = digest(own.text, block.text)
            if at == 0:
                break
            at = own.parent
    return out


def speechless(whole: Filling) -> bool:
    """Whether labels set nearly all text aside, and so tell nothing."""
    return whole.prose - whole.worded < 0.1 * whole.prose


def verdicts(found: dict[int, Filling], pages: int) -> dict[int, bool]:
    """Whether the slot of each element that bounds one belongs to the article, by path."""
    bounds = {p for p, f in found.items() if p == 0 or (2 * f.pages >= pages and 2 * f.once >= f.pages)}
    inner: dict[int, list[int]] = defaultdict(list)
    above: dict[int, int] = {}
    for path in bounds - {0}:
        up = found[path].parent
        while up not in bounds:
            up = found[up].parent if up in found else 0
        inner[up].append(path)
        above[path] = up
    whole = found[0]
    marked = whole.main >= 0.2 * whole.prose > 0
    if marked:
        measure = lambda f: f.main
    elif not speechless(whole):
        measure = lambda f: f.prose - f.worded
    else:
        measure = lambda f: f.prose
    total = measure(whole)
    centre = 0
    while total:
        further = [p for p in inner[centre] if measure(found[p]) >= MOST * total]
        if not further or not found[further[0]].holder:
            break
        centre = further[0]
    article = found[centre]
    towards = set()
    at = centre
    while at:
        at = above[at]
        towards.add(at)

    def menu(links: int, prose: int) -> bool:
        return links > 0 and links >= LINKS * (links + prose)

    def counts(f: Filling, prose: int, links: int, worded: int, main: int) -> bool:
        """Whether text outside the element of the article is part of it."""
        return prose >= max(1, SOME * article.prose) and not menu(links, prose) and 2 * worded < prose and (not marked or 2 * main >= prose)

    out: dict[int, bool] = {}
    left = [(0, centre == 0)]
    while left:
        path, inside = left.pop()
        f = found[path]
        site = f.same and pages >= LEAST_PAGES and f.pages >= LEAST_PAGES and 2 * f.main <= f.prose
        if path == centre:
            keep, below = True, True
        elif path in towards:  # around the article: what it holds beside its inner slots
            own = [sum(getattr(found[c], k) for c in inner[path]) for k in ("prose", "links", "worded", "main")]
            keep, below = counts(f, f.prose - own[0], f.links - own[1], f.worded - own[2], f.main - own[3]), False
        elif inside:
            keep = below = not site and not menu(f.links, f.prose)
        else:
            keep = below = not site and counts(f, f.prose, f.links, f.worded, f.main)
        out[path] = keep
        if keep or path in towards or path == centre:
            left.extend((p, below) for p in inner[path])
        else:  # all that it holds goes with it
            gone = list(inner[path])
            while gone:
                p = gone.pop()
                out[p] = False
                gone.extend(inner[p])
    return out


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each page: host, page, token, count, place of the first, parent, whether text, and what an element holds."""
    names = ["host", "page", "token", "n", "place", "parent", "is_text", "holder", "prose", "links", "worded", "main", "text"]
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] + [pa.bool_()] * 2 + [pa.int64()] * 5
    for whole in batches:
        for batch in steps(whole, "html"):
            out: list[list] = [[] for _ in names]
            hosts, pages = batch.column("host").to_pylist(), batch.column("page").to_pylist()
            for host, page, html in zip(hosts, pages, utf8(batch.column("html")).to_pylist()):
                blocks, tags = read(html)
                counts = Counter(t.path for t in tags)
                counts[0] = 1
                for place, (token, f) in enumerate(fillings(blocks, tags).items()):
                    row = (host, page, token, counts[token], place, f.parent, False, f.holder, f.prose, f.links, f.worded, f.main, f.text)
                    for column, value in zip(out, row):
                        column.append(value)
                texts = Counter()
                parents: dict[int, int] = {}
                for block in blocks:
                    token = _text_token(block)
                    texts[token] += 1
                    parents[token] = block.path
                for place, (token, count) in enumerate(texts.items()):
                    for column, value in zip(out, (host, page, token, count, place, parents[token], True, False, 0, 0, 0, 0, 0)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)


def templates(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The template of each host: a row per token of a valid class.

    Columns: host (hash), vector (names the class), token, parent (token of the
    element it lies in, -1 for the page itself), is_text, place (order among
    tokens of its kind), support (pages with different articles), whole (on all
    of these of the host), pages (their number), once (on how many it stands
    once), and of elements holder, prose, links, worded, main and same: what they
    hold, summed over the pages (``Filling``).
    """
    given = pages.select(
        F.xxhash64(host_of(col(url_col))).alias("host"), F.xxhash64(col(page_col), col(url_col), col(html_col)).alias("page"), col(html_col).alias("html")
    )
    contents = given.mapInArrow(_contents, "host long, page long, content long").groupBy("host", "content").agg(F.min("page").alias("page"))
    contents = write_table(contents, "contents")
    hosts = contents.groupBy("host").agg(F.count("*").alias("pages"))
    # one row of each different page, also where rows are repeated
    drawn = contents.select(F.col("host").alias("drawn_host"), F.col("page").alias("drawn_page"))
    drawn = given.join(drawn, (F.col("page") == F.col("drawn_page")) & (F.col("host") == F.col("drawn_host")), "left_semi")
    drawn = drawn.dropDuplicates(["host", "page"])
    schema = "host long, page long, token long, n int, place int, parent long, is_text boolean, holder boolean, prose long, links long, worded long, main long, text long"
    seen = drawn.mapInArrow(_tokens, schema).groupBy("host", "token").agg(
        F.count("*").alias("support"),
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"),
        F.min("place").alias("place"),
        F.min("parent").alias("parent"),
        F.bool_or("is_text").alias("is_text"),
        F.bool_or("holder").alias("holder"),
        F.count_if(F.col("n") == 1).alias("once"),
        *[F.sum(c).alias(c) for c in ("prose", "links", "worded", "main")],
        (F.min("text") == F.max("text")).alias("same"),
    )
    frequent = write_table(seen, "tokens").join(hosts, "host").where(F.col("support") * 2 >= F.col("pages"))
    frequent = write_table(frequent.withColumn("whole", F.col("support") >= F.col("pages")), "frequent")
    classes = frequent.groupBy("host", "support", "vector").agg(F.min("is_text").alias("only_text")).where("NOT only_text")
    return frequent.join(classes.drop("only_text"), ["host", "support", "vector"])


def _judged(table: pa.Table) -> pa.Table:
    """The slots of one host, told from what its elements hold."""
    rows = table.to_pylist()
    found = {
        r["token"]: Filling(r["parent"], r["holder"], r["support"], r["once"], r["prose"], r["links"], r["worded"], r["main"], r["same"])
        for r in rows
    }
    judged = verdicts(found, rows[0]["pages"]) if 0 in found else {}
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    worded = 0 in found and speechless(found[0])
    columns = [[rows[0]["host"]] * len(judged), list(judged), list(judged.values()), [worded] * len(judged)]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "path", "keep", "worded"])


@dataclass
class Known:
    """What is known of a host: its text tokens with place and whether they are on every page, and its slots."""

    texts: dict[int, tuple[int, bool]]
    slots: dict[int, bool]
    worded: bool = False  # labels set nearly all its text aside, and so tell nothing


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = Known({}, {})
    for whole in batches:
        for batch in steps(whole, "html"):
            texts, by_slot, by_markup = [], [], []
            names = batch.schema.names
            for html, known in zip(utf8(batch.column("html")).to_pylist(), batch.column("known").to_pylist()):
                host = none
                if known:
                    slots = known["slots"] or ()
                    host = Known({t["token"]: (t["place"], t["whole"]) for t in known["texts"] or ()}, {s["path"]: s["keep"] for s in slots}, any(s["worded"] for s in slots))
                kept, dropped, marked = main_blocks(html, host)
                texts.append("\n\n".join(kept))
                by_slot.append(dropped)
                by_markup.append(marked)
            index = [i for i, n in enumerate(names) if n not in ("html", "known")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in index], pa.array(texts, pa.string()), pa.array(by_slot, pa.int64()), pa.array(by_markup, pa.int64())],
                [*[names[i] for i in index], "text", "template_blocks", "markup_blocks"],
            )


def _sorted_out(blocks: list[Block], parents: dict[int, int], host: Known) -> tuple[list[Block], int, int]:
    """Blocks of the article by the slots of a host, and how many its template and the markup left out.

    A text token out of the template's order does not count on this page, nor
    inside an article or main element one that is not on every page or has text
    outside links: articles may share a paragraph. Blocks that are links alone
    belong to the article in such an element only.
    """
    left: list[Block] = []
    dropped = marked = 0
    last = -1
    for block in blocks:
        at = block.path
        while at and at not in host.slots:
            at = parents.get(at, 0)
        inside = host.slots.get(at, True)
        place, whole = host.texts.get(_text_token(block), (-1, False))
        repeated = place > last and (whole and block.linked or not block.main)
        if repeated:
            last = place
        if not inside or repeated or block.linked and not block.main:
            dropped += 1
        elif block.aside and (not block.worded or not host.worded):
            marked += 1
        else:
            left.append(block)
    return left, dropped, marked


def main_blocks(html: str, host: Known | None = None) -> tuple[list[str], int, int]:
    """Blocks of the main text of a page, and how many its template and its markup left out.

    Where the slots of the host leave nothing, or there are none, the page's own
    elements bound its slots; where these leave nothing either, the text is what
    the markup does not set aside.
    """
    blocks, tags = read(html)
    parents = {t.path: t.parent for t in tags}
    host = host or Known({}, {})
    if host.slots:
        left, dropped, marked = _sorted_out(blocks, parents, host)
        if left:
            return [b.text for b in left], dropped, marked
    own = fillings(blocks, tags)
    alone = Known({}, verdicts(own, 1), speechless(own[0]))
    left, dropped, marked = _sorted_out(blocks, parents, alone)
    if left:
        return [b.text for b in left], dropped, marked
    kept = _article([b for b in blocks if not b.aside or b.spare])
    return kept, 0, len(blocks) - len(kept)


def extract_text(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, template_blocks, markup_blocks.

    ``text`` has the blocks of the article in page order, joined by an empty
    line; character references are decoded and white space within a block is one
    space. It is empty if there is none, as for null or empty html.
    ``template_blocks`` were left out by the template of the host (or the page's
    own), ``markup_blocks`` by what the markup says of them alone. A null address
    is a host of its own. Rows are kept as they are, repeated ones and null ids
    included; copies of an article count once in the template. An empty table
    gives no rows. Other columns of ``pages`` are not read.
    """
    found = write_table(templates(pages, page_col, url_col, html_col), "classes")
    texts = found.where("is_text").where(F.col("support") >= LEAST_TEXTS)
    texts = texts.groupBy("host").agg(F.collect_list(F.struct("token", "place", "whole")).alias("texts"))
    # as many elements of a host as are on half of its pages: bounded by the size of a page
    slots = found.where("NOT is_text").groupBy("host").applyInArrow(_judged, "host long, path long, keep boolean, worded boolean")
    slots = slots.groupBy("host").agg(F.collect_list(F.struct("path", "keep", "worded")).alias("slots"))
    known = write_table(slots.join(texts, "host", "left").select("host", F.struct("texts", "slots").alias("known")), "templates")
    held = F.sum(F.coalesce(F.size("known.texts"), F.lit(0)) + F.size("known.slots"))
    sent = (known.agg(held).first()[0] or 0) <= SENT_TOKENS
    known = known.withColumnRenamed("host", "known_host")
    given = pages.select(
        col(page_col).alias("page_id"), col(url_col).alias("url"), col(html_col).alias("html"), F.xxhash64(host_of(col(url_col))).alias("host")
    )
    joined = given.join(F.broadcast(known) if sent else known, F.col("host") == F.col("known_host"), "left")
    schema = T.StructType(
        [
            *[T.StructField(n, given.schema[n].dataType) for n in ("page_id", "url")],
            T.StructField("text", T.StringType()),
            T.StructField("template_blocks", T.LongType()),
            T.StructField("markup_blocks", T.LongType()),
        ]
    )
    texts = joined.select("page_id", "url", "html", "known").mapInArrow(_extract, schema)
    return texts.select(
        F.col("page_id").alias(page_col),
        F.col("url").alias(url_col),
        "text",
        F.length("text").cast("long").alias("n_chars"),
        "template_blocks",
        "markup_blocks",
    )

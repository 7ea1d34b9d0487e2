"""Main-text extraction with wrappers inferred per host as union-free regular expressions.

A page is read as a stream of blocks, each with its place: the containers
around it and its own tag. Runs of equal neighbours, of one block or of
several, fold into repeated groups. The distinct streams of a host are aligned
in a tree: FAN at most meet in a task, their wrappers meet in the next round.
What only one side has becomes optional, what repeats on either side becomes
repeated, and every place is a slot for text. A run of optional places in which
one comes again becomes a repeated group, so a wrapper stays as small as its
host's places, however many pages differ.

The wrapper's slots then choose the text. Over a host's distinct pages each
slot has its words and whether its text ever varies. Slots in elements that
aren't the article by their tag (nav, aside, footer, form, ...) are out. Where
the wrapper has slots in an article or main element, the others are out. A
container named as comments, an advert or a notice on cookies is out; one whose
class names another side matter (social, related, ...) is out unless it holds
half of the words that are left: the names hint, the words decide. A slot
that is neither optional nor repeated and has the same text on all pages is the
template's, from FIXED_PAGES distinct pages on (within an article element, from
FIXED_ARTICLES on). A page that would be left without text keeps its region's,
and one of another layout, without a region of the host's, its own.

White space is what Python's str.split() takes for it, no-break and ideographic
spaces included. Elements that aren't rendered (script, style, template, hidden
ones) have no blocks.

Nulls: a null or empty html has the empty text; a null url is a host of its
own. Repeated pages are extracted each and count once in a host's statistics. A
very long page is one row of its task, and its stream is folded to its distinct
places beyond LONG. Columns besides the three named ones are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import difflib
import html as references
import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, partitions

TAG = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|$)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Elements whose content isn't markup; it ends at their closing tag.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
#: Elements that aren't rendered as text.
UNSEEN = {"head", "noscript", "template", "svg", "canvas", "video", "audio"} | RAW
#: Elements that aren't the article.
ASIDE = {"nav", "aside", "footer", "form", "fieldset", "menu", "dialog", "button", "select"}
#: Elements that hold blocks.
CONTAINERS = {"html", "body", "div", "section", "article", "main", "header", "hgroup", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "tr", "figure", "blockquote", "details", "center", "address"} | UNSEEN | ASIDE
#: Elements that begin and end a block.
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "pre", "figcaption", "caption", "summary", "hr", "legend", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Classes and identifiers that hint at a side matter.
HINTS = set("""ad ads advert advertisement adsense sponsored sponsor promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs masthead site-header page-header footer site-footer
sidebar side-bar cookie cookies cookie-notice cookie-banner cookie-consent consent gdpr notice notices newsletter subscribe signup popup modal overlay share sharing share-buttons social-share related
related-posts related-articles recommended comment comments comment-list comments-area commentlist disqus_thread replies respond widget toolbar pagination pager login search skip-link tag-cloud""".split())
#: Those of them that never hold the article: reader comments, adverts, notices on cookies.
SIDE = set("""ad ads advert advertisement adsense sponsored cookie cookies cookie-notice cookie-banner cookie-consent gdpr
comment comments comment-list comments-area commentlist disqus_thread replies respond""".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar"}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Streams that meet in a task; places of a stream beyond which its order is given up.
FAN, LONG = 64, 400
#: Distinct pages from which a text that never varies is the template's, and within an article element.
FIXED_PAGES, FIXED_ARTICLES = 3, 20


def label(tag: str, attributes: str) -> tuple[str, bool]:
    """(an element's name in a place, whether it is hidden). The name has the first class without digits; ~ marks a role that
    isn't the article's, ! a hint, !! one that needs no other evidence."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    names = found.get("class", "").split()
    shown = next((n for n in names if re.fullmatch(r"[A-Za-z_-]{1,40}", n)), "")
    own = {n.lower() for n in [*names, found.get("id", "")]}
    hint = bool(own & HINTS) + bool(own & SIDE) if tag not in ("html", "body", "article", "main") else 2 * bool(own & {"comment", "comments"})
    return tag + (f".{shown}" if shown else "") + "~" * (found.get("role", "").lower() in ROLES) + "!" * hint, tag in UNSEEN or hidden(found)


def hidden(found: dict[str, str]) -> bool:
    """Whether an element with these attributes is hidden."""
    return "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(found.get("style", "")))


def end_of_hidden(page: str, at: int, tag: str) -> int:
    """Where an element ends that holds no containers and begins before at: at its closing tag, or if it is a block at the next
    block or the end of a container."""
    depth = 1
    for m in TAG.finditer(page, at):
        if m[2] is None:
            continue
        other, closing = m[2].lower(), bool(m[1])
        if other == tag and closing:
            depth -= 1
            if not depth:
                return m.end()
        elif tag in BLOCKS and (other in BLOCKS and not closing or other in CONTAINERS and closing):
            return m.start()
        elif other == tag and not (m[3] or "").rstrip().endswith("/"):
            depth += 1
    return len(page)


def blocks(page: str) -> list[tuple[str, str]]:
    """(place, text) of each block that is seen."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str, bool]] = []  # tag, name, hidden
    words: list[str] = []
    block, at = "", 0

    def ended():
        nonlocal words
        text = " ".join(references.unescape("".join(words)).split())
        words = []
        if text and not (stack and stack[-1][2]):
            out.append(("/".join([*(s[1] for s in stack), block]), text))

    while (m := TAG.search(page, at)) is not None:
        if m.start() > at:
            words.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:  # a comment or a declaration
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "br":
            words.append(" ")
            continue
        if tag in RAW and not closing:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag not in CONTAINERS and not closing and tag not in VOID and m[3] and ("hidden" in m[3].lower() or "none" in m[3].lower()):
            if hidden({a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(m[3])}):
                if tag in BLOCKS:
                    ended()
                    block = ""
                at = end_of_hidden(page, at, tag)
                continue
        if tag not in BLOCKS:
            continue
        ended()
        block = tag if not closing and tag not in CONTAINERS else ""
        if tag not in CONTAINERS or tag in VOID:
            continue
        if closing:
            if any(s[0] == tag for s in stack):
                while stack.pop()[0] != tag:
                    pass
        elif not (m[3] or "").rstrip().endswith("/"):
            name, unseen = label(tag, m[3] or "")
            stack.append((tag, name, unseen or bool(stack and stack[-1][2])))
    words.append(page[at:])
    ended()
    return out


def parts(place: str) -> list[str]:
    return place.split("/")[:-1]


def tag_of(name: str) -> str:
    return re.match(r"[a-z0-9]*", name)[0]


def in_article(place: str) -> bool:
    return any(tag_of(n) in ("article", "main") for n in parts(place))


def aside(place: str) -> bool:
    """Whether an element around the place isn't the article's, by its tag or role; a header within an article is."""
    inside = False
    for name in parts(place):
        tag = tag_of(name)
        if tag in ASIDE or "~" in name or tag == "header" and not inside:
            return True
        inside |= tag in ("article", "main")
    return False


def hinted(place: str) -> str | None:
    """The outermost container around the place whose name hints at a side matter."""
    names = parts(place)
    return next(("/".join(names[: i + 1]) for i, n in enumerate(names) if n.endswith("!")), None)


def beside(place: str) -> bool:
    """Whether a container around the place is a side matter whatever it holds."""
    return any(n.endswith("!!") for n in parts(place))


def compact(items: list[list]) -> list[list]:
    """Runs of optional items in which a place comes again, as one repeated group of places any of which may be missing."""
    out: list[list] = []
    run: list[list] = []
    for item in [*items, None]:
        if item is not None and item[2]:
            run.append(item)
            continue
        places = [p for i in run for p in i[0]]
        out += [[list(dict.fromkeys(places)), True, True]] if len(set(places)) < len(places) else run
        run = []
        if item is not None:
            out.append(item)
    return out


def folded(places: list[str]) -> list[list]:
    """[group of places, repeated, optional] of a stream: tandem repeats of up to four places become one repeated group."""
    out: list[list] = []
    i = 0
    while i < len(places):
        for width in (1, 2, 3, 4):
            group, n = places[i : i + width], 1
            while len(group) == width and places[i + n * width : i + (n + 1) * width] == group:
                n += 1
            if n > 1:
                out.append([group, True, False])
                i += n * width
                break
        else:
            out.append([[places[i]], False, False])
            i += 1
    return out if len(out) <= LONG else compact([[g, True, True] for g, _, _ in out])


def aligned(one: list[list], other: list[list]) -> list[list]:
    """Two wrappers [group, repeated, optional], generalised to one that matches what either does."""
    a, b = ["\n".join(w[0]) for w in one], ["\n".join(w[0]) for w in other]
    out: list[list] = []
    for op, i, j, k, n in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            out += [[w[0], w[1] or s[1], w[2] or s[2]] for w, s in zip(one[i:j], other[k:n])]
        else:
            out += [[w[0], w[1], True] for w in [*one[i:j], *other[k:n]]]
    return compact(out)


def expression(wrapper: list[list]) -> str:
    """The wrapper as a regular expression without unions over places, with text slots."""
    return " ".join("(" + " ".join(f"{p}#text" for p in group) + ")" + {(0, 0): "", (1, 0): "+", (0, 1): "?", (1, 1): "*"}[bool(repeated), bool(optional)] for group, repeated, optional in wrapper)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def code(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def shapes(pages: DataFrame) -> DataFrame:
    """pages: host, html. host, kind, stream, contents, place, words, text: of each page its folded stream (kind 0), and of each
    of its places the words and the code of the text there (kind 1), with the code of the page's contents."""

    def run(batches):
        for batch in batches:
            streams: dict[tuple, int] = {}
            rows: dict[tuple, list] = {}
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = blocks(page or "")
                stream = json.dumps(folded([place for place, _ in found]))
                streams[h, stream] = streams.get((h, stream), 0) + 1
                contents = code(json.dumps(found))
                texts: dict[str, list[str]] = {}
                for place, text in found:
                    texts.setdefault(place, []).append(text)
                for place, text in texts.items():
                    rows[h, contents, place] = [sum(len(t.split()) for t in text), code("\n".join(text))]
            n = len(streams)
            hosts = [h for h, _ in streams] + [h for h, _, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array([0] * n + [1] * len(rows), pa.int32()), pa.array([s for _, s in streams] + [None] * len(rows), pa.string()),
                 pa.array([None] * n + [c for _, c, _ in rows], pa.int64()), pa.array([None] * n + [p for _, _, p in rows], pa.string()),
                 pa.array(list(streams.values()) + [v[0] for v in rows.values()], pa.int64()), pa.array([None] * n + [v[1] for v in rows.values()], pa.int64())],
                names=["host", "kind", "stream", "contents", "place", "words", "text"])

    return arrow_map(pages, run, "host string, kind int, stream string, contents long, place string, words long, text long")


def wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """pages: host, html. host, pages, wrapper: each host's streams aligned to one, in rounds of FAN at most in a task."""
    spark = pages.sparkSession
    found = scratch.keep(shapes(pages), "shapes")
    level = found.where("kind = 0").groupBy("host", F.col("stream").alias("wrapper")).agg(F.sum("words").alias("pages")).withColumn("hash", F.xxhash64("wrapper"))
    level = scratch.keep(level, "level0")
    most = level.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]

    def merge(batches):
        key, held, total, lead = None, None, 0, 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([json.dumps(held)]), pa.array([total]), pa.array([lead])], names=["host", "wrapper", "pages", "hash"])

        for batch in batches:
            for h, b, w, n, x in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (h, b) != key:
                    if key is not None:
                        yield done()
                    key, held, total, lead = (h, b), json.loads(w), 0, x
                else:
                    held = aligned(held, json.loads(w))
                total += n
        if key is not None:
            yield done()

    buckets, turn = 1, 0
    while buckets * FAN < most:
        buckets *= FAN
    while True:
        rows = level.select("host", F.pmod("hash", F.lit(buckets)).alias("bucket"), "wrapper", "pages", "hash")
        rows = rows.repartition(partitions(spark), "host", "bucket").sortWithinPartitions("host", "bucket", F.desc("pages"), "wrapper")
        turn += 1
        level = scratch.keep(arrow_map(rows, merge, "host string, wrapper string, pages long, hash long"), f"level{turn}")
        scratch.drop(f"level{turn - 1}")
        if buckets == 1:
            return level.select("host", "pages", "wrapper")
        buckets //= FAN


def chosen(wrapper: list[list], facts: dict[str, tuple[int, int, bool]]) -> tuple[list[str], list[str]]:
    """(main slots, slots of their region) of a wrapper. facts: of a place its distinct pages, words and whether its text never
    varies."""
    single = {p for group, repeated, optional in wrapper if not repeated and not optional for p in group}
    slots = list(dict.fromkeys(p for group, _, _ in wrapper for p in group))
    region = [p for p in slots if not aside(p)]
    region = [p for p in region if in_article(p)] or region
    region = [p for p in region if not beside(p)] or region
    words = lambda places: sum(facts[p][1] for p in places if p in facts)
    whole = words(region)
    side: dict[str, list[str]] = {}
    for p in region:
        if (c := hinted(p)) is not None:
            side.setdefault(c, []).append(p)
    out = {p for places in side.values() if 2 * words(places) < whole for p in places}
    region = [p for p in region if p not in out] or region

    def fixed(p: str) -> bool:
        pages, _, same = facts.get(p, (0, 0, False))
        return same and p in single and pages >= (FIXED_ARTICLES if in_article(p) else FIXED_PAGES)

    return [p for p in region if not fixed(p)], region


def learned(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """pages: host, html. host, main, region: codes of the slots whose text is the page's."""
    wrapped = wrappers(pages, scratch)
    seen = scratch.spark.read.parquet(scratch.path("shapes")).where("kind = 1")
    seen = seen.groupBy("host", "contents", "place").agg(F.max("words").alias("words"), F.max("text").alias("text"))  # copies of a page count once
    spread = seen.groupBy("host", "place").agg(F.count(F.lit(1)).alias("pages"), F.sum("words").alias("words"), (F.min("text") == F.max("text")).alias("same"))
    facts = spread.groupBy("host").agg(F.collect_list(F.struct("place", "pages", "words", "same")).alias("facts"))  # as many as the wrapper has places

    def choose(batches):
        for batch in batches:
            main, region = [], []
            for w, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                a, b = chosen(json.loads(w), {x["place"]: (x["pages"], x["words"], x["same"]) for x in f or ()})
                main.append([code(p) for p in a])
                region.append([code(p) for p in b])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(main, pa.list_(pa.int64())), pa.array(region, pa.list_(pa.int64()))], names=["host", "main", "region"])

    out = scratch.keep(arrow_map(wrapped.join(facts, "host", "left").select("host", "wrapper", "facts"), choose, "host string, main array<long>, region array<long>"), "learned")
    scratch.drop("shapes")
    return out


def main_text(page: str, main: set, region: set) -> str:
    """A page's text by its host's wrapper: what fills the main slots, else the region's, else its own region's."""
    found = [(code(place), place, text) for place, text in blocks(page)]
    for slots in (main, region):
        if inside := [text for c, _, text in found if c in slots]:
            return "\n\n".join(inside)
    # a page of another layout: its own region, without what is named as a side matter if something is left
    own = [(place, text) for _, place, text in found if not aside(place)]
    for better in (in_article, lambda place: not beside(place), lambda place: hinted(place) is None):
        own = [x for x in own if better(x[0])] or own
    return "\n\n".join(text for _, text in own)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each row of pages: page_id, url, text, n_chars."""
    scratch = Scratch(pages.sparkSession)
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))
    slots = learned(pages.select("host", "html"), scratch)

    def run(batches):
        for batch in batches:
            texts = [main_text(page or "", set(m or ()), set(r or ())) for page, m, r in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t.encode("utf-8", "replace") for t in texts], pa.binary()).cast(pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    # a row a host: Spark sends that side to all tasks where its size allows, and splits a hot host's pages otherwise
    rows = pages.join(slots, "host", "left").select("page_id", "url", "html", "main", "region")
    return arrow_map(rows, run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

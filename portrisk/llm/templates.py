"""Main text of web pages by removing site templates.

Each page is parsed into elements, and Spark counts per host, over its different contents:

* subtrees: hashes of block elements with their words, and their places among their siblings;
  those that recur on many contents at the same place are deleted;
* shapes: hashes of an element's path of tags and class words, without any text, with its share
  of the page's text and of links.  Menus, adverts and footers whose words differ recur in
  their shape; a shape that recurs on the host and holds little of its pages' text is deleted.

Tags and class words tell prose, which no shape deletes, and what needs less evidence (a
``nav``, a class "ad").  Only on hosts too small to count do they decide alone, and an
``article`` or ``main`` is then returned by itself.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portrisk.llm.common import per_batch, prepare, stored

#: Contents from which a host is counted; on smaller ones tags and class words decide.
COUNTED = 20
#: A shape is template on the majority of a host's contents if it holds less than this share of their text.
SMALL = 0.15
#: A list, table or part with a heading must also hold this share of its text in links.
LINKY = 0.5
#: A shape marked by its tag, role or class needs this many contents, and this share of them, so
#: that a host has no more template shapes than a hundred times the shapes of a page.
MIN_MARKED, MARKED_SHARE = 2, 0.01
#: A subtree is template text when it is on this many contents of a host and on this share of
#: them; blocks that are no prose are on MANY contents, however large the host.
MIN_PAGES = 4
SHARE = 0.1
MANY = 20
#: Prose needs this share, and this share of its contents must have it at one place among its siblings.
MAJORITY = 0.5
#: Prose inside an article needs the majority, and this many contents.
MIN_PROSE = 32
#: Kinds of subtrees, the last two bits of their hashes: blocks; headings and parts of lists and
#: tables; prose inside an article; other prose.
PLAIN, FIXED, QUOTED, LOOSE = 0, 1, 2, 3
#: What is known of a shape: marked by its tag, role or class; prose or in prose; holds a heading or an article.
MARKED, IN_PROSE, HEADED = 1, 2, 4
#: Ways to read a page: on a small host, on a counted one, and to count.
BY_WORDS, BY_COUNTS, TO_COUNT = 0, 1, 2

_TOKEN = re.compile(r"""<!--(?P<note>.*?)(?:-->|\Z)
  |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']+|"[^"]*"|'[^']*')*+)>
  |<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)
  |<[!?/][^>]*(?:>|\Z)""", re.S | re.X)
_ATTR = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I | re.S)

_set = lambda words: frozenset(words.split())
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style title textarea noscript iframe xmp template object select")
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
BLOCKS = HEADINGS | _set("""address article aside blockquote body center dd details dialog div dl dt fieldset
    figcaption figure footer form head header hgroup hr html li main menu nav ol option p pre section summary table
    tbody td tfoot th thead tr ul br""")
#: Elements that are never part of an article.
NEVER = RAW | _set("head nav footer aside form menu dialog button annotation annotation-xml metadata desc")
#: Those without any text to show.
SILENT = RAW | _set("head annotation annotation-xml metadata desc")
#: Prose: what articles quote from each other.
PROSE = HEADINGS | _set("p blockquote pre ul ol dl table figure")
PARTS = _set("li dt dd thead tbody tfoot tr td th figcaption caption summary")
#: Words of a class or role that mark what is not the article.
WORDS = _set("""ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments
    complementary consent contentinfo cookie cookies disqus footer gdpr header login masthead menu modal nav navbar
    navigation newsletter notice notices pagination popup promo related reply respond search share sharing sidebar
    social sponsor sponsored subscribe toolbar widget""")
#: Words that may stand beside them in a class ("share-bar"); any other word makes it a class of its own.
BESIDE = _set("""area bar bars block bottom box btn button buttons container content fixed form global group icon icons
    inner item items left link links list main mobile outer page primary right secondary section site sticky thread top
    wrap wrapper""")
#: Ids are often made from headings: only these whole ids count, the first ones inside an article too.
COMMENT_IDS = _set("comments respond disqus_thread")
IDS = COMMENT_IDS | _set("header footer nav navbar navigation menu masthead sidebar breadcrumb breadcrumbs cookie-banner")
_COMMENTS = _set("comment comments disqus respond reply")
#: An opening tag ends open elements of these kinds, up to an element of those.
ENDS = {"li": (_set("li"), _set("ul ol menu")), "dt": (_set("dt dd"), _set("dl")), "dd": (_set("dt dd"), _set("dl")),
        "tr": (_set("tr td th"), _set("table")), "td": (_set("td th"), _set("tr table")),
        "th": (_set("td th"), _set("tr table")), "option": (_set("option"), _set("select"))}
_WORD = re.compile(r"[^a-z0-9]+")
_DIGIT = re.compile(r"[0-9]")
_FOLD = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@dataclass
class _Open:
    tag: str
    attrs: str
    at: int  # where its text begins in the output
    found: int  # and its subtrees in the list of those found
    never: bool
    spare: bool = False  # an article inside it is returned if the page has no other text
    path: int = 0  # hash of the tags and class words down to it
    about: int = 0  # MARKED, IN_PROSE, HEADED
    chars: int = 0  # text of the page before it, and that in links
    links: int = 0
    marks: list[str] = field(default_factory=list)  # of its children, in order
    blocks: list[tuple[int, int] | None] = field(default_factory=list)  # its block elements, counted ones by hash and path


def _marked(attrs: str, inside: bool) -> frozenset[str]:
    """Words by which an element, ``inside`` an article or not, says it is none."""
    for m in _ATTR.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "id":
            if value.strip().lower() in (COMMENT_IDS if inside else IDS):
                return frozenset((value.strip().lower().split("_")[0],))
            continue
        for token in value.split():
            words = frozenset(w for w in _WORD.split(_FOLD.sub(" ", token).lower()) if w)
            if words & WORDS and words <= WORDS | BESIDE:
                return words & WORDS
    return frozenset()


class Page:
    """One parse of a page.  ``template``: hashes of subtrees and shapes to delete."""

    def __init__(self, source: str | None, template: frozenset[int] = frozenset(), way: int = BY_WORDS,
                 words: bool = True) -> None:
        self.template, self.way, self.words = template, way, words
        self.found: list[tuple[int, int, int]] = []  # (hash, place, path) of each counted subtree, two places each
        self.shapes: dict[int, list[int]] = {}  # by path: text, text in links, what is known
        self.chars = self.links = 0
        self._prose: list[str] = []
        self._out: list[str | None] = []  # text, None between blocks
        self._spare: list[str | None] = []
        self._roots: dict[str, list[tuple[int, int, int]]] = {"article": [], "main": []}
        self._stack = [_Open("", "", 0, 0, False)]
        self._count: dict[str, int] = {}
        self._parse(source or "")

    def text(self) -> str:
        """Blocks of the article (else main, else the whole page), joined by one space; of all that
        is left of the page where its host was counted."""
        if self.way != BY_WORDS:
            return _text(self._out)
        spans = _outer(self._roots["article"]) or _outer(self._roots["main"]) or [(0, len(self._out))]
        return _text([part for a, b in spans for part in [*self._out[a:b], None]]) or _text(self._spare)

    def places(self) -> list[tuple[int, int, int]]:
        """(hash, 0, its least path) and (hash, place, 0) of every counted subtree, once each."""
        paths: dict[int, int] = {}
        for h, _, path in self.found:
            paths[h] = min(paths.get(h, path), path)
        return sorted({(h, 0, path) for h, path in paths.items()} | {(h, place, 0) for h, place, _ in self.found})

    def content(self) -> int:
        """Hash of the headings, paragraphs and the like (of all text without any)."""
        return _hash(" ".join(" ".join(self._prose).split()) or _text(self._out))

    def _parse(self, source: str) -> None:
        at = 0
        while m := _TOKEN.search(source, at):
            if m.start() > at:
                self._add(source[at:m.start()])
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if not tag:
                continue
            tag, attrs = tag.lower(), m["attrs"] or m["attrs2"] or ""
            if m["end"] or m["end2"]:
                self._end(tag)
            elif tag in RAW and not attrs.endswith("/"):
                close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(source, at)
                at = close.end() if close else len(source)
            else:
                self._start(tag, attrs)
        if at < len(source):
            self._add(source[at:])
        while len(self._stack) > 1:
            self._close()
        self._place(self._stack[0])

    def _add(self, text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        self._out.append(text)
        words = text.split()
        e = self._stack[-1]
        e.marks.append(" ".join(words))
        if words and self.way == TO_COUNT:
            n = sum(map(len, words))
            self.chars += n
            self.links += n if self._count.get("a") else 0
            if e.about & IN_PROSE and not e.about & MARKED:
                self._prose.append(text)

    def _start(self, tag: str, attrs: str) -> None:
        if tag in BLOCKS:
            if tag != "br" and self._count.get("p"):
                self._end("p")
            if tag in ENDS and any(self._count.get(t) for t in ENDS[tag][0]):
                ended, bound = ENDS[tag]
                for k in range(len(self._stack) - 1, 0, -1):
                    if self._stack[k].tag in bound:
                        break
                    if self._stack[k].tag in ended:
                        while len(self._stack) > k:
                            self._close()
                        if tag != "tr":
                            break
            self._out.append(None)
        drawn = tag in ("svg", "math") or self._count.get("svg") or self._count.get("math")
        if tag in VOID or drawn and attrs.endswith("/"):
            self._stack[-1].marks.append(f"<{tag}>")
            return
        inside = bool(self._count.get("article") or self._count.get("main"))
        self._count[tag] = self._count.get(tag, 0) + 1
        never, words = tag in NEVER, frozenset()
        if not self.words:
            never = tag in SILENT
        elif tag == "header" and not inside:
            never = True
        elif attrs and tag not in ("html", "body", "main", "header") and tag not in HEADINGS:
            words = _marked(attrs, inside)
        e = _Open(tag, attrs, len(self._out), len(self.found), never or bool(words), _COMMENTS.isdisjoint(words))
        if self.way != BY_WORDS:
            up = self._stack[-1]
            e.path, e.about, e.chars, e.links = up.path, up.about & (MARKED | IN_PROSE), self.chars, self.links
            if tag in BLOCKS or e.never:
                e.path = _path(up.path, tag, attrs)
            e.about |= (MARKED if e.never else 0) | (IN_PROSE if tag in PROSE or tag in PARTS else 0)
        self._stack.append(e)

    def _end(self, tag: str) -> None:
        if self._count.get(tag):
            while True:
                if self._close() == tag:
                    return

    def _close(self) -> str:
        e = self._stack.pop()
        self._count[e.tag] -= 1
        mark = _hash(f"<{e.tag} {e.attrs.strip()}>" + "\x00".join(e.marks))
        self._stack[-1].marks.append(str(mark))
        self._place(e)
        up = self._stack[-1]
        up.about |= HEADED if e.tag in HEADINGS or e.tag in self._roots else e.about & HEADED
        if e.tag not in BLOCKS and not e.never:
            return e.tag
        holds = any(r[0] >= e.at for spans in self._roots.values() for r in spans)
        if self.way == TO_COUNT and self.chars > e.chars and e.tag not in ("html", "body"):
            s = self.shapes.setdefault(e.path, [0, 0, 0])
            s[0], s[1] = s[0] + self.chars - e.chars, s[1] + self.links - e.links
            s[2] |= (e.about & HEADED) | (MARKED if e.never else 0) | up.about & IN_PROSE | (
                IN_PROSE if e.tag in PROSE or e.tag in PARTS else 0)
        if e.tag in SILENT:
            self._drop(e, False)
        elif self.way == BY_COUNTS and e.path in self.template and not holds:
            self._drop(e, False)
        elif e.never and self.way == BY_WORDS and not (holds and e.tag == "form"):
            self._drop(e, holds and e.spare)
        else:
            kept = holds or e.tag in ("html", "body", "article", "main") or not any(e.marks)
            inside = bool(self._count.get("article") or self._count.get("main"))
            if inside and e.tag in PARTS and e.tag != "li":  # a label stays with what it labels
                kept = True
            kind = (PLAIN if e.tag not in PROSE and e.tag not in PARTS else QUOTED if inside
                    else FIXED if e.tag in HEADINGS or e.tag in PARTS else LOOSE)
            self._stack[-1].blocks.append(None if kept else (mark & ~3 | kind, e.path))
            if not kept and mark & ~3 | kind in self.template:
                self._drop(e, False)
            elif e.tag in self._roots:
                self._roots[e.tag].append((e.at, len(self._out), mark))
        if e.tag in BLOCKS:
            self._out.append(None)
        return e.tag

    def _drop(self, e: _Open, spare: bool) -> None:
        """Delete what came since ``e`` began, also the articles in it."""
        inner = {tag: [r for r in spans if r[0] >= e.at] for tag, spans in self._roots.items()}
        self._roots = {tag: [r for r in spans if r[0] < e.at] for tag, spans in self._roots.items()}
        if spare:
            for a, b in _outer(inner["article"]) or _outer(inner["main"]):
                self._spare += [*self._out[a:b], None]
        del self._out[e.at:]
        del self.found[e.found:]

    def _place(self, e: _Open) -> None:
        """Places of the counted children of ``e``: in it, from its beginning and from its end."""
        of = xxhash.xxh32_intdigest(e.tag) << 24
        for i, block in enumerate(e.blocks):
            if block is not None:
                h, path = block
                self.found += [(h, of + 2 * i + 2, path), (h, of + 2 * (len(e.blocks) - i) + 1, path)]


def _path(above: int, tag: str, attrs: str) -> int:
    """Hash of a path of tags, each with the words of its class and role; names with digits, such
    as numbers of pages, and the attributes of the whole page count for nothing."""
    names = set()
    if tag not in ("html", "body"):
        for m in _ATTR.finditer(attrs):
            if m[1].lower() != "id":
                names.update(t.lower() for t in (m[2] or m[3] or m[4] or "").split() if not _DIGIT.search(t))
    return _hash(f"{above} {tag} {' '.join(sorted(names))}")


def _outer(roots: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for a, b, _ in sorted(roots, key=lambda r: (r[0], -r[1])):
        if not spans or a >= spans[-1][1]:
            spans.append((a, b))
    return spans


def _text(parts: list[str | None]) -> str:
    blocks, now = [], []
    for part in [*parts, None]:
        if part is not None:
            now.append(part)
        elif now:
            blocks.append(" ".join("".join(now).split()))
            now = []
    return " ".join(b for b in blocks if b)


def _hash(text: str) -> int:
    """64-bit signed hash."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def host_of(url: Column) -> Column:
    """Host of a URL, lower case; empty for none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


#: Pages of a host with the same HTML have the same key, and the same templates.
KEY = ["host", "key", "key2"]


def _key(url: Column, html_col: Column) -> list[Column]:
    text = html_col.cast("string")
    return [host_of(url.cast("string")).alias("host"), F.xxhash64(text).alias("key"),
            F.xxhash64(F.lit(1), text).alias("key2")]


def subtrees(pages: DataFrame, url_col: str = "url", html_col: str = "html", words: bool = True) -> DataFrame:
    """(host, key, key2, content, chars, found, shapes): of every page, what is counted: the hashes
    of its block subtrees with place 0, and with the places at which they are; its shapes with
    their text, text in links and what is known of them."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        contents, chars, ends, places = [], [], [0], []
        shapes, shape_ends = [], [0]
        for source in b.column(3).to_pylist():
            page = Page(source, way=TO_COUNT, words=words)
            contents.append(page.content())
            chars.append(page.chars)
            places += page.places()
            ends.append(len(places))
            shapes += [(h, *v) for h, v in sorted(page.shapes.items())]
            shape_ends.append(len(shapes))

        def structs(rows: list[tuple], names: list[str]) -> pa.Array:
            return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names)
        pairs, shaped = structs(places, ["hash", "place", "path"]), structs(shapes, ["hash", "chars", "links", "about"])
        return pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(contents, pa.int64()), pa.array(chars, pa.int64()),
                                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs),
                                pa.ListArray.from_arrays(pa.array(shape_ends, pa.int32()), shaped)],
                               names=[*KEY, "content", "chars", "found", "shapes"])
    return per_batch(pages.select(*_key(F.col(url_col), F.col(html_col)), F.col(html_col).cast("string").alias("html")), run,
                     "host string, key long, key2 long, content long, chars long, found array<struct<hash: long, place: long, path: long>>, "
                     "shapes array<struct<hash: long, chars: long, links: long, about: long>>")


def contents_of(found: DataFrame) -> DataFrame:
    """The written table of a host's different contents, of equal ones one row, so that copies of
    an article make no template."""
    one = F.min(F.struct("found", "chars", "shapes")).alias("m")
    return stored(found.groupBy("host", "content").agg(one).select("host", "content", "m.*"), "contents")


def site_templates(contents: DataFrame, sizes: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE,
                   many: int = MANY) -> DataFrame:
    """(host, hash, path): the subtrees that recur on the contents of each host; ``sizes`` has a
    row (host, contents) per host, ``path`` is null for a subtree found on several paths.
    Pages without html have none, pages with equal contents count as one, null urls are one
    host; counts that just reach a threshold recur; no pages give an empty table."""
    each = (contents.select("host", F.inline("found")).groupBy("host", "hash", "place")
            .agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("lo"), F.max("path").alias("hi"))
            .filter(F.col("n") >= min_pages).groupBy("host", "hash")
            .agg(F.max(F.expr("if(place = 0, n, 0)")).alias("n"), F.max(F.expr("if(place = 0, 0, n)")).alias("placed"),
                 F.max(F.expr("if(place = 0 AND lo = hi, lo, NULL)")).alias("path")))
    kind, n, placed, all_ = F.col("hash").bitwiseAND(3), F.col("n"), F.col("placed"), F.col("contents")
    enough = (F.when(kind == PLAIN, n >= F.least(share * all_, F.lit(float(many))))
              .when(kind == QUOTED, placed >= F.greatest(MAJORITY * all_, F.lit(float(MIN_PROSE))))
              .otherwise(placed >= MAJORITY * all_))
    same_place = (kind == PLAIN) | (placed >= MAJORITY * n)
    return each.join(sizes, "host").filter(enough & same_place).select("host", "hash", "path")


def site_shapes(contents: DataFrame, sizes: DataFrame, counted: int = COUNTED) -> DataFrame:
    """(host, hash): the shapes that recur on the contents of each host of ``counted`` or more
    and hold little of their text.

    Prose is never one, but for lists of links; what holds a heading or an article is none
    unless most of it is links.  A shape marked by tag, role or class needs few contents,
    whatever its share of their text.
    """
    each = (contents.filter("chars > 0").select("host", F.col("chars").alias("all_chars"), F.inline("shapes"))
            .groupBy("host", "hash").agg(
                F.count(F.lit(1)).alias("n"), F.avg(F.col("chars") / F.col("all_chars")).alias("share"),
                (F.sum("links") / F.sum("chars")).alias("linked"), F.bit_or("about").alias("about")))
    has = lambda bit: F.col("about").bitwiseAND(bit) > 0
    plain = ((F.col("n") >= MAJORITY * F.col("contents")) & (F.col("share") < SMALL)
             & (~(has(IN_PROSE) | has(HEADED)) | (F.col("linked") >= LINKY)))
    marked = has(MARKED) & (F.col("n") >= F.greatest(F.lit(float(MIN_MARKED)), MARKED_SHARE * F.col("contents")))
    return (each.join(sizes.filter(F.col("contents") >= counted), "host").filter(marked | plain).select("host", "hash"))


def main_texts(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, id_col: str = "page_id",
               url_col: str = "url", html_col: str = "html", many: int = MANY, counted: int = COUNTED,
               words: bool = True) -> DataFrame:
    """(id, url, text) of every row of ``pages``: its main text, empty if there is none.

    Hosts of ``counted`` different contents or more are read by what recurs on them, smaller
    ones by tags and class words, with what recurs.  ``words=False`` leaves tags and class
    words aside in marking elements.  Null html counts as empty, null urls as one host; ids pass
    through, null or repeated; a truncated page is read as far as it goes; other columns are
    ignored; an empty table gives an empty table.
    """
    prepare(pages.sparkSession)
    found = stored(subtrees(pages, url_col, html_col, words), "subtrees")
    contents = contents_of(found)
    sizes = stored(contents.groupBy("host").agg(F.count(F.lit(1)).alias("contents")), "hosts")
    shapes = stored(site_shapes(contents, sizes, counted), "shapes")
    # what is deleted by its shape needs no mention page by page
    by_shape = shapes.select(F.col("host").alias("of"), F.col("hash").alias("shape"))
    recurring = stored(site_templates(contents, sizes, min_pages, share, many)
                       .join(by_shape, (F.col("host") == F.col("of")) & (F.col("path") == F.col("shape")), "left_anti")
                       .select("host", "hash"), "templates")
    # a row per counted host, of bounded length; and one per page that holds a recurring subtree
    shapes = shapes.groupBy(F.col("host").alias("of_shapes")).agg(F.collect_list("hash").alias("shapes"))
    hosts = stored(sizes.filter(F.col("contents") >= counted).select(F.col("host").alias("of_counted"))
                   .join(shapes, F.col("of_counted") == F.col("of_shapes"), "left").select("of_counted", "shapes"), "counted")
    each = found.select(*KEY, F.inline("found")).filter("place = 0").select(*KEY, "hash").join(recurring, ["host", "hash"])
    lists = each.groupBy(*KEY).agg(F.collect_list("hash").alias("template"))
    lists = stored(lists.select(*[F.col(k).alias(f"of_{k}") for k in KEY], "template"), "page-templates")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"), *_key(F.col(url_col), F.col(html_col)))
    same = [F.col(k) == F.col(f"of_{k}") for k in KEY]
    joined = (rows.join(lists, same, "left").join(hosts, F.col("host") == F.col("of_counted"), "left")
              .select("id", "url", "html", F.array_union(F.coalesce("template", F.array()), F.coalesce("shapes", F.array()))
                      .alias("template"), F.col("of_counted").isNotNull().alias("is_counted")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page(t, frozenset(k or ()), BY_COUNTS if c else BY_WORDS, words).text()
                     for t, k, c in zip(*(b.column(n).to_pylist() for n in (2, 3, 4)))]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])
    return joined.mapInArrow(run, "id long, url string, text string")

"""Pages to blocks: headings with the elements beside them, and page metadata. One pass of a small parser per page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: An ampersand that begins no reference with its semicolon.
OPEN_REFERENCE = re.compile("&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)")


class _Node:
    __slots__ = ("tag", "attrs", "children", "ord", "parent")

    def __init__(self, tag: str, attrs: dict, ord: int, parent: _Node | None = None):
        self.tag, self.attrs, self.children, self.ord, self.parent = tag, attrs, [], ord, parent

    def texts(self) -> Iterator[str]:
        stack = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in ("script", "style"):
                stack += reversed(x.children)

    def text(self) -> str:
        return re.sub(r"\s+", " ", "".join(self.texts())).strip()

    def elements(self) -> list[_Node]:
        return [x for x in self.children if not isinstance(x, str)]


class _Tree(HTMLParser):
    """No implied end tags: an end tag closes the nearest open element of its name, one without is ignored."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {}, 0)
        self.open, self.nodes = [self.root], [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        known: dict = {}
        for k, v in attrs:
            known[k] = v or ""
        node = _Node(tag, known, len(self.nodes), self.open[-1])
        self.nodes.append(node)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def release(self) -> None:
        """Unlinks the nodes from their parents, so that the tree goes at once and not when cycles are next looked for."""
        for node in self.nodes:
            node.parent = None

    def ends(self) -> list[int]:
        """The last node below each node; nodes are numbered as they open."""
        out = list(range(len(self.nodes)))
        for node in reversed(self.nodes[1:]):
            out[node.parent.ord] = max(out[node.parent.ord], out[node.ord])
        return out


def _text_of(x) -> str:
    return re.sub(r"\s+", " ", x).strip() if isinstance(x, str) else x.text()


def image_context(img: _Node) -> str:
    """The nearest text within three siblings on either side (100 characters each) and the caption of a classed figure or div."""
    beside = img.parent.children
    at = next(i for i, x in enumerate(beside) if x is img)
    before = next((t for x in beside[max(0, at - 3) : at][::-1] if (t := _text_of(x))), "")
    after = next((t for x in beside[at + 1 : at + 4] if (t := _text_of(x))), "")
    parts, node = [t[:100] for t in (before, after) if t], img.parent
    while node is not None and node.tag != "body":
        if node.tag in ("figure", "div") and node.attrs.get("class"):
            caption = next((x for x in _below(node) if x.tag in ("figcaption", "caption", "p")), None)
            if caption is not None and (text := caption.text()):
                parts.append(text)
                break
        node = node.parent
    return " | ".join(parts)


def _below(node: _Node) -> Iterator[_Node]:
    stack = node.elements()[::-1]
    while stack:
        x = stack.pop()
        yield x
        stack += x.elements()[::-1]


def page_meta_of(tree: _Tree) -> tuple:
    titles = [n for n in tree.nodes if n.tag == "title"]
    found = {"description": "", "author": "", "keywords": [], "language": "zh-CN"}
    for n in tree.nodes:
        if n.tag == "meta":
            name, content = n.attrs.get("name", "").lower(), n.attrs.get("content", "")
            if name in ("description", "author"):
                found[name] = content
            elif name == "keywords":
                found[name] = [k.strip() for k in content.split(",")]
            elif name == "language" or n.attrs.get("http-equiv", "").lower() == "content-language":
                found["language"] = content
    return ("".join(titles[0].texts()).strip() if titles else "", found["description"], found["author"], found["keywords"], found["language"])


def blocks_of(tree: _Tree) -> list[dict]:
    """The elements of every parent that holds a heading."""
    out = []
    for parent in tree.nodes:
        own = parent.elements()
        if any(x.tag in HEADINGS for x in own):
            for i, x in enumerate(own):
                images = sum(isinstance(y, _Node) and y.tag == "img" and bool(y.attrs.get("src")) for y in [x, *x.children])
                out.append({"parent_id": parent.ord, "idx": i, "ord": x.ord, "tag": x.tag, "text": x.text(), "html_id": x.attrs.get("id", ""), "images": images})
    return out


def images_of(tree: _Tree) -> list[dict]:
    found = [n for n in tree.nodes if n.tag == "img"]
    return [{"ord": n.ord, "src": n.attrs.get("src", ""), "alt_text": n.attrs.get("alt", ""), "title": n.attrs.get("title", ""), "context": image_context(n)} for n in found]


def regions_of(tree: _Tree) -> list[dict]:
    """The first element of each id, and for the first heading of each text the nearest section, article, div or body around it (the
    heading itself if there is none), as ranges of ord."""
    ends, ids, texts, out = tree.ends(), set(), set(), []
    for n in tree.nodes[1:]:
        if (own := n.attrs.get("id")) and own not in ids:
            ids.add(own)
            out.append({"html_id": own, "heading": None, "first": n.ord, "last": ends[n.ord]})
        if n.tag in HEADINGS and (text := n.text()) not in texts:
            texts.add(text)
            box = n.parent
            while box is not None and box.tag not in ("section", "article", "div", "body"):
                box = box.parent
            box = box or n
            out.append({"html_id": None, "heading": text, "first": box.ord, "last": ends[box.ord]})
    return out


#: Bytes of pages that a batch brings, and characters of pages whose parts leave in one.
READ, CHUNK = 16 << 20, 1 << 18
_INT, _TEXT = pa.int32(), pa.string()
_BLOCK = pa.struct([("parent_id", _INT), ("idx", _INT), ("ord", _INT), ("tag", _TEXT), ("text", _TEXT), ("html_id", _TEXT), ("images", _INT)])
_IMAGE = pa.struct([("ord", _INT), ("src", _TEXT), ("alt_text", _TEXT), ("title", _TEXT), ("context", _TEXT)])
_REGION = pa.struct([("html_id", _TEXT), ("heading", _TEXT), ("first", _INT), ("last", _INT)])
_META = pa.struct([("title", _TEXT), ("description", _TEXT), ("author", _TEXT), ("keywords", pa.list_(_TEXT)), ("language", _TEXT)])
#: What a page gives: its form in Spark and in Arrow, and how it is taken from the tree.
PARTS = {
    "blocks": ("array<struct<parent_id:int,idx:int,ord:int,tag:string,text:string,html_id:string,images:int>>", pa.list_(_BLOCK), blocks_of),
    "images": ("array<struct<ord:int,src:string,alt_text:string,title:string,context:string>>", pa.list_(_IMAGE), images_of),
    "regions": ("array<struct<html_id:string,heading:string,first:int,last:int>>", pa.list_(_REGION), regions_of),
    "meta": ("struct<title:string,description:string,author:string,keywords:array<string>,language:string>", _META, lambda tree: dict(zip([f.name for f in _META], page_meta_of(tree), strict=True))),
}


def parts_of(batch: pa.RecordBatch, names: tuple[str, ...], closed: bool = False) -> Iterator[pa.RecordBatch]:
    """doc_id and the named parts of the batch's pages, in batches of about CHUNK characters of pages: what a worker holds does not
    grow with the rows of a batch."""
    ids, pages = batch.column("doc_id"), batch.column("html")
    first, size, rows = 0, 0, []
    for i, cell in enumerate(pages, 1):
        page = cell.as_py() or ""
        tree = _Tree(OPEN_REFERENCE.sub("&amp;", page) if closed else page)
        rows.append([PARTS[n][2](tree) for n in names])
        tree.release()
        size += len(page)
        if size >= CHUNK or i == len(pages):
            columns = [pa.array(c, PARTS[n][1]) for n, c in zip(names, zip(*rows, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([ids.slice(first, i - first), *columns], ["doc_id", *names])
            first, size, rows = i, 0, []


def parsed(pages: DataFrame, *parts: str, closed: bool = False) -> DataFrame:
    """doc_id and, from one parse of each page, the parts that are asked for (all, if none is named) as nested columns: blocks, images,
    regions, meta. A job that needs several writes this table once, or takes all it needs from one row of it. A null page is an empty
    one; pages go one at a time, and their results leave in batches of a few pages. closed: a character reference counts only with its semicolon; one
    that was cut off before it stays as it is."""
    names = parts or tuple(PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from parts_of(b, names, closed)

    schema = ", ".join(["doc_id long", *[f"{n} {PARTS[n][0]}" for n in names]])
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(READ))  # pages may be very long
    return pages.select(F.col("doc_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, schema)


def html_blocks(pages: DataFrame, closed: bool = False) -> DataFrame:
    """The elements of every parent that holds a heading: their order among each other (idx) and in the page (ord), tag, text, id."""
    return parsed(pages, "blocks", closed=closed).select("doc_id", F.inline("blocks"))


def page_meta(pages: DataFrame) -> DataFrame:
    return parsed(pages, "meta").select("doc_id", "meta.*")


def html_images(pages: DataFrame) -> DataFrame:
    """Every image of a page in order, also those without source, which only count."""
    return parsed(pages, "images").select("doc_id", F.inline("images"))


def html_regions(pages: DataFrame) -> DataFrame:
    """Where chapters may have their images, as a range of ord."""
    return parsed(pages, "regions").select("doc_id", F.inline("regions"))

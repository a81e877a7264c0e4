"""Landed web pages: main text, links, dates, image maps, probes.

HTML is read by the standard parser inside Arrow tasks, one page at a time; all choices are Spark columns on what it finds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressglass.functions import text as T
from pressglass.functions import times, urls

# Tags whose content is no text of the page, blocks, tags without an end.
CHROME = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript"}
BLOCKS = {"article", "div", "section", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DATE_META = ("article:published_time", "article:modified_time", "datePublished", "publish-date", "pubdate", "date", "og:updated_time")
LINKED_DATES = ("datePublished", "dateCreated", "dateModified")
LINKED_DEPTH = 4
#: Pages that are parsed before what was found in them is handed on.
PAGES = 16
ARROW_PAGES = 128


def parse_selector(selector: str) -> list[tuple[str, dict[str, str | None]]]:
    """A container's selector as (tag or '', attributes) of an element and those around it: `div.story p#lead`, `[itemprop=articleBody]`.

    Classes are asked for one by one, under the name `.class`; other kinds of selectors raise.
    """
    out = []
    for part in selector.split():
        whole = re.fullmatch(r"([A-Za-z][\w-]*|\*)?((?:[.#][\w-]+|\[[\w-]+(?:=[\"']?[^\]\"']*[\"']?)?\])*)", part)
        if not whole:
            raise ValueError(f"selector {selector!r}: only tags, classes, ids and attributes, within each other")
        wants: dict[str, str | None] = {}
        for sign, name, key, value in re.findall(r"([.#])([\w-]+)|\[([\w-]+)(?:=[\"']?([^\]\"']*)[\"']?)?\]", whole[2]):
            wants["id" if sign == "#" else f".{name}" if sign else key] = name if sign == "#" else None if sign or not value else value
        out.append(((whole[1] or "").replace("*", "").lower(), wants))
    return out


def _is(element: tuple[str, dict], wanted: tuple[str, dict[str, str | None]]) -> bool:
    tag, attrs = element
    classes = (attrs.get("class") or "").split()
    return wanted[0] in ("", tag) and all(k[1:] in classes if k[0] == "." else k in attrs and v in (None, attrs[k]) for k, v in wanted[1].items())


class _Reader(HTMLParser):
    """Collects text pieces of paragraphs and blocks, and anchors, outside of chrome; of the first element that the selector
    finds its text and paragraphs."""

    def __init__(self, selector: list | None = None):
        super().__init__(convert_charrefs=True)
        self.selector, self.box, self.box_paragraphs = selector, None, []
        self.paragraphs: list[list[str]] = []
        self.blocks: list[list[str]] = []
        self.anchors: list[tuple[str, list[str], str]] = []
        self.open: list[tuple[str, list[str] | None, dict]] = []
        self.skipped = 0

    def handle_starttag(self, tag, attrs):
        if tag in CHROME:
            self.skipped += 1
        if tag in VOID:
            return
        if tag in ("p", *BLOCKS, "h1", "h2", "h3", "ul", "ol", "table"):  # a paragraph ends where the next block begins
            self._close("p")
        pieces: list[str] | None = None
        if not self.skipped and (tag == "p" or tag in BLOCKS):
            pieces = []
            (self.paragraphs if tag == "p" else self.blocks).append(pieces)
        elif tag == "a":
            pieces = []
            self.anchors.append((dict(attrs).get("href") or "", pieces, next((t for t, *_ in reversed(self.open) if t in CHROME), "")))
        own = dict(attrs)
        if self.selector and self.box is None and not self.skipped and self._found(tag, own):
            self.box = pieces = [] if pieces is None else pieces
        elif tag == "p" and pieces is not None and any(x is self.box for _, x, _ in self.open if x is not None):
            self.box_paragraphs.append(pieces)
        self.open.append((tag, pieces, own))

    def _found(self, tag, attrs):
        """Whether an element is what the selector asks for, and those around it are, in order."""
        *around, last = self.selector
        if not _is((tag, attrs), last):
            return False
        for t, _, a in self.open:
            if around and _is((t, a), around[0]):
                around = around[1:]
        return not around

    def _close(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i]
                return
            if self.open[i][0] in BLOCKS:
                return

    def handle_endtag(self, tag):
        if tag in CHROME:
            self.skipped = max(0, self.skipped - 1)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        piece = " ".join(data.split())
        if not piece:
            return
        for tag, pieces, _ in self.open:
            if pieces is not None and (tag == "a" or not self.skipped):
                pieces.append(piece)


def few_at_a_time(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of PAGES rows: what is found in a page may be many times its size, as blocks within blocks have their text each."""
    return (b.slice(i, PAGES) for b in batches for i in range(0, b.num_rows, PAGES))


def read_html(pages: DataFrame, id_col: str = "page_id", keep: tuple[str, ...] = (), selector: str | None = None) -> DataFrame:
    """id and the columns in keep, paragraphs, blocks (arrays of text), anchors (array of href, title, inside) of each page, box (text of
    the selector's container, null if there is none) and box_paragraphs; null html has none."""
    # Batches of pages that Spark hands over are small, too (a session's setting, as Arrow batches have no other).
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(pages.sparkSession.conf.get(conf, "10000")) <= ARROW_PAGES:
        pages.sparkSession.conf.set(conf, str(ARROW_PAGES))
    wanted = parse_selector(selector) if selector else None
    columns = list(dict.fromkeys([id_col, *keep]))
    kinds = {f"c{i}": pages.schema[c].dataType.simpleString() for i, c in enumerate(columns)}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_at_a_time(batches):
            paragraphs, blocks, anchors, boxes, inner = [], [], [], [], []
            for html in batch.column("html").to_pylist():
                r = _Reader(wanted)
                r.feed(html or "")
                r.close()
                paragraphs.append([" ".join(x) for x in r.paragraphs])
                blocks.append([" ".join(x) for x in r.blocks])
                boxes.append(None if r.box is None else " ".join(r.box))
                inner.append([" ".join(x) for x in r.box_paragraphs])
                anchors.append([{"href": h, "title": " ".join(x), "inside": i} for h, x, i in r.anchors])
            link = pa.list_(pa.struct([("href", pa.string()), ("title", pa.string()), ("inside", pa.string())]))
            texts = pa.list_(pa.string())
            found = [pa.array(paragraphs, texts), pa.array(blocks, texts), pa.array(anchors, link), pa.array(boxes, pa.string()), pa.array(inner, texts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kinds), *found], names=[*kinds, "paragraphs", "blocks", "anchors", "box", "box_paragraphs"])

    fields = ", ".join(f"{k} {v}" for k, v in kinds.items())
    read = pages.select(*[F.col(c).alias(k) for c, k in zip(columns, kinds, strict=True)], "html")
    read = read.mapInArrow(each, f"{fields}, paragraphs array<string>, blocks array<string>, anchors array<struct<href:string,title:string,inside:string>>, box string, box_paragraphs array<string>")
    return read.toDF(*columns, "paragraphs", "blocks", "anchors", "box", "box_paragraphs")


def largest_block(blocks: Column) -> Column:
    """The longest text, the first of equals."""
    return F.aggregate(blocks, F.lit(""), lambda best, b: F.when(F.length(b) > F.length(best), b).otherwise(best))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", least: int = 200, selector: str | None = None, least_inside: int = 80) -> DataFrame:
    """id, text: paragraphs by line if they make 200 characters, else the largest block.

    With a selector (see parse_selector()), of pages that have such a container its paragraphs if they make 80 characters,
    else all its text.
    """
    read = read_html(pages, id_col, selector=selector)
    joined = F.array_join(F.filter("paragraphs", lambda p: p != ""), "\n")
    best = largest_block(F.col("blocks"))
    inside = F.array_join(F.filter("box_paragraphs", lambda p: p != ""), "\n")
    boxed = F.when(F.col("box").isNotNull(), F.when(F.length(inside) >= least_inside, inside).otherwise(F.col("box")))
    return read.select(id_col, F.coalesce(boxed, F.when(F.length(joined) >= least, joined).when(best != "", best).otherwise(joined)).alias("text"))


def extract_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", least_title: int = 18, pattern: str | None = None) -> DataFrame:
    """id, pos, title, url: links to stories, absolute, first of each; by pattern, else by how article URLs look.

    A page's links come from its own row: nothing is joined or shuffled, and rows with one id each give theirs.
    """
    read = read_html(pages, id_col, (url_col,)).withColumnRenamed(url_col, "_page") if url_col != id_col else read_html(pages, id_col).withColumn("_page", F.col(id_col))
    own = F.struct(F.col(id_col).alias("id"), F.col("_page").alias("page"))
    page = F.col("_own")["page"]

    def link(a: Column, pos: Column) -> Column:
        url = F.regexp_replace(urls.absolute_url(F.trim(a["href"]), page), "#.*$", "")
        return F.struct(pos.alias("pos"), a["title"].alias("title"), url.alias("url"), F.trim(a["href"]).alias("href"))

    def good(x: Column) -> Column:
        story = x["url"].rlike(pattern) if pattern else urls.is_article_url(x["url"], page)
        return ~x["href"].rlike("^(?:#|(?i:javascript|mailto|tel):)|^$") & (F.length(x["title"]) >= least_title) & story

    rows = read.select(own.alias("_own"), F.transform("anchors", link).alias("links"))
    rows = rows.select("_own", F.explode(F.array(F.filter("links", good))).alias("links"))
    rows = rows.select("_own", "links", F.explode(F.array(F.transform("links", lambda x: x["url"]))).alias("all"))
    first = F.filter("links", lambda x, i: F.array_position("all", x["url"]) == i + 1)
    return rows.select(F.col("_own.id").alias(id_col), F.explode(first).alias("x")).select(id_col, "x.pos", "x.title", "x.url")


def _attributes(html: Column, tag: str) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf"(?is)<{tag}\b([^>]*)>"), F.lit(1))


def _attribute(tag: Column, name: str) -> Column:
    # Quoted or bare; the name stands by itself.
    return F.coalesce(*[F.nullif(F.regexp_extract(tag, rf"(?is)(?:^|\s){name}\s*=\s*{q}", 1), F.lit("")) for q in ('"([^"]*)"', "'([^']*)'", "([^\\s\"'>]+)")])


def extract_published(html: Column, url: Column) -> Column:
    """Date of a page: meta tags in order of trust, JSON-LD, a time tag, the URL; null if none has one.

    JSON-LD is parsed as VARIANT and walked through lists, @graph and nested objects, LINKED_DEPTH deep: a node's own dates first, in
    the order of LINKED_DATES, then what it holds, the last first (of an object by name).
    """
    metas = _attributes(html, "meta")
    blobs = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))

    def first(dates: Column) -> Column:
        return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))

    def named(name: str) -> Column:
        own = F.filter(metas, lambda m: F.coalesce(_attribute(m, "(?:property|itemprop|name)"), F.lit("")) == name)
        return first(F.transform(own, lambda m: times.edge_date(_attribute(m, "content"))))

    def dates(node: Column, depth: int) -> Column:
        """Dates of a JSON-LD node in order: its own, then those of what it holds, the last first."""
        own = F.array(*[times.edge_date(F.try_variant_get(node, f"$.{k}", "string")) for k in LINKED_DATES])
        if not depth:
            return own
        listed = F.try_variant_get(node, "$", "array<variant>")
        held = F.map_values(F.try_variant_get(node, "$", "map<string,variant>"))
        inner = F.transform(F.reverse(F.coalesce(listed, held, F.array().cast("array<variant>"))), lambda x: dates(x, depth - 1))
        return F.concat(own, F.flatten(inner))

    linked = first(F.flatten(F.transform(blobs, lambda b: F.coalesce(dates(F.try_parse_json(b), LINKED_DEPTH), F.array().cast("array<date>")))))
    tag = F.get(_attributes(html, "time"), F.lit(0))
    inner = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<time\b[^>]*>(.*?)</time>", 1)
    return F.coalesce(*map(named, DATE_META), linked, times.edge_date(F.coalesce(_attribute(tag, "datetime"), inner)), urls.published_in_url(url))


def image_map_regions(pages: DataFrame, id_col: str = "page_id", scan: tuple[str, str] | None = None, least_px: int = 25, most_area: float = 9200.0) -> DataFrame:
    """id, pos, link, l, t, r, b (percent): clickable regions of a page scan.

    Coordinates are those of the mapped image if its size is given (both over 100), else of the scan (columns of width
    and height) if they fit it within 2 %, else of their own extents.  Slivers and whole pages go, and repeated links.
    """
    size = F.get(F.filter(F.transform(F.filter(_attributes(F.col("html"), "img"), lambda i: F.lower(i).contains("usemap")), lambda i: F.named_struct(F.lit("w"), _attribute(i, "width").try_cast("double"), F.lit("h"), _attribute(i, "height").try_cast("double"))), lambda s: (s["w"] > 100) & (s["h"] > 100)), F.lit(0))
    # Numbered before the explode, so that all regions of a page have its number.
    base = pages.withColumn("_row", F.monotonically_increasing_id()).select(id_col, "_row", size.alias("img"), *([F.col(scan[0]).cast("double").alias("sw"), F.col(scan[1]).cast("double").alias("sh")] if scan else [F.lit(None).cast("double").alias("sw"), F.lit(None).cast("double").alias("sh")]), F.posexplode(_attributes(F.col("html"), "area")).alias("pos", "area"))
    numbers = F.transform(F.regexp_extract_all(F.coalesce(_attribute(F.col("area"), "coords"), F.lit("")), F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    rows = base.select("*", _attribute(F.col("area"), "href").alias("link"), F.explode(F.array(numbers)).alias("xy")).where("size(xy) >= 4 and link is not null")
    xs, ys = F.filter("xy", lambda x, i: i % 2 == 0), F.filter("xy", lambda x, i: i % 2 == 1)
    rows = rows.select("_row", id_col, "pos", "link", "img", "sw", "sh", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    page = Window.partitionBy("_row")  # a page's own regions: its row, whatever its id
    rows = rows.withColumns({"mx": F.max("x1").over(page), "my": F.max("y1").over(page)})
    fits = (F.col("sw") > 0) & (F.col("mx") <= 1.02 * F.col("sw")) & (F.col("my") <= 1.02 * F.col("sh"))
    rows = rows.withColumn("w", F.coalesce("img.w", F.when(fits, F.col("sw")), F.col("mx"))).withColumn("h", F.coalesce("img.h", F.when(fits, F.col("sh")), F.col("my")))
    return _boxes(rows, id_col, least_px, most_area)


def map_extents(rows: DataFrame, id_col: str) -> DataFrame:
    """The largest x and y of a page's regions."""
    return rows.groupBy(id_col).agg(F.max("x1").alias("mx"), F.max("y1").alias("my"))


def _boxes(rows: DataFrame, id_col: str, least_px: int, most_area: float) -> DataFrame:
    clamp = lambda c, top: F.greatest(F.lit(0.0), F.least(F.col(c), F.col(top)))
    x0, x1, y0, y1 = clamp("x0", "w"), clamp("x1", "w"), clamp("y0", "h"), clamp("y1", "h")
    rows = rows.where((F.col("w") > 0) & (F.col("h") > 0)).select("_row", id_col, "pos", "link", (x1 - x0).alias("dx"), (y1 - y0).alias("dy"), *[(100 * v / F.col(s)).alias(n) for n, v, s in (("l", x0, "w"), ("t", y0, "h"), ("r", x1, "w"), ("b", y1, "h"))])
    rows = rows.where(valid_box(least_px, most_area))
    first = F.row_number().over(Window.partitionBy("_row", "link").orderBy("pos"))
    return rows.withColumn("_n", first).where("_n = 1").select(id_col, "pos", "link", "l", "t", "r", "b")


def valid_box(least_px: int = 25, most_area: float = 9200.0) -> Column:
    """On columns dx, dy (pixels) and l, t, r, b (percent)."""
    return (F.col("dx") >= least_px) & (F.col("dy") >= least_px) & ((F.col("r") - F.col("l")) * (F.col("b") - F.col("t")) <= most_area)


def rescale_region(box: Column, coords: Column, width: Column, height: Column) -> Column:
    """The box in percent for another size from the region's own coordinates; what is stored where that can't be."""
    xs, ys = F.filter(coords, lambda x, i: i % 2 == 0), F.filter(coords, lambda x, i: i % 2 == 1)
    new = F.struct((100 * F.array_min(xs) / width).alias("l"), (100 * F.array_min(ys) / height).alias("t"), (100 * F.array_max(xs) / width).alias("r"), (100 * F.array_max(ys) / height).alias("b"))
    return F.when((F.size(coords) >= 4) & (width > 0) & (height > 0), new).otherwise(box)


def _onsite(html: Column, page: Column) -> Column:
    """How many different links a page has to its own host with two slashes or more in the path, no assets, fragments cut."""
    hrefs = F.filter(F.transform(_attributes(html, "a"), lambda a: _attribute(a, "href")), lambda h: h.isNotNull())
    full = F.transform(hrefs, lambda h: F.regexp_replace(urls.absolute_url(h, page), "#.*$", ""))

    def good(u: Column) -> Column:
        path = urls.url_path(u)
        return (urls.bare_host(u) == urls.bare_host(page)) & (F.length(F.regexp_replace(path, "[^/]", "")) >= 2) & ~path.rlike(rf"(?i)\.(?:{urls.ASSETS})$")

    return F.size(F.array_distinct(F.filter(full, good)))


def onsite_article_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, n of each page, within its own row."""
    return pages.select(id_col, _onsite(F.col("html"), F.coalesce(F.col(url_col), F.lit(""))).cast("long").alias("n"))


def source_probe_summary(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, regions, images, links, mode of each page: imagemap from three linked regions, partial from one, image_only, unknown."""
    linked = F.size(F.filter(_attributes(F.col("html"), "area"), lambda a: _attribute(a, "href").isNotNull() & _attribute(a, "coords").isNotNull()))
    images = F.size(F.filter(_attributes(F.col("html"), "img"), lambda i: F.coalesce(_attribute(i, "src"), F.lit("")).rlike(r"(?i)page|epaper|\.jpe?g")))
    out = pages.select(id_col, linked.alias("regions"), images.alias("images"), _onsite(F.col("html"), F.coalesce(F.col(url_col), F.lit(""))).cast("long").alias("links"))
    return out.withColumn("mode", F.when(F.col("regions") >= 3, "imagemap").when(F.col("regions") >= 1, "partial").when(F.col("images") > 0, "image_only").otherwise("unknown"))


def resolve_source_slug(df: DataFrame, domains: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds slug: of the longest known domain (domain, slug) that the host is or lies under.
    Hosts are joined by each of their endings, not compared with all domains."""
    host = urls.url_host(F.col(url_col))
    parts = F.split(host, r"\.")
    ends = df.select(url_col).distinct().select(url_col, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("domain"))
    best = ends.join(domains, "domain").groupBy(url_col).agg(F.max_by("slug", F.length("domain")).alias("slug"))
    return df.join(best, url_col, "left")


def route_sources(sources: DataFrame, urdu_reader: bool) -> DataFrame:
    """Adds route (web, clickable, image_only, skip) and note."""
    kind = F.lower(F.col("kind"))
    needs = (F.col("language") == "ur") & ~F.coalesce("clickable", F.lit(False)) & F.lit(not urdu_reader)
    route = F.when(kind != "epaper", "web").when(F.coalesce("clickable", F.lit(False)), "clickable").when(needs, "skip").otherwise("image_only")
    return sources.withColumn("route", route).withColumn("note", F.when(F.col("route") == "skip", "No reader for Urdu scans"))


def keep_real_scans(probes: DataFrame, least: int = 30_000) -> DataFrame:
    """Probes that found an image: status 200 or 206, an image type, large enough where the size is known."""
    size = F.col("size").try_cast("long")
    return probes.where(F.col("status").isin(200, 206) & F.lower("content_type").startswith("image/") & (size.isNull() | (size >= least)))


def edition_page_urls(editions: DataFrame, most: int = 24) -> DataFrame:
    """editions (paper, base, cities, date, pattern) -> paper, city, rank, page_no, url; cities in order of preference.

    pattern: family ({base}/{M-D-YYYY}/{city}/mainpage/page{N}.jpg), dated ({base}/{YYYY}/{MM}/{DD}/pages/{DD_MM_YYYY}_{NNN}.jpg,
    for papers without cities) or short ({base}/{city}/{DDMMYY}-{N}).
    """
    d = F.to_date("date")
    rows = editions.select("paper", "base", "pattern", d.alias("d"), F.posexplode("cities").alias("rank", "city")).select("*", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("page_no"))
    n = F.col("page_no").cast("string")
    family = F.concat_ws("/", "base", F.date_format("d", "M-d-yyyy"), F.lower("city"), F.lit("mainpage"), F.concat(F.lit("page"), n, F.lit(".jpg")))
    dated = F.concat_ws("/", "base", F.date_format("d", "yyyy/MM/dd"), F.lit("pages"), F.concat(F.date_format("d", "dd_MM_yyyy"), F.lit("_"), F.lpad(n, 3, "0"), F.lit(".jpg")))
    short = F.concat_ws("/", "base", F.lower("city"), F.concat(F.date_format("d", "ddMMyy"), F.lit("-"), n))
    return rows.select("paper", "city", "rank", "page_no", F.when(F.col("pattern") == "family", family).when(F.col("pattern") == "dated", dated).otherwise(short).alias("url"))


def edition_pages_from_listing(pages: DataFrame, pattern: str, full: tuple[str, str] = ("thumb", "large"), most: int = 24, id_col: str = "page_id") -> DataFrame:
    """id, page_no, url: thumbnails in a listing as full-size URLs, each once, numbered as they appear."""
    found = pages.select(id_col, F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(pattern), F.lit(1))).alias("pos", "raw"))
    found = found.select(id_col, "pos", F.replace("raw", F.lit(full[0]), F.lit(full[1])).alias("url"))
    first = found.groupBy(id_col, "url").agg(F.min("pos").alias("pos"))
    return number_pages(first, id_col).where(F.col("page_no") <= most)


def number_pages(listing: DataFrame, id_col: str = "page_id") -> DataFrame:
    return listing.select(id_col, F.row_number().over(Window.partitionBy(id_col).orderBy("pos")).alias("page_no"), "url")


def edition_stats(pages: DataFrame, most_hits: int = 24, page_hits: int = 4) -> DataFrame:
    """Per source: pages, read, map_fail, ocr_fail, chars, hits, capped (a page or the source had more hits than are shown), note."""
    n = F.coalesce("hits", F.lit(0))
    out = pages.groupBy("source").agg(F.count("*").alias("pages"), F.count_if(F.col("status") == "read").alias("read"), F.count_if(F.col("status") == "map_fail").alias("map_fail"), F.count_if(F.col("status") == "ocr_fail").alias("ocr_fail"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.sum(n).alias("hits"), (F.coalesce(F.max(n) > page_hits, F.lit(False)) | (F.sum(F.least(n, F.lit(page_hits))) > most_hits)).alias("capped"))
    note = F.when(F.col("hits") > 0, "").when(F.col("pages") == 0, "No pages").when(F.col("read") == 0, "No page could be read").when(F.col("chars") < 400, "Hardly any text").otherwise("No keyword on these pages")
    return out.withColumn("note", note)

"""Main text of web pages: templates deduced from equivalence classes of tokens, and names of
page furniture.

A page is a sequence of tokens: starts and ends of block elements, known by their paths (names
with class, id and role, from the root), and text blocks, known by path and text. Paragraphs,
headings, list items and cells without a name come with the text and mark no place. A token's
occurrence vector says how often each distinct page of the host holds it; tokens with one vector
are an equivalence class. The starts and ends of a class are a template's skeleton:

* it must be *ordered*: the i-th occurrences of its tokens follow each other in one order on
  every page. Elements that do not keep their places are taken out, each a class of its own;
* it must be *nested*: on no page may two classes cross. Of two that do, the one on fewer pages
  falls apart into its elements;
* between two of its tokens in order is a *slot*, in which other classes and text stand.

A text block belongs to the template if on all pages it stands in the same slots of the classes
around it, and the share ``SUPPORT`` of the pages of its page type holds it: of the nearest class
around it that has a named element, or else of the host. So a host has as many templates as it
has page types. What is left in the slots is the page's own text. Parts in menus, headers,
footers, side bars, notices, adverts, forms and comments, as their elements name them, are not
part of the article; if a page has text in ``article`` or ``main``, that is the article.

Vectors are exclusive-or sums of 128 bits over (page, occurrence), so a hot host is added up in
partial sums and no vector is ever collected. A class must be on ``TYPE_SHARE`` of the host's
pages: all of a host's classes together have at most 1 / TYPE_SHARE times the tokens of its
average page, which bounds what is kept per host.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiframe.llm.common import stored

#: a text of the template is on at least this share of the pages of its type
SUPPORT = 0.6
#: a class is on at least so many pages of a host, and on this share of them
MIN_PAGES = 5
TYPE_SHARE = 0.1
#: what a token is; its two lowest bits
TEXT, START, NAMED_START, END = range(4)

# --- fixed values: names from the HTML standard, and common names of page furniture ---
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol "
    "optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: elements that come with the text in them
CARRIERS = frozenset(
    "address blockquote caption center dd dir dt figcaption h1 h2 h3 h4 h5 h6 hr legend li optgroup "
    "option p pre summary tbody td tfoot th thead tr".split())
#: an open element of the first name ends where one of the others starts
IMPLIED_END = {
    "p": BLOCKS - frozenset("body caption head html legend option optgroup tbody td tfoot th thead tr "
                            "li dd dt".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option", "optgroup"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "head": frozenset(["body"]),
}
FURNITURE = frozenset(
    "nav header footer aside form script style noscript template head title button select input "
    "textarea dialog menu iframe svg canvas object embed audio video figure noembed noframes "
    "datalist fieldset".split()) - frozenset(["figure"])
FURNITURE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar "
    "toolbar".split())
#: class and id names, or parts of them
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
    "comments consent cookie cookies discussion disqus footer gdpr header login masthead menu menus "
    "modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted "
    "promotion recommended related replies reply respond search share sharing sidebar signup skip "
    "skyscraper social sponsor sponsored sponsors subscribe subscription toolbar topbar widget "
    "widgets".split())
#: parts that say where or what an element is, but not whose; a name of such parts and at
#: least one of the names above is furniture too (``site-header``, ``cookie-banner-wrapper``)
NEUTRAL_PARTS = frozenset(
    "area bar block bottom box col column container desktop fixed global group inner item items "
    "left link links list mobile outer page panel post posts primary right row secondary section "
    "site slot sticky top unit wrap wrapper".split())
CONTENT = frozenset(["article", "main"])
# --- end of fixed values ---

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:\s*=\s*\"[^\"]*\"|\s*=\s*'[^']*'|[^>])*?)(?:>|\Z)"
    r"|[^<]+|<", re.S)
_NAMING = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_NAME_PARTS = re.compile(r"[a-z]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def _names_furniture(value: str) -> bool:
    """Whether a class or id attribute holds a name of furniture. A name counts as a whole:
    beside furniture it may only have neutral parts (``post-with-sidebar`` is a post)."""
    for name in value.split():
        parts = set(_NAME_PARTS.findall(name))
        held = parts & FURNITURE_NAMES
        if held and parts - held <= NEUTRAL_PARTS:
            return True
    return False


def _label(name: str, attributes: str) -> tuple[str, bool]:
    """(step of a path, whether the element is furniture)."""
    if "=" not in attributes and "hidden" not in attributes:
        return name, name in FURNITURE
    furniture = name in FURNITURE or bool(_HIDDEN.search(attributes))
    step = name
    for kind, a, b, c in _NAMING.findall(attributes):
        value = (a or b or c).lower()
        step += f" {value}"
        if kind.lower() == "role":
            furniture |= value in FURNITURE_ROLES
        elif name not in ("html", "body", "main", "article"):
            furniture |= _names_furniture(value)
    return step, furniture


def tokens(page: str) -> Iterator[tuple[str, str | None, bool, bool]]:
    """(path, text, furniture, content) of each element (text None) and each text block, in
    page order. Unclosed and crossed elements end as browsers end them, more or less: where
    an element around them ends, or where a block starts that they cannot hold."""
    stack: list[tuple[str, str, bool, bool]] = []  # name, path, furniture, content
    top = ("", "", False, False)
    parts: list[str] = []
    at = top
    position = 0
    while position < len(page):
        found = _TOKEN.match(page, position)
        position = found.end()
        closing, opening, attributes = found.groups()
        if closing is None and opening is None:
            piece = found.group()
            if piece[0] != "<" or piece == "<":
                if not parts:
                    at = top
                parts.append(piece)
            elif piece.startswith("<![CDATA["):
                parts.append(piece[9:-3])
            continue
        name = (closing or opening).lower()
        if name == "br":
            parts.append("\n")
            continue
        if name in BLOCKS and parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts = []
            if text:
                yield at[1], text, at[2], at[3]
        if closing is not None:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if not BLOCKS.isdisjoint(x[0] for x in stack[i:]) and parts:
                        text = " ".join(html.unescape("".join(parts)).split())
                        parts = []
                        if text:
                            yield at[1], text, at[2], at[3]
                    del stack[i:]
                    break
                # an inline end tag does not close the blocks around its element
                if name not in BLOCKS and stack[i][0] in BLOCKS:
                    break
            top = stack[-1] if stack else ("", "", False, False)
            continue
        while stack and name in IMPLIED_END.get(stack[-1][0], ()):
            stack.pop()
        if name in BLOCKS:
            # an open paragraph ends before a block, with the inline elements in it
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in BLOCKS:
                    if name in IMPLIED_END.get(stack[i][0], ()):
                        del stack[i:]
                    break
        top = stack[-1] if stack else ("", "", False, False)
        step, furniture = _label(name, attributes or "")
        path = f"{top[1]}/{step}"
        # the page's main part is no furniture, whatever the elements around it are called
        furniture |= top[2] and name != "main"
        content = top[3] or name in CONTENT
        if name in BLOCKS or furniture and not top[2]:
            if parts and furniture and not top[2]:
                text = " ".join(html.unescape("".join(parts)).split())
                parts = []
                if text:
                    yield at[1], text, at[2], at[3]
            yield path, None, furniture, content
        if name in RAW:
            end = _RAW_END[name].search(page, position)
            position = end.start() if end else len(page)
        if name not in VOID and not (attributes or "").endswith("/") or name in BLOCKS - VOID:
            stack.append((name, path, furniture, content))
            top = stack[-1]
    if parts:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            yield at[1], text, at[2], at[3]


def _token(path: str, text: str, kind: int) -> int:
    found = xxhash.xxh64_intdigest(f"{path}\n{text}".encode("utf-8", "replace"))
    return (found & ~3 | kind) - (1 << 63)


def page_tokens(page: str) -> list[int]:
    """The page's tokens in order: starts and ends of block elements, but for text carriers
    without a name, and text blocks. Of furniture only the outermost element counts."""
    out: list[int] = []
    open_: list[tuple[str, bool]] = []  # path, furniture

    def holds(outer: str, path: str, text: str | None) -> bool:
        return path.startswith(outer) and (path[len(outer):len(outer) + 1] == "/"
                                           or text is not None and path == outer)

    for path, text, furniture, _ in tokens(page):
        while open_ and not holds(open_[-1][0], path, text):
            out.append(_token(open_.pop()[0], "", END))
        if text is not None:
            if not furniture:
                out.append(_token(path, text, TEXT))
        elif not (furniture and open_ and open_[-1][1]):
            step = path[path.rfind("/") + 1:]
            if step in CARRIERS:
                continue
            named = " " in step
            out.append(_token(path, "", NAMED_START if named else START))
            open_.append((path, furniture))
    while open_:
        out.append(_token(open_.pop()[0], "", END))
    return out


def _host(url: Column) -> Column:
    """The host part of a URL in lower case, with its port; empty if there is none."""
    found = F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _HOST.pattern, 1))
    return F.regexp_replace(found, "^.*@", "")


def sequences(pages: DataFrame) -> DataFrame:
    """(host, page, tokens, nth), one row per distinct page of a host: its 128-bit digest, its
    tokens in order, and how often each stood in the page before."""

    def run(batches):
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for host, page in zip(batch.column("host"), batch.column("html")):
                host, page = host.as_py(), page.as_py()
                found = page_tokens(page)
                seen: Counter = Counter()
                nth = []
                for token in found:
                    nth.append(seen[token])
                    seen[token] += 1
                digest = xxhash.xxh3_128_digest(f"{host}\n{page}".encode("utf-8", "replace"))
                for column, value in zip(columns, (host, digest, found, nth)):
                    column.append(value)
            types = [pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             ["host", "page", "tokens", "nth"])

    rows = pages.select(_host(F.col("url")).alias("host"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    found = rows.mapInArrow(run, "host string, page binary, tokens array<long>, nth array<int>")
    return found.dropDuplicates(["host", "page"])


def _kind(token: Column) -> Column:
    return token.bitwiseAND(F.lit(3))


def _occurrences(pages: DataFrame) -> DataFrame:
    return pages.select("host", "page", F.posexplode(F.arrays_zip("tokens", "nth")).alias("at", "x")).select(
        "host", "page", "at", F.col("x.tokens").alias("token"), F.col("x.nth").alias("nth"))


def equivalence_classes(pages: DataFrame, min_pages: int = MIN_PAGES,
                        type_share: float = TYPE_SHARE) -> DataFrame:
    """(host, token, n_pages, distinct_pages, class) of the tokens on ``min_pages`` pages and on
    the share ``type_share`` of the host's; ``pages`` as from ``sequences``. Tokens of one
    class are on the same pages, equally often on each."""
    nth, page = F.col("nth"), F.col("page")
    vectors = _occurrences(pages).groupBy("host", "token").agg(
        F.sum((nth == 0).cast("long")).alias("n_pages"),
        F.bit_xor(F.xxhash64(page, nth)).alias("v1"), F.bit_xor(F.xxhash64(nth, page)).alias("v2"))
    of_host = pages.groupBy("host").agg(F.count(F.lit(1)).alias("distinct_pages"))
    return vectors.filter(F.col("n_pages") >= min_pages).join(of_host, "host").filter(
        F.col("n_pages") >= type_share * F.col("distinct_pages")).select(
        "host", "token", "n_pages", "distinct_pages", F.xxhash64("v1", "v2").alias("class"))


def in_order(pages: DataFrame, classes: DataFrame) -> DataFrame:
    """``classes`` with size and rank. An element whose start and end have one rank each among
    the starts and ends of their class, in every round on every page, keeps its place; another
    becomes a class of its own. Texts have no rank."""
    element = (_kind(F.col("token")) != TEXT).cast("int")
    sizes = classes.groupBy("host", "class").agg(F.sum(element).alias("size"))
    marks = classes.filter(element == 1).join(sizes, ["host", "class"])
    rounds = Window.partitionBy("page", "class").orderBy("at")
    ranked = _occurrences(pages).join(marks.select("host", "token", "class", "size"), ["host", "token"]).select(
        "host", "token", (F.row_number().over(rounds) - 1 - F.col("nth") * F.col("size")).alias("rank"))
    places = ranked.groupBy("host", "token").agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    both = Window.partitionBy("host", F.shiftright("token", 2))
    keeps = F.min(F.col("low") == F.col("high")).over(both)
    split = marks.drop("size").join(places, ["host", "token"]).withColumn("keeps", keeps).withColumn(
        "class", F.when(F.col("keeps"), F.col("class")).otherwise(
            F.xxhash64("class", F.shiftright("token", 2)))).drop("keeps")
    members = Window.partitionBy("host", "class")
    skeleton = split.withColumn("size", F.count(F.lit(1)).over(members).cast("int")).withColumn(
        "rank", (F.row_number().over(members.orderBy("low")) - 1).cast("int")).drop("low", "high")
    texts = classes.filter(element == 0).withColumn("size", F.lit(0)).withColumn("rank", F.lit(-1))
    return skeleton.unionByName(texts)


_EVENT = ["at", "token", "class", "rank", "size", "n_pages"]


def _events(pages: DataFrame, classes: DataFrame) -> DataFrame:
    """(host, events): per page the tokens of its classes in page order."""
    found = _occurrences(pages).join(classes, ["host", "token"])
    return found.groupBy("host", "page").agg(
        F.array_sort(F.collect_list(F.struct(*_EVENT))).alias("events")).select("host", "events")


def _page_events(column: pa.Array) -> Iterator[list[tuple]]:
    """The events of each row, each as (token, class, rank, size, n_pages)."""
    fields = column.flatten()
    values = list(zip(*(fields.field(name).to_pylist() for name in _EVENT[1:])))
    end = 0
    for length in column.value_lengths().to_pylist():
        end += length or 0
        yield values[end - (length or 0):end]


def crossed(events: list[tuple]) -> set[int]:
    """The classes of a page that cross another one which goes before: on more pages, larger, or
    of smaller number. Two cross if one goes on while a round of the other, begun in its slot,
    is still open."""
    lost: set[int] = set()
    open_: list[tuple] = []
    for _, class_, rank, size, n_pages in events:
        if size < 2:
            continue
        key = (-n_pages, -size, class_)
        if rank == 0:
            open_.append(key)
            continue
        for i in range(len(open_) - 1, -1, -1):
            if open_[i] == key:
                if rank == size - 1:
                    del open_[i]
                break
            lost.add(max(open_[i], key)[2])
    return lost


def text_places(events: list[tuple], lost: set[int], named: set[int]) -> Iterator[tuple[int, int, int]]:
    """(token, place, pages) of each text: a digest of the slots around it, and on how many pages
    the nearest class with a named element around it is, 0 if there is none. Classes on fewer
    pages than the text say nothing of its place. ``lost`` classes are their single elements."""
    open_: dict[int, tuple[int, int, bool]] = {}
    for token, class_, rank, size, n_pages in events:
        if size == 0:
            around = [(c, slot, n, name) for c, (slot, n, name) in open_.items() if n >= n_pages]
            place = xxhash.xxh64_intdigest(repr([x[:2] for x in around])) - (1 << 63)
            yield token, place, next((n for _, _, n, name in reversed(around) if name), 0)
            continue
        name = class_ in named
        if class_ in lost:
            class_, rank, size, name = token >> 2, int(token & 3 == END), 2, token & 3 == NAMED_START
        if rank == size - 1:
            open_.pop(class_, None)
        elif rank == 0 or class_ in open_:
            open_[class_] = (rank, n_pages, open_[class_][2] if rank else name)


def templates(pages: DataFrame, support: float = SUPPORT, min_pages: int = MIN_PAGES,
              type_share: float = TYPE_SHARE) -> DataFrame:
    """(t_host, boilerplate): per host the tokens of the text blocks in its templates.

    Copies of a page count once. Hosts with fewer than ``min_pages`` distinct pages have no
    template.
    """
    rows = stored(sequences(pages), "page-sequences")
    held = stored(equivalence_classes(rows, min_pages, type_share), "page-tokens")
    classes = stored(in_order(rows, held), "page-classes")

    def cross(batches):
        for batch in batches:
            found = {(host, class_) for host, events in
                     zip(batch.column("host").to_pylist(), _page_events(batch.column("events")))
                     for class_ in crossed(events)}
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())],
                ["host", "class"])

    events = stored(_events(rows, classes), "page-events")
    lost = stored(events.mapInArrow(cross, "host string, class long").distinct(), "page-crossings")
    invalid = lost.groupBy("host").agg(F.collect_list("class").alias("lost"))
    type_marks = classes.filter(_kind(F.col("token")) == NAMED_START).groupBy("host").agg(
        F.collect_set("class").alias("named"))

    def place(batches):
        kind = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            found: dict[tuple, tuple] = {}
            sets: dict[str, tuple[set, set]] = {}
            for i, (host, page) in enumerate(zip(batch.column("host").to_pylist(),
                                                 _page_events(batch.column("events")))):
                if host not in sets:
                    sets[host] = tuple(set(batch.column(c)[i].as_py() or ()) for c in ("lost", "named"))
                lost_, named = sets[host]
                for token, at, n in text_places(page, lost_, named):
                    low, high, least = found.get((host, token), (at, at, n))
                    found[host, token] = min(low, at), max(high, at), min(least, n)
            columns = list(zip(*((*key, *value) for key, value in found.items()))) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind)],
                                             ["host", "token", "low", "high", "type_pages"])

    places = events.join(invalid, "host", "left").join(type_marks, "host", "left").mapInArrow(
        place, "host string, token long, low long, high long, type_pages long").groupBy("host", "token").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("type_pages").alias("type_pages"))
    among = F.when(F.col("type_pages") > 0, F.col("type_pages")).otherwise(F.col("distinct_pages"))
    return places.filter("low = high").join(classes, ["host", "token"]).filter(
        F.col("n_pages") >= support * among).groupBy(F.col("host").alias("t_host")).agg(
        F.collect_list("token").alias("boilerplate"))


def main_text(page: str, boilerplate: set[int]) -> str:
    """The article's blocks, one per line: those in ``article`` or ``main``, if the page has
    text there, else all that is no furniture; without the template's. A ``header`` is
    furniture in an article too, as the contract drops headers: a headline in it goes."""
    inside, anywhere = [], []
    for path, text, furniture, content in tokens(page):
        if text is None or furniture or boilerplate and _token(path, text, TEXT) in boilerplate:
            continue
        anywhere.append(text)
        if content:
            inside.append(text)
    return "\n".join(inside or anywhere)


def extract_text(pages: DataFrame, support: float = SUPPORT,
                 min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Character references are decoded, white space inside a block becomes one space, blocks
    are trimmed and joined by a line feed in page order. NULL or empty html gives an empty
    text; a NULL url is the host "" with all others like it. Broken pages (cut off, unclosed
    elements) give what they hold.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    found = rows.join(stored(templates(rows, support, min_pages), "page-templates"),
                      _host(F.col("url")) == F.col("t_host"), "left").drop("t_host")

    def run(batches):
        sets: dict[tuple, set] = {}
        for batch in batches:
            out = []
            for page, tokens_ in zip(batch.column("html"), batch.column("boilerplate")):
                key = tuple(tokens_.as_py() or ())
                if key not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[key] = set(key)
                out.append(main_text(page.as_py() or "", sets[key]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()),
                 pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return found.mapInArrow(run, "page_id long, url string, text string, n_chars long")

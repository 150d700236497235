"""Main text of web pages by the maximum-scoring run of words and tags.

A page is a sequence of tokens. Words score positive, by how often words in the same kind of
container are content; tags score negative, by how much more often they stand outside the
content than in it, though links, lists and the like cost little wherever they stand, and
as containers count by their path (nav>ul>li apart from article>ul>li). Both come from labelled pages. One linear scan finds the contiguous run
with the greatest sum; the text blocks in it, less those in containers that are no content,
are the page's main text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.bytestrings import with_text_columns
from cohortlens.shipping import ship_package

# Labelled pages that weights are learned from.
LABELLED_PAGES = 400

# Element names of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math object select button".split())
# Of those, the ones that stand within a line: they go, and the line stays one.
_RAW_INLINE = frozenset("textarea iframe svg math object select button".split())
_INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br".split()
)
# An opening tag of the first kind ends an open element of the second.
_ENDS = {
    **dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), ("p",)),
    "li": ("li", "p"),
    "dt": ("dt", "dd", "p"),
    "dd": ("dt", "dd", "p"),
    "tr": ("tr", "td", "th", "p"),
    "td": ("td", "th", "p"),
    "th": ("td", "th", "p"),
    "option": ("option",),
}
# Containers that are no content unless labelled pages say otherwise.
_OUTSIDE = frozenset("head nav footer aside form dialog menu fieldset".split())
_OUTSIDE_NAME = re.compile(
    r"(^|[-_ ])(ad|ads|advert\w*|sponsor\w*|promo\w*|sidebar|side|notice|cookies?|consent|banner|comments?|replies|respond|menu|nav\w*|"
    r"breadcrumbs?|share|sharing|social|related|footer|header|masthead|subscribe|newsletter|popup|modal|login|search)($|[-_ ])"
)

# Elements that stand in content and outside it alike: they count by where they stand. Lists, tables
# and links do so even with a class; the others only where they carry no name.
_ANYWHERE = _INLINE | frozenset("ul ol li dl dt dd table caption thead tbody tfoot tr td th".split())
_GENERIC = _ANYWHERE | frozenset("div p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption details summary hr center address".split())
_PARTS = frozenset(("section", "header"))
# The most a tag of such an element costs, and how many of them a path holds below its context.
_GENERIC_COST, _PATH = 0.25, 3

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)|<[a-zA-Z][^<]*\Z""", re.S
)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

_WORDS, _TAG = 0, 1


def tokens(page: str) -> Iterator[tuple[int, str, tuple[str, ...], str]]:
    """(kind, tag or text, open containers, container name) of every token.

    A tag token's name is the element's, with a slash in front when it closes, and with its
    classes behind. Contents of scripts, styles and the like, and comments, are no tokens.
    """
    stack: list[tuple[str, str]] = []
    at, end = 0, len(page)
    while at < end:
        match = _TOKEN.search(page, at)
        start = match.start() if match else end
        if start > at:
            yield _WORDS, page[at:start], tuple(name for _, name in stack), ""
        if not match:
            return
        at = match.end()
        if match[2] is None:
            continue
        element = match[2].lower()
        if match[1]:
            yield _TAG, "/" + element, (), element
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == element:
                    del stack[depth:]
                    break
            continue
        names = " ".join(x for groups in _NAMED.findall(match[3]) for x in groups if x).lower().split()
        name = ".".join([element, *names])
        yield _TAG, name, (), element
        if element in _RAW:
            close = re.compile(rf"</{re.escape(element)}\b[^>]*>", re.I).search(page, at)
            if close:
                at = close.end()
            elif element in ("script", "style"):
                at = end
            continue
        for closed in _ENDS.get(element, ()):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == closed:
                    del stack[depth:]
                    break
                # What is open around an enclosing list, table or section stays open.
                if stack[depth][0] not in _INLINE and stack[depth][0] != "p":
                    break
        if element not in _VOID and not match[3].endswith("/") and (element == "a" or element not in _INLINE):
            stack.append((element, name))


def _is_generic(element: str, names: str) -> bool:
    """Whether the element by itself says nothing about content."""
    if element in _ANYWHERE:
        return not any(_OUTSIDE_NAME.search(x) for x in names.split("."))
    return element in _GENERIC and not names


def _places(containers: tuple[str, ...]) -> list[tuple[str, bool]]:
    """Each container's key, and whether it is a context: generic elements have the path from theirs as key."""
    found: list[tuple[str, bool]] = []
    context, base, path = "", "", []
    for name in containers:
        element, _, names = name.partition(".")
        if _is_generic(element, names):
            if path[-1:] != [element]:
                path = [*path, element][-_PATH:]
            found.append((">".join([context, *path]), False))
            continue
        if element in _PARTS and not names:
            context = f"{base}>{element}"
        else:
            context = base = name
        path = []
        found.append((context, True))
    return found


class Weights:
    """Token weights from counts of tokens inside and outside the content of labelled pages."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        self.counts = counts
        self.known: dict[str, float] = {}
        self.chains: dict[tuple[str, ...], float] = {}

    def tag(self, name: str) -> float:
        if name not in self.known:
            inside, outside = self.counts.get("tag " + name, (0, 0))
            cost = 3 * max(0.0, math.log((outside + 1) / (inside + 1)))
            element, _, names = name.lstrip("/").partition(".")
            # A link or a list does not end a text, however seldom labelled content has one.
            if _is_generic(element, names) or element in _INLINE or element in _PARTS and not names:
                cost = min(cost, _GENERIC_COST)
            self.known[name] = -0.05 - cost
        return self.known[name]

    def _container(self, name: str, key: str) -> float:
        """How likely words in this container are content."""
        inside, outside = self.counts.get("in " + key, (0, 0))
        element, _, names = name.partition(".")
        doubtful = element in _OUTSIDE or any(_OUTSIDE_NAME.search(x) for x in names.split("."))
        prior = 0.02 if doubtful else 0.9
        return (inside + 4 * prior) / (inside + outside + 4)

    def chain(self, containers: tuple[str, ...]) -> float:
        """Of the innermost container, or less where any around it holds no content."""
        if containers not in self.chains:
            places = _places(containers)
            around = [self._container(name, key) for name, (key, _) in zip(containers, places)]
            # Elements around both content and other things say nothing; only clear cases of contexts count.
            clear = [x for x, (_, context) in zip(around[:-1], places) if context and x < 0.1]
            self.chains[containers] = min([around[-1] if around else 0.5, *clear])
        return self.chains[containers]


def best_run(gains: list[float]) -> tuple[float, int, int]:
    """The greatest sum of a contiguous run, and where it starts and stops; the first of equals, an empty one if none is above 0."""
    best, span, start, total = 0.0, (0, 0), 0, 0.0
    for at, gain in enumerate(gains, 1):
        total += gain
        if total <= 0:
            total, start = 0.0, at
        elif total > best:
            best, span = total, (start, at)
    return best, *span


def extract(page: str, weights: Weights) -> str:
    """The page's main text: blocks in page order, joined by an empty line."""
    scored, gains = [], []
    for kind, value, containers, _ in tokens(page):
        if kind == _TAG:
            gain, content = weights.tag(value), False
        else:
            weight = weights.chain(containers)
            content = weight >= 0.5
            gain = weight * len(value.split())
        scored.append((kind, value, content))
        gains.append(gain)
    _, start, stop = best_run(gains)
    blocks, open_block = [], []
    for kind, value, content in scored[start:stop]:
        if kind == _WORDS:
            if content:
                open_block.append(value)
        else:
            element = value.lstrip("/").partition(".")[0]
            if element == "br":
                open_block.append(" ")
            elif element not in _INLINE and element not in _RAW_INLINE:
                blocks.append(open_block)
                open_block = []
    blocks.append(open_block)
    texts = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks)
    return "\n\n".join(text for text in texts if text)


def _count(pages: pa.Array) -> Iterator[Counter]:
    """(token, inside) counts of each page whose content an article element marks."""
    for page in pages.to_pylist():
        found: Counter = Counter()
        inside = False
        for kind, value, containers, element in tokens(page):
            if kind == _TAG and element == "article":
                inside = False
            if kind == _TAG:
                found["tag " + value, inside] += 1
            elif value.strip():
                words = len(value.split())
                for key in {key for key, _ in _places(containers)}:
                    found["in " + key, inside] += words
            if kind == _TAG and element == "article":
                inside = not value.startswith("/")
        yield found


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: Counter = Counter()
        for found in _count(batch.column(0)):
            total.update(found)
        names, sides, counts = zip(*((n, s, c) for (n, s), c in total.items())) if total else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(sides, pa.bool_()), pa.array(counts, pa.int64())], names=["token", "inside", "n"]
        )


def learn_weights(pages: DataFrame, page: str = "html", key: str = "page_id", limit: int = LABELLED_PAGES) -> dict[str, tuple[int, int]]:
    """Counts inside and outside the content for every token of at most `limit` labelled pages.

    A page is labelled if an article element marks its content; a hash of the key decides
    which pages are taken, equal rows being one. Null keys and pages are passed over. Only hashes meet
    in one task to be picked, and only the picked pages are shuffled.
    """
    ship_package(pages.sparkSession)
    marked = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{page}`").cast("string").alias("page"))
    marked = marked.where(F.col("page").rlike("(?i)<article[ >]") & F.col("key").isNotNull())
    marked = marked.withColumns({"h": F.xxhash64("key"), "g": F.xxhash64("page")})
    # At most `limit` rows of two hashes.
    wanted = F.broadcast(marked.select("h", "g").distinct().orderBy("h", "g").limit(limit))
    picked = marked.join(wanted, ["h", "g"], "left_semi").groupBy("h", "g").agg(F.min("page").alias("page")).select("page")
    counts = picked.mapInArrow(_count_batches, "token string, inside boolean, n bigint").groupBy("token")
    sides = counts.agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("o"))
    return {r["token"]: (r["i"], r["o"]) for r in sides.collect()}


def extract_text(
    pages: DataFrame, counts: dict[str, tuple[int, int]], page: str = "html", name: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Adds the main text of each page.

    Character references are decoded, white space within a block becomes one space, blocks are
    joined by an empty line. Null and empty pages and pages without content have an empty
    text; whole pages of any length are read; repeated rows are read alike; without learned
    counts the built-in expectations decide; an input column called `name` is replaced.
    """

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        weights = Weights(counts)
        return lambda texts: [pa.array([extract(text or "", weights) for text in texts.to_pylist()], pa.string())]

    return with_text_columns(pages, page, make, {name: "string"}, keep)

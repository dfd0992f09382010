"""HTML main-text extraction by tag-path ratios.

A page becomes a sequence of text blocks, each with its root-to-leaf path of block elements. Text length and punctuation are
summed per path and divided by the path's nodes (text and punctuation tag-path ratios), the ratios are smoothed along the page
and fused, and paths above a share of the page's best path are content. A block with a weak path of its own (a heading,
a lead, a short section) is content inside the lowest element around all strong blocks. Roles that markup states outright (menu, form,
advert, reader comments ...) count as a ratio of zero. Where strong blocks lie in stated main content, all blocks of the stated elements around
them are content but those in such a role; a stated element without a strong block (a teaser) is judged like any other.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm.common import with_columns
from sessionloom.session import ship_by_value

ship_by_value(__name__)

#: Share of the best path's fused ratio that makes a path content.
THRESHOLD = 0.2
#: Weights of the smoothing along the page: a block and its neighbours.
KERNEL = (0.25, 0.5, 0.25)

_BLOCKS = frozenset(
    "html body main article section div header footer nav aside form fieldset address blockquote center dialog details summary figure "
    "figcaption dl dt dd ul ol li menu p pre h1 h2 h3 h4 h5 h6 hgroup table caption thead tbody tfoot tr td th hr select option "
    "button label legend noscript template object svg search".split()
)
_VOID = frozenset("hr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
_ASIDE = frozenset("nav footer aside form menu dialog button select option label legend fieldset noscript template object svg search".split())
_CLOSES_P = _BLOCKS - {"option", "button", "label", "legend", "noscript", "template", "object", "svg"}
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_FENCE = frozenset("ul ol dl table select menu".split())
_ROLE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|side-?bar|footer|masthead|site-?header|cookies?|"
    r"consent|notices?|gdpr|popup|modal|newsletter|subscri\w*|sign-?up|log-?in|share|sharing|social|comments?|comment-?list|replies|disqus|respond|"
    r"related|recommend\w*|widget|toolbar|pagination|pager|copyright|disclaimer)(?:$|[\s_-]|\d)",
    re.I,
)
_MAIN_ROLE = re.compile(r"role\s*=\s*[\"']?main|itemprop\s*=\s*[\"']?articleBody", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？،؛؟]")
_SPACE = re.compile(r"\s+")


@dataclass
class Elements:
    """Open and closed block elements in page order; element 0 stands around the whole page.

    An element's path is its parent's path and its own name, class and role, as a number; nothing is copied per level, so nesting costs no more than length.
    """

    name: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [0])
    #: Highest number of the elements inside.
    last: list[float] = field(default_factory=lambda: [float("inf")])
    path: list[int] = field(default_factory=lambda: [0])
    side: list[bool] = field(default_factory=lambda: [False])
    #: The outermost element around it that is stated as main content, itself included; 0: none.
    stated: list[int] = field(default_factory=lambda: [0])
    inner: list[bool] = field(default_factory=lambda: [False])
    paths: dict[tuple[int, str], int] = field(default_factory=dict)

    def open(self, parent: int, name: str, label: str, side: bool, main: bool) -> int:
        new = len(self.name)
        self.name.append(name)
        self.parent.append(parent)
        self.last.append(float("inf"))
        self.path.append(self.paths.setdefault((self.path[parent], label), len(self.paths) + 1))
        self.side.append(side or self.side[parent])
        self.stated.append(self.stated[parent] or new * main)
        self.inner.append(self.inner[parent] or name in ("article", "main"))
        return new

    def around(self, outer: int, element: int) -> bool:
        """Whether ``element`` is ``outer`` or lies inside it."""
        return outer <= element <= self.last[outer]


def blocks_of(page: str) -> tuple[list[tuple[str, int, int]], Elements]:
    """Text blocks in page order (text, innermost element, characters inside links), and the page's elements."""
    found, elements, stack, counts, held, linked, in_link = [], Elements(), [0], Counter(), [], 0, False

    def flush():
        nonlocal linked
        text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
        if text:
            found.append((text, stack[-1], min(linked, len(text))))
        held.clear()
        linked = 0

    def close(upto: int):
        for e in stack[upto:]:
            elements.last[e] = len(elements.name) - 1
            counts[elements.name[e]] -= 1
        del stack[upto:]

    at, size = 0, len(page)
    while at < size:
        token = _TOKEN.search(page, at)
        upto = token.start() if token else size
        if upto > at:
            held.append(page[at:upto])
            linked += (upto - at) * in_link
        if not token:
            break
        at = token.end()
        name = token["name"] or token["name2"]
        if not name:
            continue
        name, end, rest = name.lower(), bool(token["end"] or token["end2"]), token["rest"] or ""
        if name in _RAW and not end:
            stop = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else size
            continue
        if name == "a":
            in_link = not end
            continue
        if name == "br":
            held.append(" ")
            continue
        if name not in _BLOCKS and name != "head":
            continue
        flush()
        in_link = False
        if end:
            if counts[name]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if elements.name[stack[i]] == name))
            continue
        if name in _CLOSES_P and elements.name[stack[-1]] == "p":
            close(len(stack) - 1)
        if any(counts[x] for x in _SIBLINGS.get(name, ())):
            for i in range(len(stack) - 1, 0, -1):
                if elements.name[stack[i]] in _FENCE:
                    break
                if elements.name[stack[i]] in _SIBLINGS[name]:
                    close(i)
                    break
        if name in _VOID:
            continue
        named = [(m[0].lower(), next(filter(None, m[1:]), "")) for m in _NAMED.findall(rest)]
        labels, kinds = " ".join(v for _, v in named), " ".join(v for k, v in named if k != "id")  # an id names one element, not a path
        inner = elements.inner[stack[-1]]
        side = name in _ASIDE or name == "head" or (name == "header" and not inner) or (bool(labels) and name not in ("html", "body", "article", "main") and bool(_ROLE.search(labels)))
        main = name in ("article", "main") or bool(rest and _MAIN_ROLE.search(rest))
        stack.append(elements.open(stack[-1], name, (f"{name}.{kinds}" if kinds else name) + "!" * side, side, main))
        counts[name] += 1
    flush()
    close(1)
    return found, elements


def main_text(page: str | None) -> str:
    """The page's content blocks, joined by line feeds; empty without any.

    The ratios choose the strong blocks of every page. Strong blocks in stated main content make the stated elements around them the content;
    without any, it is the lowest element around all strong blocks.
    """
    found, elements = blocks_of(page or "")
    if not found:
        return ""
    home_of = [f[1] for f in found]
    side, stated = (np.array([kind[e] for e in home_of]) for kind in (elements.side, elements.stated))
    main = (stated > 0) & ~side
    size, links = np.array([len(f[0]) for f in found]), np.array([f[2] for f in found])
    usable = main | (~side & (links * 2 <= size))  # stated content keeps its links
    index = np.unique([elements.path[e] for e in home_of], return_inverse=True)[1]
    own = np.where(side, 0.0, size - np.where(main, 0, links))
    marks = np.array([0.0 if x else len(_PUNCTUATION.findall(f[0])) for f, x in zip(found, side)])
    nodes = np.bincount(index)
    ratio, dots = (np.bincount(index, x) / nodes for x in (own, marks))

    def smooth(x):
        return np.convolve(np.pad(x, 1, mode="edge"), KERNEL, "valid")

    along = smooth(ratio[index]) * (1 + smooth(dots[index]))
    fused = np.sqrt(np.bincount(index, along) / nodes * ratio * (1 + dots))
    best = fused[index][usable].max(initial=0.0)
    strong = (fused >= THRESHOLD * best)[index] & usable
    if (strong & main).any():
        keep = main & np.isin(stated, stated[strong & main])
        return "\n".join(f[0] for f, k in zip(found, keep) if k)
    homes = [elements.parent[e] for e, x in zip(home_of, strong) if x]
    # the lowest element around all strong blocks
    home, high = min(homes, default=0), max(homes, default=0)
    while not elements.around(home, high):
        home = elements.parent[home]
    first = int(strong.argmax())

    def inside(at: int, e: int) -> bool:
        """In that element, or a heading before its text that hangs on something around it."""
        title = at < first and elements.name[e] in _HEADINGS and elements.around(elements.parent[e], home)
        return title or elements.around(home, e)

    keep = [u and (x or inside(i, e)) for i, (e, x, u) in enumerate(zip(home_of, strong, usable))]
    return "\n".join(f[0] for f, k in zip(found, keep) if k)


def extract(df: DataFrame, html: str = "html", column: str = "text") -> DataFrame:
    """``df`` with its pages' main text in ``column`` (replaced if it is there).

    A null or empty page, and one without content, gives an empty text; broken markup is read as far as it goes. Repeated
    rows give repeated texts, an empty table gives no rows.
    """
    plain = [c for c in df.columns if c.lower() != column.lower()]
    inner = with_columns(df.select([F.col(f"`{c}`") for c in df.columns]), __html=F.col(f"`{html}`").cast("string"))
    fields = [f for f in df.schema.fields if f.name in plain]

    def run(batches):
        for batch in batches:
            texts = pa.array([main_text(p.as_py()) for p in batch.column("__html")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in plain] + [texts], plain + [column])

    return inner.mapInArrow(run, T.StructType(fields + [T.StructField(column, T.StringType())]))


def op5_tag_path_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))

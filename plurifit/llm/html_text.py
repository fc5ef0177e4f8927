"""Main text of web pages: boosted trees over the nodes of the page, decoded from the root down.

A page becomes a tree of elements. Each element has features: density and links of its subtree, tokens of its attributes and of those above it, depth,
and its place among its siblings. Trees boosted on labelled pages give the probability that an element holds main text.
Decoding picks the most likely labelling of the whole tree in which nothing below a rejected element is accepted, so
an advert inside an article can go and a paragraph inside a menu cannot stay.

Labelled pages are composed by the templates below from paragraphs of a bounded sample of the table itself (``sample`` pages, chosen by a hash of
the page key), so no labels are needed and the vocabulary is that of the corpus. Extraction reads every whole page.

Null or empty html gives an empty text. Null keys and addresses are kept, repeated rows give repeated results, an empty table gives an empty result.
Broken markup is read as far as it goes: open elements end with the page, end tags without a start are skipped, and "<" that begins no
whole tag is text. Reading takes time in proportion to the length of a page, very long and hostile ones included.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Boosted, train
from .common import text_of

SAMPLE = 60

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript template iframe".split())
NEVER = frozenset("head script style noscript template iframe svg form button select option textarea input title object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": ("li", frozenset({"ul", "ol"})), "dt": ("dt dd", frozenset({"dl"})), "dd": ("dt dd", frozenset({"dl"})),
    "tr": ("tr td th", frozenset({"table"})), "td": ("td th", frozenset({"tr", "table"})), "th": ("td th", frozenset({"tr", "table"})),
    "option": ("option", frozenset({"select"})),
}
TAG_GROUPS = ("nav menu", "header", "footer", "aside", "article main", "section", "p blockquote pre", "h1 h2 h3 h4 h5 h6", "ul ol li dl dd dt", "table tr td th tbody", "div span", "a", "b i em strong u small", "body html", "figure figcaption")
TOKEN_GROUPS = (
    "content article post entry story main text body page prose", "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs links", "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner outbrain taboola",
    "footer foot copyright legal imprint bottom", "sidebar aside widget widgets related recommended share sharing social rail popular trending tags", "comment comments reply replies discussion disqus respond reactions",
    "cookie cookies notice consent popup modal newsletter subscribe alert overlay gdpr paywall signup login", "header masthead logo top topbar branding",
)
_TAG_OF = {t: i for i, group in enumerate(TAG_GROUPS) for t in group.split()}
_TOKEN_OF = {t: i for i, group in enumerate(TOKEN_GROUPS) for t in group.split()}
# Comments, declarations, and tags without "<" in their attributes; these fail at the next "<", so no character is tried for two tags.
_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/<>]*+)(?!<)((?:[^\"'<>]|\"[^\"<]*\"|'[^'<]*')*+)>", re.S)
_START = re.compile(r"<(/?)(?=[A-Za-z])")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class _OtherTags:
    """Tags that hold "<" in their name or attributes, and "<" that begins no tag.

    Places of quotes and ends are listed once. Two readings that stand outside quotes at the same place go on alike, so places from which
    no end was found are kept, and hostile pages take time in proportion to their length (times a logarithm).
    """

    def __init__(self, source: str):
        self.source = source
        self.name_ends = [m.start() for m in re.finditer(r"[\s/>]", source)]
        self.marks = [m.start() for m in re.finditer("[\"'>]", source)]
        self.quotes = {q: [i for i in self.marks if source[i] == q] for q in "\"'"}
        self.endless: set[int] = set()

    def at(self, place: int):
        """(end, "/" of an end tag, name, attributes), or ``None`` where no tag begins or none ends."""
        m = _START.match(self.source, place)
        if m is None:
            return None
        first = bisect_left(self.name_ends, m.end())
        if first == len(self.name_ends):
            return None
        begin = self.name_ends[first]
        end = self._end(begin)
        return None if end < 0 else (end + 1, m[1], self.source[m.end() : begin], self.source[begin:end])

    def _end(self, at: int) -> int:
        passed = []
        while True:
            i = bisect_left(self.marks, at)
            if i == len(self.marks) or self.marks[i] in self.endless:
                break
            mark = self.marks[i]
            if self.source[mark] == ">":
                return mark
            passed.append(mark)
            partners = self.quotes[self.source[mark]]
            j = bisect_right(partners, mark)
            if j == len(partners):
                break
            at = partners[j] + 1
        self.endless.update(passed)
        return -1


class Page:
    """Elements in page order, and the text pieces between them."""

    def __init__(self, source: str):
        self.tag, self.parent, self.tokens, self.label = ["html"], [-1], [0], [None]
        self.pieces: list[tuple[int, int, str]] = []  # element, block, text
        self._block = 0
        self._read(source)

    def _open(self, name: str, attributes: str, parent: int) -> int:
        bits, label = 0, None
        if "=" in attributes:
            for key, *values in _ATTRIBUTE.findall(attributes):
                value = next((v for v in values if v), "")
                if key.lower() == "data-y":
                    label = value
                    continue
                for token in _TOKEN.findall(value):
                    group = _TOKEN_OF.get(token.lower())
                    if group is not None:
                        bits |= 1 << group
        self.tag.append(name)
        self.parent.append(parent)
        self.tokens.append(bits)
        self.label.append(label)
        return len(self.tag) - 1

    def _text(self, at: int, value: str) -> None:
        if value:
            self.pieces.append((at, self._block, html.unescape(value) if "&" in value else value))

    def _read(self, source: str) -> None:
        stack, at, begin, n = [0], 0, 0, len(source)
        where: dict[str, list[int]] = {}  # places in the stack of the open elements of each name
        other = None

        def top(names) -> int:
            return max((where[name][-1] for name in names if where.get(name)), default=0)

        def cut(place: int) -> None:
            for element in stack[place:]:
                where[self.tag[element]].pop()
            del stack[place:]

        while True:
            at = source.find("<", at)
            if at < 0:
                self._text(stack[-1], source[begin:])
                break
            m = _MARKUP.match(source, at)
            if m is not None:
                end, closing, name, attributes = m.end(), m[1], m[2], m[3]
            else:
                other = other or _OtherTags(source)
                found = other.at(at)
                if found is None:  # not markup, so text
                    at += 1
                    continue
                end, closing, name, attributes = found
            self._text(stack[-1], source[begin:at])
            at = begin = end
            if name is None:
                continue
            name = name.lower()
            if closing:
                if name in BLOCK:
                    self._block += 1
                if where.get(name):
                    cut(where[name][-1])
                continue
            if name == "html":
                continue
            if name in BLOCK:
                self._block += 1
                if where.get("p"):  # no block is ever open inside a paragraph
                    cut(where["p"][-1])
            if name in CLOSES:
                ends, bounds = CLOSES[name]
                place = top(ends.split())
                if place > top(bounds):
                    cut(place)
            if name == "br":
                self._text(stack[-1], " ")
                continue
            element = self._open(name, attributes, stack[-1])
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                at = begin = end.end() if end else n
            elif name not in VOID and not attributes.endswith("/"):
                where.setdefault(name, []).append(len(stack))
                stack.append(element)

    def features(self) -> np.ndarray:
        n = len(self.tag)
        own, linked, marks, runs = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        for element, _, text in self.pieces:
            bare = text.strip()
            if bare:
                own[element] += len(bare)
                runs[element] += 1
                marks[element] += bare.count(".") + bare.count(",")
        parent = self.parent
        in_link, depth, above = [False] * n, [0] * n, [0] * n
        children, place = [0] * n, [0] * n
        for i in range(1, n):
            p = parent[i]
            in_link[i] = in_link[p] or self.tag[i] == "a"
            depth[i], above[i] = depth[p] + 1, above[p] | self._above(p)
            place[i] = children[p]
            children[p] += 1
        linked = np.where(in_link, own, 0.0)
        size, links, dots, parts, tags, paragraphs = own.copy(), linked.copy(), marks.copy(), runs.copy(), np.ones(n), np.array([t == "p" for t in self.tag], float)
        for i in range(n - 1, 0, -1):
            p = parent[i]
            for a in (size, links, dots, parts, tags, paragraphs):
                a[p] += a[i]
        up = np.array([max(p, 0) for p in parent])
        siblings = np.array(children)[up]
        safe = np.maximum(size, 1.0)
        columns = [
            np.array(depth), np.array(children), np.array(place) / np.maximum(siblings, 1), siblings, np.log1p(size), links / safe, np.log1p(tags), size / tags, np.log1p(own),
            size / max(size[0], 1.0), dots / safe, paragraphs, size / np.maximum(parts, 1.0), size / np.maximum(size[up], 1.0), np.array(in_link),
        ]
        bits, over = np.array(self.tokens), np.array(above)
        columns += [np.array([_TAG_OF.get(t, -1) == g for t in self.tag]) for g in range(len(TAG_GROUPS))]
        columns += [bits >> g & 1 for g in range(len(TOKEN_GROUPS))] + [over >> g & 1 for g in range(len(TOKEN_GROUPS) + len(TAG_GROUPS))]
        return np.stack([c.astype(np.float64) for c in columns], 1)

    def _above(self, i: int) -> int:
        group = _TAG_OF.get(self.tag[i], -1)
        return self.tokens[i] | (1 << (group + len(TOKEN_GROUPS)) if group >= 0 else 0)

    def decode(self, margin: np.ndarray) -> list[bool]:
        """Most likely labels in which nothing below a rejected element is accepted."""
        n = len(self.tag)
        yes = -np.logaddexp(0, -margin)
        no = -np.logaddexp(0, margin)
        yes[0], no[0] = 0.0, -1e9
        best, none = yes.tolist(), no.tolist()
        parent = self.parent
        for i, t in enumerate(self.tag):
            if t in NEVER:
                best[i], none[i] = -1e9, 0.0
        for i in range(n - 1, 0, -1):
            best[parent[i]] += max(best[i], none[i])
            none[parent[i]] += none[i]
        taken = [True] * n
        for i in range(1, n):
            taken[i] = taken[parent[i]] and best[i] > none[i]
        return taken

    def text(self, taken: list[bool]) -> str:
        blocks: dict[int, list[str]] = {}
        for element, block, piece in self.pieces:
            if taken[element]:
                blocks.setdefault(block, []).append(piece)
        return "\n\n".join(t for t in (_SPACE.sub(" ", "".join(parts)).strip() for _, parts in sorted(blocks.items())) if t)


# Ways to write the parts of a page; the first class of each list is the plainest.
ARTICLES = ("<article data-y=1>{}</article>", "<main data-y=1><div data-y=1 class=content>{}</div></main>", '<div data-y=1 class="post-content">{}</div>', '<div data-y=1 id="story"><section data-y=1>{}</section></div>', '<main data-y=1><article data-y=1 class="entry">{}</article></main>', "<div data-y=1><div data-y=1>{}</div></div>")
ABOVE = ("<nav><ul>{links}</ul></nav>", '<header><div class="logo"><a href="/">{word}</a></div><nav>{links}</nav></header>', '<div class="menu"><ul>{links}</ul></div>', '<div id="header"><h2>{word}</h2></div><ul class="breadcrumb">{links}</ul>', '<div class="cookie-notice"><p>{short}</p><button>{word}</button></div><nav>{links}</nav>')
ASIDE = ('<div class="ad">{short}</div>', '<aside class="sidebar"><h3>{word}</h3><ul>{links}</ul></aside>', '<div class="widget related"><p>{short}</p><ul>{links}</ul></div>', '<div class="sponsored"><p>{short}</p></div>', '<aside><p>{long}</p></aside>', '<div class="newsletter"><p>{short}</p><form><input name=q></form></div>')
BELOW = ('<section class="comments"><h3>{word}</h3><div class="comment"><p>{long}</p></div><div class="comment"><p>{short}</p></div></section>', '<div id="comments"><ul><li><p>{short}</p></li><li><p>{long}</p></li></ul></div>', "")
FEET = ("<footer>&copy; {word} &middot; {short}</footer>", "<footer>&copy; {word} &middot; {long}</footer>", '<div class="footer"><ul>{links}</ul><p>{short}</p></div>', '<div id="copyright"><p>{short}</p></div>')
BODIES = ("<p data-y=1>{}</p>", "<p data-y=1><b data-y=1>{}</b></p>", "<h2 data-y=1>{}</h2>", "<ul data-y=1><li data-y=1>{}</li></ul>", "<blockquote data-y=1><p data-y=1>{}</p></blockquote>", "<pre data-y=1>{}</pre>", "<p data-y=1><b data-y=1>{}<br>", "<p data-y=1>{}")


def compose(paragraphs: list[str], turn: int) -> str:
    """A labelled page out of the given paragraphs; ``turn`` picks the ways its parts are written. Main text carries data-y=1."""
    rng = np.random.default_rng(turn)
    escaped = [html.escape(p) for p in paragraphs]

    def pick(options):
        return options[int(rng.integers(len(options)))]

    def fill(part: str) -> str:
        words = pick(escaped).split(" ")
        links = "".join(f'<li><a href="#">{w}</a></li>' for w in words[: int(rng.integers(3, 9))])
        return part.replace("{links}", links).replace("{word}", words[0]).replace("{short}", " ".join(words[:8])).replace("{long}", pick(escaped))

    inner = [f"<h1 data-y=1>{' '.join(pick(escaped).split(' ')[:8])}</h1>"] if rng.random() < 0.8 else []
    if rng.random() < 0.3:  # a line under the heading, in letters of its own
        line = " ".join(pick(escaped).split(" ")[: int(rng.integers(1, 9))])
        inner.append(BODIES[int(rng.integers(len(BODIES)))].replace("{}", line))
    # many real articles are short: a heading alone, or one to three paragraphs
    for p in escaped if rng.random() < 0.55 else escaped[: int(rng.integers(0, 4))]:
        body = BODIES[0] if rng.random() < 0.75 else pick(BODIES)
        inner.append(body.replace("{}", p if rng.random() < 0.8 else " ".join(p.split(" ")[: int(rng.integers(1, 12))])))
        if rng.random() < 0.1:
            inner.append(fill(pick(ASIDE)))
    inside = "".join(inner) + (fill(pick(BELOW)) if rng.random() < 0.2 else "")
    parts = [fill(pick(ABOVE)), fill(pick(ASIDE)) if rng.random() < 0.7 else "", pick(ARTICLES).replace("{}", inside), fill(pick(ASIDE)) if rng.random() < 0.4 else "", fill(pick(BELOW)) if rng.random() < 0.5 else "", fill(pick(FEET))]
    wrapped = "".join(parts) if rng.random() < 0.6 else f'<div data-y=1 class="{pick(("page", "wrapper", "container"))}">{"".join(parts)}</div>'
    return f"<!DOCTYPE html><html><head><title>{escaped[0][:40]}</title></head><body data-y=1>{wrapped}</body></html>"


PLAIN = ("A few plain words make the first paragraph of this page, and they end here.", "The second one is a little longer, with a comma, a full stop and some more words after it. It has two sentences.", "Short one.", "Another paragraph of ordinary length follows so that pages differ in what they hold, as real ones do.")


def labelled_nodes(texts: list[str], least: int = 480) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the elements of composed pages, ``least`` or more in all."""
    xs, ys, variants = [], [], -(-least // max(len(texts), 1))
    for n, source in enumerate(texts):
        paragraphs = [t for t in (_SPACE.sub(" ", p).strip() for p in re.findall(r"<p[^>]*>([^<]{2,})", source)) if t][:12]
        paragraphs = [html.unescape(p) for p in paragraphs] or list(PLAIN)
        for k in range(variants):
            page = Page(compose(paragraphs, n * variants + k))
            xs.append(page.features())
            ys.append(np.array([x is not None for x in page.label], float))
    return np.concatenate(xs), np.concatenate(ys)


def fit(pages: DataFrame, key: str = "page_id", source: str = "html", sample: int = SAMPLE) -> Boosted:
    """Boosted trees trained on pages composed from at most ``sample`` pages of the table."""
    rows = pages.filter(F.col(source).isNotNull()).select(F.xxhash64(F.col(key).cast("string"), F.col(source)).alias("place"), F.col(source).alias("html"))
    chosen = [r["html"] for r in rows.orderBy("place").limit(sample).collect()]
    return train(*labelled_nodes(chosen or [""] * 20))


def extract(pages: DataFrame, key: str = "page_id", address: str = "url", source: str = "html", sample: int = SAMPLE) -> DataFrame:
    """(key, address, text, n_chars) of every page."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([pages.schema[key], pages.schema[address], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    arrow = to_arrow_schema(schema)
    model = fit(pages, key, source, sample)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            sources = batch.column(2).to_pylist()
            for at in range(0, len(sources), 64):
                read = [Page(s) for s in sources[at : at + 64]]
                margins = model.margin(np.concatenate([p.features() for p in read]))
                ends = np.cumsum([len(p.tag) for p in read])
                texts += [p.text(p.decode(m)) for p, m in zip(read, np.split(margins, ends[:-1]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=arrow)

    return pages.select(key, address, text_of(source).alias("html")).mapInArrow(over, schema)

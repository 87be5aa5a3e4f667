"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between block-level tags, each
with the tags, classes and ids of its ancestors. Features of the ancestors and
of the text (length, share of linked text, punctuation) give a score for the
labels main and other, transitions tie neighbours together, and Viterbi finds
the best labelling of the page. Blocks labelled main are the text, in page
order. Weights are learned by maximum likelihood on labelled pages; by default
these are drawn by ``labelled_pages`` from a seeded grammar of page layouts.

Scripts, styles, comments of the markup and the head never form blocks.
Character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined by one space.

Defined cases: a null html is an empty page; an empty page, or one without main
blocks, has the empty text; unclosed and stray tags are tolerated, an unfinished
tag at the end is dropped; pages of any length are read whole; repeated rows
give equal rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import slices

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
#: A whole tag as most are, without < or > in quotes.
_PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_UNFINISHED = re.compile(r"</?[a-zA-Z!?][^>]*\Z")
#: Elements of the HTML standard by how they shape text (fixed values).
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg math iframe object title head canvas xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIST_ENDS = frozenset("ul ol dl table div article section main body form nav aside".split())


class Path:
    """The open elements that are not inline, by what the features say about them: the same for all blocks that share them."""

    __slots__ = ("found", "tag", "above", "in_head", "children", "_features")

    def __init__(self, found: dict[str, None], tag: str, above: str, in_head: bool):
        self.found, self.tag, self.above, self.in_head = found, tag, above, in_head
        self.children: dict[str, Path] = {}
        self._features: tuple[str, ...] | None = None

    def child(self, name: str) -> Path:
        there = self.children.get(name)
        if there is None:
            tag, own = _own_features(name)
            found = self.found if own.keys() <= self.found.keys() else self.found | own
            there = self.children[name] = Path(found, tag, self.tag, self.in_head or tag == "head")
            _KNOWN[0] += 1
        return there

    def features(self) -> tuple[str, ...]:
        """Tags of all ancestors, their class and id tokens, and the innermost two tags."""
        if self._features is None:
            self._features = (*self.found, "leaf:" + "/".join(filter(None, (self.above, self.tag))))
        return self._features


#: Paths that pages share, how many they are, and how many are kept for later pages.
_ROOT, _KNOWN, KEPT_PATHS = [Path({}, "", "", False)], [0], 20_000


@lru_cache(maxsize=20_000)
def _own_features(name: str) -> tuple[str, dict[str, None]]:
    tag, *names = name.split(".")
    own = dict.fromkeys(["in:" + tag, *("named:" + n for n in names)])
    if any(BESIDE.match(n) for n in names):
        own["beside"] = None
    return tag, own


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: Path, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def _names(tag: str, attributes: str) -> str:
    """``tag`` or ``tag.token.token`` with the tokens of class, id and role."""
    if "=" not in attributes:
        return tag
    tokens: list[str] = []
    for _, value in _ATTRIBUTE.findall(attributes):
        tokens += re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value.strip("\"'")).lower())
    return ".".join([tag, *dict.fromkeys(t for t in tokens if t)])


def tokens(page: str):
    """(start, end, closing, tag, attributes) of the page's tags; comments and declarations have no tag.

    Takes time in proportion to the page: what is known to have no end ahead is
    never looked for again.
    """
    last = {c: page.rfind(c) for c in ">\"'"}
    endless: set[int] = set()  # places outside quotes from which no > follows

    def close(at: int) -> int:
        seen = []
        while at not in endless:
            seen.append(at)
            stop = _STOP.search(page, at)
            if stop is None:
                break
            if stop[0] == ">":
                return stop.end()
            if stop.start() >= last[stop[0]]:
                break
            at = page.find(stop[0], stop.end()) + 1
        endless.update(seen)
        return page.find(">", seen[0] if seen else at) + 1  # a quote is never closed, so it is none

    at = page.find("<")
    while at >= 0:
        end, closing, tag, attributes = 0, "", "", ""
        if found := _PLAIN_TAG.match(page, at):
            closing, tag, attributes = found.groups()
            end, tag = found.end(), tag.lower()
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 4) + 3
            end = end if end > 2 else len(page)
        elif at < last[">"]:
            if page[at + 1] in "!?":
                end = page.find(">", at + 2) + 1
            elif found := _TAG.match(page, at):
                end = close(found.end())
                closing, tag, attributes = found[1], found[2].lower(), page[found.end() : end - 1]
        if end:
            at = (yield at, end, closing, tag, attributes) or end
        else:
            at += 1
        at = page.find("<", at)


def leaf_blocks(page: str) -> list[Block]:
    """The page's leaf blocks in page order."""
    blocks: list[Block] = []
    if _KNOWN[0] > KEPT_PATHS:
        _ROOT[0], _KNOWN[0] = Path({}, "", "", False), 0
    paths = [_ROOT[0]]  # of all open elements; an inline one has that of its parent
    tags: list[str] = []
    times: Counter[str] = Counter()
    parts: list[str] = []
    linked_parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text and not paths[-1].in_head:
                blocks.append(Block(paths[-1], text, sum(map(len, linked_parts))))
            parts.clear()
            linked_parts.clear()

    def pop_last(names: frozenset[str] | set[str], before: frozenset[str] = frozenset()) -> None:
        """Close the innermost element of a name, unless one of ``before`` is further in."""
        if not any(times[n] for n in names):
            return
        for depth in range(len(tags) - 1, -1, -1):
            if tags[depth] in names:
                times.subtract(tags[depth:])
                del tags[depth:], paths[depth + 1 :]
                return
            if tags[depth] in before:
                return

    def data(text: str) -> None:
        if text:
            parts.append(text)
            if times["a"] > 0:
                linked_parts.append(text)

    at, scan, resume = 0, tokens(page), None
    while True:
        try:
            start, end, closing, tag, attributes = scan.send(resume)
        except StopIteration:
            break
        resume = None
        data(page[at:start])
        at = end
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        if closing:
            pop_last({tag})
            continue
        if tag in RAW and tag != "head":
            if not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at, page.rfind(">") + 1)
                at = resume = close.end() if close else len(page)
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            pop_last({"p"})
        if tag in SAME:
            pop_last(SAME[tag], LIST_ENDS)
        if attributes.endswith("/") and tag not in INLINE and not _ATTRIBUTE.search(attributes):
            continue
        paths.append(paths[-1] if tag in INLINE else paths[-1].child(_names(tag, attributes)))
        tags.append(tag)
        times[tag] += 1
    data(_UNFINISHED.sub("", page[at:]))
    flush()
    return blocks


# ---------------------------------------------------------------- features


#: Names that page parts beside the main text usually bear (fixed values).
BESIDE = re.compile(
    r"(?:ads?|advert.*|sponsor.*|promo.*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|comments?|discussion|responses?|repl(?:y|ies)"
    r"|sidebar|widget|related|share|social|nav.*|menu|breadcrumbs?|pagination|pager|footer|masthead|newsletter|subscribe|signup|login|search|byline)\Z"
)


def text_features(block: Block, place: float) -> list[str]:
    text = block.text
    n, words = len(text), text.count(" ") + 1
    out = [
        f"words:{min(6, words.bit_length())}",
        f"linked:{min(4, int(4 * block.linked / n))}",
        f"end:{'stop' if text[-1] in '.!?…\"”»' else 'other'}",
        f"commas:{min(3, text.count(','))}",
        f"place:{int(4 * place)}",
    ]
    if "©" in text or "(c)" in text:
        out.append("copyright")
    if "|" in text or "»" in text or "›" in text:
        out.append("crumbs")
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    last = max(1, len(blocks) - 1)
    return [["bias", *b.path.features(), *text_features(b, min(0.99, i / last))] for i, b in enumerate(blocks)]


# ---------------------------------------------------------------- labelled pages


#: Surrounds a block's label inside a drawn page.
MARK = "\ue000"
_MARKED = re.compile("\ue000(\\d)\ue000")


def labelled_pages(count: int = 450, seed: int = 11) -> list[list[tuple[Block, int]]]:
    """Pages drawn from a grammar of layouts, as leaf blocks with the label 1 for main text."""
    rng = np.random.default_rng(seed)

    def pick(*options):
        return options[int(rng.integers(len(options)))]

    def chance(p: float) -> bool:
        return bool(rng.random() < p)

    def words(low: int, high: int, stop: bool = True) -> str:
        out = ["".join(pick("ta", "re", "in", "sol", "mé", "ka", "ür", "no", "th") for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(low, high)))]
        for i in range(6, len(out) - 1, 9):
            out[i] += pick(",", ".", "")
        return " ".join(out).capitalize() + ("." if stop else "")

    def mark(text: str, label: int) -> str:
        return f"{MARK}{label}{MARK}{text}"

    def inner(low: int, high: int, label: int = 0) -> str:
        """A few words, bare or in one of the elements that hold text."""
        text = mark(words(low, high, chance(0.6)), label)
        return pick("{}", "<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "<span>{}</span>", "<h3>{}</h3>", "<ul><li>{}</li></ul>").format(text)

    def wrapped(page: str) -> str:
        """Inside containers whose names tell nothing."""
        for _ in range(int(rng.integers(0, 3))):
            page = f"<div{pick('', ' class=container', ' class=wrapper', ' class=row', ' id=page', ' class=inner', ' class=col')}>{page}</div>"
        return page

    def links(n: int, label: int = 0) -> str:
        return "<ul>" + "".join(f"<li><a href='/x'>{mark(words(1, 3, False), label)}</a></li>" for _ in range(n)) + "</ul>"

    def paragraph(label: int) -> str:
        body = mark(words(*pick((1, 4), (6, 30), (30, 120)), chance(0.9)), label)
        if chance(0.2):
            body += f" <a href='/y'>{words(1, 4, False)}</a> {words(2, 9)}"
        if chance(0.2):
            body = f"<b>{mark(words(2, 9, chance(0.5)), label)}<br>" + ("<p>" + body if chance(0.7) else body)
        return f"<p>{body}</p>" if chance(0.9) else f"<div>{body}</div>"

    def noise(kind: str) -> str:
        if kind == "ad":
            return f"<{pick('div', 'section', 'aside')} class='{pick('ad', 'ads', 'advert', 'advertisement', 'banner', 'sponsored', 'promo', 'ad-slot')}'>{inner(3, 25)}</div>"
        if kind == "notice":
            return f"<div {pick('class', 'id')}='{pick('cookie', 'cookie-notice', 'notice', 'alert', 'consent', 'gdpr-banner', 'popup', 'modal')}'>{inner(4, 30)}{f"<button>{mark(words(1, 2, False), 0)}</button>" if chance(0.5) else ""}</div>"
        if kind == "form":
            return f"<form class='{pick('newsletter', 'subscribe', 'search', 'signup', 'login')}'><p>{mark(words(3, 15), 0)}</p><label>{words(1, 3, False)}</label><input><button>{mark(words(1, 2, False), 0)}</button></form>"
        if kind == "side":
            tag = pick("<aside>", "<div class='sidebar'>", "<aside class='related'>", "<div class='widget'>", "<div id='sidebar'>", "<section class='related-posts'>")
            return tag + f"<h3>{mark(words(1, 3, False), 0)}</h3>" + (links(int(rng.integers(2, 6))) if chance(0.6) else inner(2, 30)) + ("</aside>" if "aside" in tag else "</div>")
        if kind == "comments":
            each = "".join(f"<{pick('li', 'div', 'article')}{pick('', ' class=comment', ' class=reply')}>{inner(1, 40)}</div>" for _ in range(int(rng.integers(1, 5))))
            return f"<{pick('section', 'div')} {pick('id', 'class')}='{pick('comments', 'comment-list', 'discussion', 'responses', 'reader-comments')}'>{f"<h3>{mark(words(1, 3, False), 0)}</h3>" if chance(0.5) else ""}{each}</section></div>"
        if kind == "share":
            return f"<div class='{pick('share', 'social', 'tags', 'meta', 'byline', 'breadcrumb', 'pagination')}'>{links(3) if chance(0.5) else inner(1, 6)}</div>"
        if kind == "nav":
            return f"<{pick('nav', 'nav class=menu', 'div class=menu', 'div id=navigation', 'ul class=nav')}>{links(int(rng.integers(3, 9)))}</nav></div></ul>"
        if kind == "footer":
            return f"<{pick('footer', 'footer', 'div class=footer', 'div id=footer')}>{mark(pick('&copy; ', '') + words(3, 25), 0)}{links(3) if chance(0.3) else ''}</footer></div>"
        return f"<{pick('header', 'div class=header', 'div id=masthead')}>{inner(1, 8)}</header></div>"

    pages = []
    for _ in range(count):
        body = [noise(k) for k in ("header", "nav", "ad", "notice", "side") if chance({"nav": 0.8, "ad": 0.6}.get(k, 0.35))]
        opening, ending = pick(("<article>", "</article>"), ("<article>", "</article>"), ("<article class='post'>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ("<div class='content'>", "</div>"), ("<div id='main-content'>", "</div>"), ("<div class='post-body entry'>", "</div>"), ("<section class='story'>", "</section>"))
        main = [f"<h1>{mark(words(2, 12, chance(0.5)), 1)}</h1>"] if chance(0.9) else []
        for _ in range(int(rng.integers(1, 14))):
            main.append(paragraph(1))
            if chance(0.06):
                main.append(pick(f"<h2>{mark(words(1, 6, False), 1)}</h2>", f"<blockquote>{mark(words(5, 30), 1)}</blockquote>", f"<ul><li>{mark(words(2, 20), 1)}</li><li>{mark(words(2, 20), 1)}</li></ul>", f"<pre>{mark(words(3, 12, False), 1)}</pre>", f"<table><tr><td>{mark(words(1, 4, False), 1)}</td><td>{mark(words(1, 4, False), 1)}</td></tr></table>", f"<figure><figcaption>{mark(words(3, 12), 1)}</figcaption></figure>"))
            if chance(0.2):
                main.append(noise(pick("ad", "ad", "form", "side", "share", "notice", "comments")))
        body += [opening + wrapped("".join(main)) + ending]
        body += [noise(k) for k in ("share", "side", "comments", "form", "ad", "nav") if chance(0.3)]
        body += [noise("footer")] if chance(0.85) else []
        labelled = []
        for block in leaf_blocks("<html><body>" + wrapped("".join(body)) + ("</body></html>" if chance(0.8) else "")):
            found = _MARKED.search(block.text)
            label = int(found[1]) if found else 0
            block.text = _MARKED.sub("", block.text)
            block.linked = min(block.linked, len(block.text))
            if block.text:
                labelled.append((block, label))
        pages.append(labelled)
    return pages


# ---------------------------------------------------------------- the field

Model = tuple[dict[str, tuple[float, float]], np.ndarray]


def train(pages: list[list[tuple[Block, int]]], epochs: int = 20, penalty: float = 2e-4, seed: int = 3) -> Model:
    """Maximum likelihood by Adam; the gradient comes from forward and backward passes over each page."""
    index: dict[str, int] = {}
    coded = []
    for page in pages:
        if page:
            rows = [np.array(sorted({index.setdefault(f, len(index)) for f in fs})) for fs in features([b for b, _ in page])]
            coded.append((rows, np.array([label for _, label in page])))
    weight, moves = np.zeros((len(index), 2)), np.zeros((2, 2))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weight, moves)]
    rng, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(coded)), max(1, len(coded) // 16)):
            g_weight, g_moves = penalty * weight * len(at), np.zeros((2, 2))
            for k in at:
                rows, y = coded[k]
                score = np.array([weight[r].sum(0) for r in rows])
                n = len(y)
                ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
                ahead[0] = score[0]
                for i in range(1, n):
                    ahead[i] = score[i] + np.logaddexp(ahead[i - 1, 0] + moves[0], ahead[i - 1, 1] + moves[1])
                for i in range(n - 2, -1, -1):
                    ahead_next = back[i + 1] + score[i + 1]
                    back[i] = np.logaddexp(moves[:, 0] + ahead_next[0], moves[:, 1] + ahead_next[1])
                total = np.logaddexp(*ahead[-1])
                marginal = np.exp(ahead + back - total)
                for r, m, label in zip(rows, marginal, y, strict=True):
                    g_weight[r] += m
                    g_weight[r, label] -= 1
                if n > 1:
                    pair = np.exp(ahead[:-1, :, None] + moves[None] + (score[1:] + back[1:])[:, None, :] - total)
                    g_moves += pair.sum(0)
                    np.add.at(g_moves, (y[:-1], y[1:]), -1)
            step += 1
            for x, g, s in zip((weight, moves), (g_weight / len(at), g_moves / len(at)), state, strict=True):
                s[0] += 0.1 * (g - s[0])
                s[1] += 0.01 * (g * g - s[1])
                x -= 0.08 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
    return {name: (float(weight[i, 0]), float(weight[i, 1])) for name, i in index.items()}, moves


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def decode(blocks: list[Block], model: Model) -> list[int]:
    """The most likely labels by Viterbi."""
    if not blocks:
        return []
    weights, moves = model
    (m00, m01), (m10, m11) = moves.tolist()
    back: list[tuple[int, int]] = []
    other = main = 0.0
    for i, names in enumerate(features(blocks)):
        s0 = s1 = 0.0
        for name in names:
            if (w := weights.get(name)) is not None:
                s0 += w[0]
                s1 += w[1]
        if i:
            from0, from1 = other + m00 < main + m10, other + m01 < main + m11
            back.append((int(from0), int(from1)))
            other, main = s0 + (main + m10 if from0 else other + m00), s1 + (main + m11 if from1 else other + m01)
        else:
            other, main = s0, s1
    label = int(main > other)
    out = [label]
    for choice in reversed(back):
        label = choice[label]
        out.append(label)
    return out[::-1]


def main_text(page: str | None, model: Model) -> str:
    blocks = leaf_blocks(page or "")
    return " ".join(b.text for b, label in zip(blocks, decode(blocks, model), strict=True) if label)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, main text and its code points for every page."""
    model = model or default_model()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(x, model) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    columns = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return pages.select(*columns).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))

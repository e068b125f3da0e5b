"""Main text of web pages: two-pass block rules.

A page is cut into blocks at block-level tags. Blocks inside menus, headers, footers, forms, scripts, comments and the
like are out by structure. In the first pass the others are judged by their length, the density of stop words and the
density of links: good, bad, or short and undecided. In the second pass undecided blocks inherit the label of their
nearest decided neighbours. What a page marks as its article is a weak prior: blocks within it start one step better, which
links and neighbours can outvote, and no block is out because it stands outside.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Elements by their role in HTML.
SKIPPED = frozenset("script style noscript template head title svg math iframe object embed canvas audio video select textarea button form nav footer aside menu dialog fieldset".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option optgroup".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag closes if they are the nearest ones open (end tags that may be left out).
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id or role that mark a part which is not the article.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|advertorial|sponsor(?:ed|s)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login"
    r"|nav|navbar|navigation|menu|menus|breadcrumbs?|pagination|pager|sidebar|side|aside|rail|widget|footer|foot|header|masthead|topbar|toolbar|comments?|commentlist|disqus|replies|reply|respond|discussion"
    r"|share|sharing|social|related|recommended|recommendations|more-stories|tags|toc|search|form|copyright|legal|disclaimer|complementary|contentinfo|skip)(?:$|[\s_-]|\d)",
    re.I,
)
#: Parts that a layout has or lacks say nothing about the element itself.
LAYOUT = re.compile(r"^(?:has|with|no|without)[_-]", re.I)
#: A class or id that names the article itself.
MAIN = re.compile(r"(?:^|\s)(?:(?:article|post|entry|story|main|page)[_-]?)?(?:content|body|text|main|article|post|entry|story)(?:$|\s)", re.I)

#: Frequent function words of the languages that pages come in.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i if in is it its not of on or our she so that the their them they this to was we were which who will with you your "
    "au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous ou par pas pour qu que qui sa se ses son sur un une vous "
    "als am auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht noch sich sie sind so über um und von war wie wir zu zum zur "
    "al como con del el ella en entre era es esta este fue ha hay la las lo los más me mi no para pero por que se sin sobre su sus también un una y ya".split()
)

#: Characters of scripts that put no space between words, and frequent function words of languages written in them.
UNSPACED = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")
UNSPACED_STOPS = re.compile("[のはをにがでともてた的了是在和不有我]|ที่|และ|ใน|ของ|เป็น|การ|ได้|ไม่")

#: A quote that is never closed is an ordinary character of its tag.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|$)", re.I) for t in RAW}

LONG, SHORT = 25, 12  # words
STOPS_HIGH, STOPS_LOW, LINKS_MOST = 0.22, 0.10, 0.4


class Block:
    __slots__ = ("text", "linked", "heading", "main")

    def __init__(self, text: str, linked: int, heading: bool, main: bool):
        self.text, self.linked, self.heading, self.main = text, linked, heading, main


def _marks(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is out by structure, and whether it is marked as the article."""
    if tag in SKIPPED:
        return True, False
    names = ""
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return True, False
            if name in ("class", "id", "role"):
                names += " " + value
    if tag in ("article", "main"):
        return bool(names) and bool(re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", names, re.I)), True
    if names and tag not in ("body", "html"):
        gone = any(BOILERPLATE.search(name) and not LAYOUT.match(name) for name in names.split())
        return gone, not gone and bool(MAIN.search(names))
    return False, False


def blocks(page: str) -> list[Block]:
    """The blocks of a page outside skipped parts, in page order; white space within a block is one space."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool]] = []  # tag, skipped, article
    skip = main = anchors = 0
    at = 0

    def flush(heading: bool = False) -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, linked, heading, main > 0))
            parts.clear()
        linked = 0

    def pop() -> str:
        nonlocal skip, main
        tag, out_, main_ = stack.pop()
        skip -= out_
        main -= main_
        return tag

    size = len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        end = found.start() if found else size
        if end > at and not skip:
            piece = html.unescape(page[at:end])
            parts.append(piece)
            if anchors:
                linked += len(" ".join(piece.split()))
        if not found:
            break
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        if found[1]:  # an end tag
            if tag == "a":
                anchors = max(0, anchors - 1)
            if tag in BLOCKS:
                flush(tag in ("h1", "h2", "h3", "h4", "h5", "h6"))
            if tag == "p":
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    while len(stack) > i:
                        pop()
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            anchors = 1
        if tag in BLOCKS:
            flush()
            anchors = anchors if tag != "p" else 0
        if tag in VOID or found[3].endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            close = _END[tag].search(page, at)
            at = close.end() if close else size
            continue
        if tag in CLOSED_BY and stack and stack[-1][0] in CLOSED_BY[tag]:
            pop()
        if tag == "body":
            while any(t == "head" for t, *_ in stack):
                pop()
        gone, article = _marks(tag, found[3])
        if tag == "header":  # the article's own header holds its title
            gone = gone or not main
        if tag == "p" or tag not in BLOCKS and tag not in SKIPPED and not gone:
            if not gone:
                continue
            if tag == "p":  # a skipped paragraph ends where the next block starts
                close = re.compile(r"</?(?:p|div|section|article|ul|ol|table|h[1-6]|footer|body)\b[^>]*>", re.I).search(page, at)
                at = close.start() if close else size
                continue
        stack.append((tag, gone, article))
        skip += gone
        main += article
    flush()
    return out


def _words(text: str) -> tuple[int, float]:
    """Number of words and share of stop words; where a script has no spaces, two characters count as a word."""
    bare = len(UNSPACED.findall(text))
    if 2 * bare > len(text):
        n = max(1, bare // 2)
        return n, len(UNSPACED_STOPS.findall(text)) / n
    words = text.split()
    return len(words), sum(w.lower().strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)


def first_pass(block: Block) -> str:
    """good, bad, near-good or short, by link density, length and stop-word density."""
    if block.linked > LINKS_MOST * len(block.text):
        return "bad"
    n, stops = _words(block.text)
    if "©" in block.text and n < LONG:
        return "bad"
    if n >= LONG:
        return "good" if stops >= STOPS_HIGH else "near-good" if stops >= STOPS_LOW else "bad"
    if n >= SHORT and stops >= STOPS_HIGH:
        return "near-good"
    return "short"


def with_mark(kind: str, block: Block) -> str:
    """The kind of a block within a marked article, one step better: near-good ones are good, short ones and long ones with few stop words (code, tables) are near-good, so that one good neighbour suffices. Links and a copyright line stay bad."""
    if not block.main:
        return kind
    if kind == "bad":
        few_stops = block.linked <= LINKS_MOST * len(block.text) and _words(block.text)[0] >= LONG
        return "near-good" if few_stops else "bad"
    return "good" if kind in ("good", "near-good") else "near-good"


def second_pass(kinds: list[str]) -> list[bool]:
    """Undecided blocks take the label of their nearest decided neighbours: near-good ones if either is good, short ones if both are."""
    n = len(kinds)
    before, after = ["bad"] * n, ["bad"] * n
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = "bad"
        for i in order:
            side[i] = last
            if kinds[i] in ("good", "bad"):
                last = kinds[i]
    return [k == "good" or k == "near-good" and "good" in (before[i], after[i]) or k == "short" and before[i] == after[i] == "good" for i, k in enumerate(kinds)]


def extract(page: str | None) -> str:
    """The main text of a page, blocks joined by two line feeds; empty for null or a page without any."""
    if not page:
        return ""
    found = blocks(page)
    kinds = [with_mark(first_pass(b), b) for b in found]
    keep = second_pass(kinds)
    for i, b in enumerate(found):  # a heading goes with the text under it
        if b.heading and not keep[i] and kinds[i] != "bad":
            keep[i] = i + 1 < len(found) and keep[i + 1]
    for last in ("near-good", "short"):  # a page without any decided text consists of what comes nearest to it
        if not any(keep):
            keep = [k == last for k in kinds]
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


def html_extract(pages: DataFrame) -> DataFrame:
    """A row for each row of pages (page_id, url, html): page_id, url, text, n_chars (code points of text).

    The whole html is read; null and empty pages, and pages without text, have an empty text. Broken markup ends nothing:
    an open tag, comment or script that is never closed reaches to the end, and a quote that is never closed ends with its
    tag. A page whose blocks are all undecided consists of its near-good blocks or, without any, of its short ones. Repeated rows repeat their texts; other columns
    are ignored. Memory: one page at a time beside the batch.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) AS page_id", "cast(url as string) AS url", "cast(html as string) AS html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

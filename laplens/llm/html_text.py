"""Main-text extraction by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides what it can: blocks in an article or main
element are text, blocks in navigation, headers, footers, asides, forms, notices, adverts and comments are not, and
elsewhere link density, stop-word density and length decide. Short or middling blocks stay open, as do those without
links and stop words (tables, code, other languages). On pages without an article, the second pass gives them the label
of the nearer decided block outside page furniture, text on a tie and where nothing is decided; headings before text are
text. On pages with one, they are text only between blocks of text.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laplens.session import ship

#: Pages handled at a time; bounds memory.
BLOCK = 64

# HTML's block-level, void and raw-text elements, and the words that mark page furniture.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section
summary table tbody td tfoot th thead tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = ("script", "style", "noscript", "template", "textarea", "select", "button", "iframe", "object", "svg", "math", "canvas", "audio",
          "video", "title", "head")
FURNITURE = frozenset("nav footer aside menu dialog header search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar
navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar sidenav aside widget widgets cookie cookies consent gdpr
notice notices notification alert popup modal overlay newsletter subscribe subscription signup login form search share sharing social
related recommended recommendations comment comments commentlist disqus reply replies respond pagination pager copyright hidden""".split())
# Of these, the ones that turn an article or main element into something else; there, other words speak of the layout.
ARTICLE_WORDS = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related".split())
# A class such as "with-sidebar" speaks of what stands elsewhere.
MODIFIERS = frozenset("has with no without is not js".split())
# Function words of the languages that the rules were made for.
STOP = frozenset("""a an and are as at be by for from had has have he her his i in is it not of on or she that the their they this to was we were
which will with you au aux ce ces dans de des du elle en est et il la le les leur ne nous on ou par pas pour qui que sa se ses son sur un une
vous al como con del el es esta este los las lo más no para pero por se sin su sus una uno y aber als auch auf aus bei das dem den der die
ein eine einer er für hat ich im ist mit nach nicht sich sie sind so über und von war was wie wird zu zum zur""".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z](?:[^<>"']|"[^"]*"|'[^']*')*>|<(?=/?[A-Za-z])[^<>]*(?:>|(?=<)|\Z)|<|[^<]+""", re.S)
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
HINTS = re.compile(r"""\s(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
PARTS = re.compile(r"[^0-9a-z]+")
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in SILENT}


#: Places below 0: in a form, which may hold a whole page, and in page furniture, which holds no text whatever is inside.
FORM, OUT = -1, -2


def is_furniture(name: str, tag: str, in_article: bool) -> bool:
    if name in FURNITURE and not (name == "header" and in_article):
        return True
    for key, value in HINTS.findall(tag):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key == "role" and value in ROLES and name not in ("article", "main"):
            return True
        if key in ("class", "id"):
            words = ARTICLE_WORDS if name in ("article", "main") else WORDS
            for token in value.split():
                parts = PARTS.split(token)
                if parts[0] not in MODIFIERS and not words.isdisjoint(parts):
                    return True
    return False


def blocks(page: str) -> list[tuple[str, int, int, bool]]:
    """(text, place, linked characters, heading or not) of each block with text; place is 1 in an article, below 0 in forms and
    page furniture, else 0."""
    out: list[tuple[str, int, int, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # open block elements, and the place that holds within them
    place, in_link, linked, at = 0, 0, 0, 0

    def close() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.append((whole, place, linked, any(n in HEADINGS for n, _ in stack)))
            text.clear()
        linked = 0

    while at < len(page):
        m = TOKEN.match(page, at)
        token, at = m.group(), m.end()
        if token[0] != "<" or token == "<":
            text.append(token)
            linked += len(token.strip()) if in_link else 0
            continue
        found = NAME.match(token)
        if not found or token[-1] != ">":  # comments, declarations, and a tag that the end of the page cuts off
            if found:
                text.append(" ")
            continue
        name, ends = found.group(1).lower(), token[1] == "/"
        if name in ENDS and not ends:
            if name in ("head", "button", "select"):
                close()
            if token[-2] != "/" or name in ("script", "style", "title", "head"):
                end = ENDS[name].search(page, at)
                if end:
                    at = end.end()
                elif name == "head":  # without its end, the head lasts to the body
                    body = re.compile(r"<body\b", re.I).search(page, at)
                    at = body.start() if body else at
                else:
                    at = len(page)
            text.append(" ")
        elif name == "a":
            in_link = 0 if ends else 1
        elif name == "br":
            text.append(" ")
        elif name in BLOCKS or stack and ends and any(n == name for n, _ in stack):
            close()
            in_link = 0
            if ends:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                place = stack[-1][1] if stack else 0
                continue
            if stack and stack[-1][0] == "p":  # a paragraph ends where the next block begins
                stack.pop()
                place = stack[-1][1] if stack else 0
            if name not in VOID and name not in ("p", "html", "body"):
                if place > OUT:
                    if is_furniture(name, token, place == 1):
                        place = OUT
                    elif name in ("article", "main"):
                        place = 1
                    elif name == "form":
                        place = FORM
                stack.append((name, place))
            elif name == "p" and place > OUT and is_furniture(name, token, True):
                stack.append((name, OUT))
                place = OUT
    close()
    return out


def label(text: str, place: int, linked: int, short: int, long: int, links: float, low: float, high: float) -> int:
    """First pass: 1 text, -1 not, 0 open."""
    if place:
        return 1 if place > 0 else -1
    density = linked / max(len(text), 1)
    if density > links:
        return -1
    if len(text) < short:
        return -1 if density else 0
    words = text.lower().split()
    stop = sum(w.strip(".,;:!?()\"'") in STOP for w in words) / max(len(words), 1)
    if stop >= high:
        return 1 if len(text) >= long else 0
    return 0 if stop >= low or not linked else -1


def inherit(first: list[int], heading: list[bool]) -> list[int]:
    """Second pass over the blocks outside page furniture, on a page without an article."""
    if not any(first):
        return [1] * len(first)
    at = [i for i, x in enumerate(first) if x]
    out, right = list(first), len(at)
    for i in range(len(first) - 1, -1, -1):
        if first[i]:
            right -= 1
            continue
        near = [(abs(j - i), -first[j]) for j in at[max(right - 1, 0): right + 1]]
        out[i] = 1 if heading[i] and i + 1 < len(first) and out[i + 1] == 1 else -min(near)[1]
    return out


def main_text(page: str | None, short: int = 70, long: int = 140, links: float = 0.34, low: float = 0.12, high: float = 0.2) -> str:
    """The blocks of text, in page order, with an empty line between them."""
    found = blocks(page or "")
    first = [label(*b[:3], short, long, links, low, high) for b in found]
    if all(b[1] < 1 for b in found):
        free = [i for i, b in enumerate(found) if not b[1]]
        labels = inherit([first[i] for i in free], [found[i][3] for i in free])
        return "\n\n".join(found[i][0] for i, x in zip(free, labels) if x == 1)
    before, after, last = [], [], 0
    for x in first:
        before.append(last)
        last = x or last
    last = 0
    for x in reversed(first):
        after.append(last)
        last = x or last
    after.reverse()
    kept = [b[0] for b, x, left, right in zip(found, first, before, after) if x == 1 or x == 0 and ((left or right) == 1 and (right or left) == 1)]
    return "\n\n".join(kept)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), **rules) -> DataFrame:
    """One row per row of ``pages``: id, the ``keep`` columns, ``text`` (empty if a page has none) and ``n_chars`` (code points).

    Whole pages are read. A null page is empty. Repeated rows are extracted each. Other columns are not read. Pages that break off keep
    what they have; of a tag that is cut off nothing stays. An empty table gives no rows."""
    ship(pages.sparkSession)
    source = pages.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(html_col).alias("html"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", text string, n_chars long"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                texts = [main_text(p, **rules) for p in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                                 [*part.schema.names[:-1], "text", "n_chars"])

    return source.mapInArrow(run, schema).withColumnsRenamed({"id": id_col} | {f"k{i}": c for i, c in enumerate(keep)})

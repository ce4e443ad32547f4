"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score positive by where they stand (paragraph,
heading, list, table, other; in a link or not) and tags negative by their name; one linear scan
finds the contiguous region of the largest sum.  The weights are log-odds counted on labelled
pages: those that mark their article as one ``article`` element, a bounded sample of them.

What a box is called (class, id, role) has a weight too: the log-odds of its words, counted on the
labelled pages, on top of a prior for a few common names of adverts, comments, menus and the like,
which the counts can overrule.  An article element speaks for what it holds.  A box whose weight is
at most SHUT is no content: it scores nothing and gives no text wherever it stands.  Paragraphs,
headings and list items are never judged by a name, nor is a box around the one article or main
element of a page, or one that holds over half of its paragraph words; there, and above SHUT, a
negative weight only lowers the score of words by a learnt factor.  Elements that are no content by
definition (navigation, footers, forms, scripts, hidden parts and so on) give no text either.

The element that is the article, if the page has one: the ``article`` (else ``main``) that holds over
half of the paragraph words, parts of no content not counted.  Where there is one, words score by
that too: outside it they count against a region, but for headings before it, and inside it every
place of words has at least half the weight of paragraphs, while the tags before a group of words
take at most half of its score.  So lists, tables, bare boxes and deep nesting cut nothing off it.
Inside an article a name speaks against a box only if all its words do or are words of layout:
``ad-box`` does, ``ad-prices`` does not.

Character references are decoded, white space inside a block becomes one space, blocks are joined
in page order by one space.  Null or empty html, and pages without positive region, give the empty
text.  Unclosed and stray tags are tolerated, a tag with an unclosed quote ends at its first ``>``,
and the time is linear in the page whatever is broken; ties go to the earliest region.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltsheaf.llm.common import arrow_map, as_batch, slices

SAMPLE_PAGES = 2000
#: An element or a name counts if it is on one of so many labelled pages at least, which bounds the weights.
RARE = 200
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
TEXT = re.compile(r"<[^<]*|[^<]+")
STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
# fixed values: names of HTML elements, and words that class names give to parts around an article
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "object"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
INLINE |= {"math", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mstyle", "semantics"}
BOXES = {"article", "aside", "blockquote", "body", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "head", "header", "html", "li", "main", "menu", "nav", "ol", "section", "select", "button", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "p", "h1", "h2", "h3", "h4", "h5", "h6", "pre"}
NO_CONTENT = {"nav", "footer", "aside", "form", "head", "menu", "select", "button", "dialog", "fieldset"}
JUDGED = {"div", "section", "ul", "ol", "dl", "details", "figure", "header", "table", "td"}
PRIOR = dict.fromkeys("ad advert adverts advertisement advertising adsense comment comments commentlist disqus reply replies respond share sharing consent cookie cookies gdpr newsletter".split(), -6.0)
PRIOR |= dict.fromkeys("ads banner breadcrumb breadcrumbs copyright dropdown footer login menu modal nav navbar navigation navlinks pager pagination popup promo promoted recommended related search searchbox sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar trending widget widgets complementary contentinfo header masthead notice notices alert side meta".split(), -3.0)
#: Words of layout, which tell nothing of what a box holds.
LAYOUT = set("area bar block body bottom box button buttons container content group header icons inner item items left link links list main outer panel right row section slot title top unit wrap wrapper zone".split())
#: A class that starts so tells of the page or the topic and names no part: no-sidebar, tag-search.
TELLS = re.compile(r"(?:no|not|has|with|without|category|tag)[-_]", re.I)
CLOSES_P = BOXES - {"td", "th", "li", "dd", "dt", "tr", "tbody", "thead", "tfoot", "html", "body", "head"}
PLACES = dict.fromkeys(("p", "pre", "blockquote"), "word:p") | dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "word:head") | dict.fromkeys(("li", "dd", "dt"), "word:list") | dict.fromkeys(("td", "th"), "word:table") | dict.fromkeys(("div", "section", "article", "main", "body"), "word:other")
DEFAULT = {"word:p": 1.0, "word:head": 0.5, "word:list": 0.3, "word:table": 0.3, "word:other": 0.3, "word:link": 0.05, "named": 0.5}
LEAST = 0.05
#: What a word scores outside the page's article.
OUTSIDE = -0.5
#: Least factor of the score of words in a box that was kept though its names speak against it.
LEAST_NAMED = 0.25
#: A box of this weight or less is no content; what an article element adds; the largest weight of a name.
SHUT, ARTICLE, MOST = -3.0, 3.0, 8.0


def attributes_of(source: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of a name counts, as in browsers."""
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), next((v for v in values if v), ""))
    return out


def names_of(attributes: dict[str, str]) -> list[str]:
    """Class names, id and roles that may name a part."""
    return [n.lower() for key in ("class", "id", "role") for n in attributes.get(key, "").split() if not TELLS.match(n)]


def prior_of(name: str, inside: bool) -> float:
    """The least prior of a name's words; inside an article none, if a word neither has one nor is of layout."""
    words = [x for x in re.split(r"[-_\d]+", name) if x]
    if inside and any(x not in PRIOR and x not in LAYOUT for x in words):
        return 0.0
    return min((PRIOR[x] for x in words if x in PRIOR and not (inside and x in LAYOUT and len(words) > 1)), default=0.0)


def weight_of(names: list[str], weights: dict[str, float], inside: bool) -> float:
    """The least weight of the names: what was learnt, on top of the prior of their words."""
    return min((max(-MOST, min(MOST, weights.get("name:" + n, 0.0) + prior_of(n, inside))) for n in names), default=0.0) + ARTICLE * inside


def tag_stop(page: str, at: int, dead: set[int]) -> int:
    """Where the tag whose attributes begin at ``at`` ends: at a ``>`` outside quotes, else at the first.

    dead: quotes already known to lead to no end; they make broken pages linear.
    """
    i, seen = at, []
    while m := STOP.search(page, i):
        j = m.start()
        if page[j] == ">":
            return j
        if j in dead:
            break
        seen.append(j)
        i = page.find(page[j], j + 1) + 1
        if not i:
            break
    dead.update(seen)
    return page.find(">", at)


class Box:
    """An open box with names: its parent, what it is called, its weight, and the words it holds.

    low: it or a box around it, in the same article, has a weight that would shut it.
    """

    __slots__ = ("parent", "names", "weight", "area", "low", "words", "paragraphs")

    def __init__(self, parent: Box | None, names: list[str], weight: float, area: int) -> None:
        self.parent, self.names, self.weight, self.area, self.words, self.paragraphs = parent, names, weight, area, [0, 0], 0
        self.low = weight <= SHUT or (parent is not None and parent.area == area and parent.low)


class Area:
    """An article element, or a main one around them: its name, the one around it, its box, and the words it holds."""

    __slots__ = ("name", "parent", "box", "words", "paragraphs")

    def __init__(self, name: str, parent: int, box: Box | None) -> None:
        self.name, self.parent, self.box, self.words, self.paragraphs = name, parent, box, 0, 0


def article_of(areas: list[Area], words: int, paragraphs: int) -> int | None:
    """Number of the article (else main) element that holds over half of the page's paragraph words, or of all if there are none."""
    for area in reversed(areas):  # an area comes after the one around it
        if area.parent >= 0:
            areas[area.parent].words += area.words
            areas[area.parent].paragraphs += area.paragraphs
    for name in ("article", "main"):
        for k, area in enumerate(areas):
            if area.name == name and 2 * (area.paragraphs if paragraphs else area.words) > (paragraphs or words):
                return k
    return None


def tokens(page: str, weights: dict[str, float], boxes: list[Box] | None = None):
    """(kind, text, shut, inside, named, side) of a page: kind is a word place or a tag name; shut: in a
    part that is no content; inside: in an article element; named: in a box kept despite its names;
    side: before (-1), in (0) or after (1) the page's article, None if it has none."""
    boxes, areas, around = [] if boxes is None else boxes, [], []
    words = total = held = held_paragraphs = 0
    for kind, text, shut, inside, box, area in scanned(page, weights, boxes, areas, None):
        if text is None:
            if kind == "open":
                around.append(box)
        elif not shut and kind != "word:link":
            n = len(text.split())
            paragraphs = n if kind == "word:p" else 0
            total += n
            words += paragraphs
            if box is not None:
                box.words[inside] += n
                box.paragraphs += paragraphs
            if box is None or box.area != area or not box.low:
                held += n
                held_paragraphs += paragraphs
                if area >= 0:
                    areas[area].words += n
                    areas[area].paragraphs += paragraphs
    for box in reversed(boxes):  # a box comes after the one around it
        if box.parent is not None:
            box.parent.words[0] += box.words[0]
            box.parent.words[1] += box.words[1]
            box.parent.paragraphs += box.paragraphs
    keep = {k for k, box in enumerate(boxes) if 2 * (box.paragraphs if words else sum(box.words)) > (words or total)}
    article = article_of(areas, held, held_paragraphs)
    if article is not None or len(around) == 1:
        at, number = around[0] if article is None else areas[article].box, {id(box): k for k, box in enumerate(boxes)}
        while at is not None:
            keep.add(number[id(at)])
            at = at.parent
    within = set()
    for k, area in enumerate(areas):
        if k == article or area.parent in within:
            within.add(k)
    side = None if article is None else -1
    for kind, text, shut, inside, box, area in scanned(page, weights, boxes, areas, keep):
        if side is not None:
            side = 0 if area in within else 1 if side >= 0 else -1
        if kind != "open":
            yield kind, text, shut, inside, box is not None and box.weight < 0, side


def scanned(page: str, weights: dict[str, float], boxes: list[Box], areas: list[Area], keep: set[int] | None):
    """Tokens with the innermost open box that has names.  The first scan (keep is None) fills boxes and areas and
    shuts none for its names, the second shuts those of weight SHUT that are not in keep.  An article
    or main element that opens is told as kind "open"."""
    # name, shut, index of the outermost shut one, in article, box, place of words, number of the area
    stack: list[tuple[str, bool, int, bool, Box | None, str, int]] = []
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a name
    last, dead, met, opened = page.rfind(">"), set(), 0, 0
    nothing = ("", False, -1, False, None, "word:other", -1)
    link, raw, at = 0, None, 0

    def drop(to: int) -> None:
        while len(stack) > to:
            places[stack.pop()[0]].pop()

    while at < len(page):
        if raw is not None:
            end = re.compile(rf"</{re.escape(raw)}\s*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            raw = None
            continue
        _, shut, root, inside, box, place, area = stack[-1] if stack else nothing
        text = tag = None
        if page[at] != "<" or at > last:
            text = TEXT.match(page, at).group()
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 2)  # <!--> is an empty comment
            at = end + 3 if end >= 0 else len(page)
            continue
        elif page.startswith(("<!", "<?"), at):
            at = page.find(">", at) + 1
            continue
        elif (tag := TAG.match(page, at)) is None:
            text = TEXT.match(page, at).group()
        if text is not None:
            at += len(text)
            yield "word:link" if link else place, text, shut, inside, box, area
            continue
        stop = tag_stop(page, tag.end(), dead)
        attributes, at = page[tag.end() : stop], stop + 1
        name, closing = tag.group(2).lower(), bool(tag.group(1))
        yield "tag:" + name, None, shut, inside, box, area
        if name == "a":
            link = 0 if closing else 1
        if not closing and name in RAW and not attributes.endswith("/"):
            raw = name
            continue
        if name not in BOXES:
            continue
        if closing:
            k = places[name][-1] if places[name] else -1
            # a stray end inside a part that is no content does not leave it
            stray = name in ("p", "li", "td", "tr") and k < root and stack[root][0] not in ("p", "li")
            if k >= 0 and not stray:
                drop(k)
                link = 0
            continue
        if stack and (stack[-1][0] == "p" and name in CLOSES_P or name == "li" and stack[-1][0] == "li"):
            drop(len(stack) - 1)
            _, shut, root, inside, box, place, area = stack[-1] if stack else nothing
        has = attributes_of(attributes) if attributes else {}
        named = names_of(has) if has and (name in JUDGED or (name == "article" and inside)) else []
        if named:
            if keep is None:
                boxes.append(Box(box, named, weight_of(named, weights, inside), area))
            box = boxes[met]
            met += 1
        if not shut:
            shut = name in NO_CONTENT or (name == "header" and not inside) or "hidden" in has or has.get("aria-hidden", "").lower() == "true" or bool(UNSEEN.search(has.get("style", "")))
            shut = shut or bool(named and keep is not None and box.weight <= SHUT and met - 1 not in keep)
            root = len(stack) if shut else -1
        if name in ("article", "main") and not shut and not inside:
            yield "open", None, shut, inside, box, area
        if area < 0 and name in ("article", "main") or name == "article" and areas[area].name == "main":
            if keep is None:
                areas.append(Area(name, area, box))
            area, opened = opened, opened + 1
        places[name].append(len(stack))
        stack.append((name, shut, root, inside or (name in ("article", "main") and not shut), box, PLACES.get(name, place), area))


def main_text(page: str, weights: dict[str, float]) -> str:
    """The text of the best region: a linear scan for the maximum-scoring subsequence."""
    kept: list[tuple[str, str | None]] = []
    best_sum, best_from, best_to, run_sum, run_from, owed = 0.0, 0, 0, 0.0, 0, 0.0
    for kind, text, shut, _, named, side in tokens(page, weights):
        if text is not None:
            n = 0 if shut else len(text.split())
            weight = weights.get(kind, DEFAULT["word:other"])
            if side == 0 and kind != "word:link":
                weight = max(weight, weights.get("word:p", DEFAULT["word:p"]) / 2)
            elif side == 1 or (side == -1 and kind != "word:head"):
                weight = OUTSIDE
            score = n * weight * (weights.get("named", DEFAULT["named"]) if named and weight > 0 else 1.0)
            if side == 0 and n:  # the tags since the last words
                score, owed = score - min(owed, score / 2), 0.0
        else:
            score = 0.0 if shut else weights.get(kind, -LEAST)
            if side == 0:
                score, owed = 0.0, owed - score
        kept.append((kind, None if shut else text))
        if run_sum <= 0.0:
            run_sum, run_from = 0.0, len(kept) - 1
        run_sum += score
        if run_sum > best_sum:
            best_sum, best_from, best_to = run_sum, run_from, len(kept)
    out = []
    for kind, text in kept[best_from:best_to]:
        if text is not None:
            out.append(text)
        elif kind.startswith("tag:") and kind[4:] not in INLINE:
            out.append(" ")
    return " ".join(entities.unescape("".join(out)).split())


def counts_of(page: str) -> dict[tuple[str, bool], int]:
    """How often each kind stands inside and outside the article, of a page that has just one."""
    out: dict[tuple[str, bool], int] = defaultdict(int)
    boxes: list[Box] = []
    for kind, text, shut, inside, named, _ in tokens(page, {}, boxes):
        if kind in ("tag:article", "tag:main"):
            continue
        n = 1 if text is None else len(text.split())
        out[kind, inside] += n
        if named and not shut and text is not None:
            out["named", inside] += n
    for box in boxes:
        for name in dict.fromkeys(box.names):
            for inside in (False, True):
                out["name:" + name, inside] += box.words[inside]
    return dict(out)


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from a bounded sample of labelled pages; the defaults where there is none."""
    rows = pages.select(F.col("html").cast("string").alias("html"), F.col("page_id").cast("string").alias("id"))
    labelled = rows.filter(F.size(F.regexp_extract_all("html", F.lit("(?i)<article[\\s>]"), F.lit(0))) == 1)
    n = labelled.count()
    if n > sample_pages:
        labelled = labelled.filter(F.pmod(F.xxhash64("id", "html"), F.lit(1_000_000)) < 1_000_000 * sample_pages / n)
    schema = pa.schema([("kind", pa.string()), ("inside", pa.bool_()), ("n", pa.int64()), ("pages", pa.int64())])

    def count(batches):
        for batch in batches:
            total: dict[tuple[str, bool], list[int]] = defaultdict(lambda: [0, 0])
            for page in batch.column("html").to_pylist():
                for k, v in counts_of(page).items():
                    total[k][0] += v
                    total[k][1] += 1
            yield as_batch({"kind": [k[0] for k in total], "inside": [k[1] for k in total], "n": [v[0] for v in total.values()], "pages": [v[1] for v in total.values()]}, schema)

    counted = arrow_map(labelled.select("html"), count, "kind string, inside boolean, n long, pages long")
    table = counted.groupBy("kind").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("b"), F.sum("pages").alias("pages"))
    found = table.filter(F.col("pages") * RARE >= min(n, sample_pages)).collect()
    words = [r for r in found if r.kind.startswith(("word:", "tag:"))]
    a, b = (sum(r[x] for r in words) for x in ("a", "b"))
    weights = dict(DEFAULT)
    if not a:
        return weights
    for r in found:
        odds = math.log(((r.a + 1) / (a + 1)) / ((r.b + 1) / (b + 1)))
        if r.kind.startswith("word:"):
            # a place that the sample's articles hardly use keeps its default
            floor = DEFAULT.get(r.kind, LEAST) if r.a * RARE < a else LEAST
            weights[r.kind] = min(max(odds, floor), 1.0)
        elif r.kind == "named":
            weights[r.kind] = min(max(odds, LEAST_NAMED), 1.0)
        elif r.kind.startswith("name:"):
            weights[r.kind] = min(max(odds, -MOST), MOST)
        else:
            weights[r.kind] = max(min(odds, -LEAST), -2.0)
    return weights


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row per page, in one narrow pass over the whole html."""
    weights = fit(pages) if weights is None else weights
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in slices(batches, 1 << 23, "html"):
            texts = [main_text(p, weights) for p in batch.column("html").to_pylist()]
            yield as_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}, schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return arrow_map(rows, run, "page_id long, url string, text string, n_chars long")

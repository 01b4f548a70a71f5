"""Main text of HTML pages by tree scoring.

A page becomes a tree of block-level elements and a list of blocks (runs of text that no
block-level tag breaks). Menus, page footers, sidebars, scripts, styles, controls and
hidden parts are left out by their tag, role or attribute. Classes and ids only make an
element *suspect*. A token that says nothing else ("cookie-notice", but not "related-work" or
"meta-analysis") makes it suspect in full: elements of the hard kinds (adverts, comments,
notices, menus) go if they do not hold the main part of the page, those of the soft kinds go
if they are no prose either. A compound is what its last word is ("user-comment" is a
comment, "comments-on-method" a method); with words that are not known it only makes an
element *likely* to be noise, and that goes if it is under a third of the page's text. Words
that may name a part of an article as well (a discussion, a review) count only without a
heading of its own. Comments are also known by what they are: schema.org's types, and runs of
like siblings with a link to reply. Of several articles the one that holds the container is
the page's. Headings are never judged by class or id, and ids count for containers only.

Each block passes points for its length and commas to its ancestors, less by half with
each level; an element's points are discounted by the share of its text that stands in
links. The element with the most points is the container; if it lies in an article (or else
main) element, all of that is kept, and what else the main element holds if it is not
link-dense. Outside an article or main, the container's siblings join unless they are
link-dense, and further out headings, prose and what scores enough.

Elements, blocks and tags are handled in passes that look at each of them once: the parser
keeps the open places of each tag, sums go from children to parents, so time is linear.

Defined cases: a null or empty page has an empty text; unclosed and crossed tags close as
browsers close them, roughly; tags are read as browsers read them (a quote in an unquoted
value is part of it, an unfinished tag at the end of a page is dropped); pages without any
container give what is left outside the left-out elements; equal rows get equal results;
extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("head title meta link style script base noscript template".split())
LEFT_OUT = frozenset("head script style noscript template nav aside button select textarea input option label iframe object embed svg canvas audio video map menu dialog title search annotation annotation-xml".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
# Class and id words. A token is of a kind if each of its words, between hyphens, underscores and case changes, is of the kind or PLAIN.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promoted promotion taboola outbrain".split())
HARD = ADVERTS | frozenset(
    "comment comments commentlist disqus respond replies cookie cookies consent gdpr newsletter subscribe subscription popup modal overlay sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs"
    " pagination pager notice notices footer paywall signup login".split()
)
SOFT = frozenset("share sharing social related recommended skip reply header banner masthead toolbar widget widgets search tags copyright legal alert alerts hidden rail aside meta toc".split())
MAIN = frozenset("article main content story post posts entry body text".split())
PLAIN = MAIN | frozenset(
    "site page top bottom left right primary secondary container wrapper wrap box block section area bar list item items inner outer global local blog link links button buttons icon icons form panel row col column group holder region"
    " title head module component unit slot zone wide sticky fixed thread".split()
)
#: First words that say what a compound is, whatever follows; words that may name a part of an article too; what makes articles and stories links to others.
FIRST = frozenset("cookie cookies comment comments newsletter consent gdpr paywall promo sponsored advertisement subscribe signup".split())
DOUBTFUL = frozenset("discussion discussions review reviews bio".split())
OTHERS, STORIES = frozenset("related recommended popular trending similar latest".split()), frozenset("article articles post posts story stories news content reading links entries".split())
#: Words with which a token describes a relation or a state and names no kind.
RELATIONS = frozenset("has with without no not is and or on of for in to by from about".split())
#: What a link to answer a comment is called, and schema.org's types of what is not the article.
REPLY = frozenset("reply antworten répondre responder rispondi responda ответить beantwoorden".split())
TYPES = re.compile(r"schema\.org/(?:User)?(?:Comments?|WPFooter|WPHeader|WPSideBar|WPAdBlock|SiteNavigationElement)\s*$", re.I)
UNSEEN = frozenset("sr-only visually-hidden screen-reader-text".split())
#: Elements whose class and id may make them suspect; of the second kind only by adverts' words, else they must be no prose.
CONTAINERS = frozenset("div section ul ol dl table center fieldset details header figure td li hgroup".split())
COMMENTED = frozenset("div section article li".split())
TEXTUAL = frozenset("p blockquote pre dd dt tr th tbody".split())
CLOSES_P = BLOCK - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"}
#: An opening tag ends these open elements, looked for up to the named fence.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
FENCES = ("td", "th", "table")
PASS_FENCES = frozenset("td th tr tbody thead tfoot table article main".split())
WEIGHTS = dict.fromkeys(("article", "main"), 25.0) | dict.fromkeys(("div", "section"), 5.0) | dict.fromkeys(("pre", "td", "blockquote"), 3.0) | dict.fromkeys("ol ul dl li dd dt address th".split(), -3.0)

_ATTRIBUTES = r"(?>[\s/]+|[^\s/>][^\s/>=]*(?:\s*=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|(?![\"'])[^\s>]*))?)*+"
_TOKEN = re.compile(rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

#: A block of fewer characters passes only its share of length, not the point for being there.
SHORT = 25
#: Beside the container, an element with so large a share of link text is no article text.
DENSE = 0.5
#: Prose: so many characters, so many a block, and less than this share of them in links. A form is a wrapper of the page if it holds more.
PROSE_CHARS, PROSE_BLOCK, PROSE_LINKS, FORM_CHARS = 80, 60, 0.25, 1000
#: Likely noise is less than this share of the page's text.
LIKELY_SHARE = 1 / 3
_COMMAS = re.compile("[,，、،]")


class Element:
    __slots__ = ("blocks", "chars", "gone", "headed", "holds_main", "link_chars", "parent", "points", "replies", "shape", "suspect", "tag")

    def __init__(self, tag: str, parent: Element | None, suspect: str, shape: str):
        self.tag, self.parent, self.suspect, self.shape = tag, parent, suspect, shape
        self.points, self.chars, self.link_chars, self.blocks, self.gone, self.holds_main, self.headed, self.replies = 0.0, 0, 0, 0, False, False, False, 0

    def density(self) -> float:
        return min(1.0, self.link_chars / self.chars) if self.chars else 0.0

    def prose(self, least: int = PROSE_CHARS) -> bool:
        return self.chars >= least and self.chars >= PROSE_BLOCK * self.blocks and self.density() < PROSE_LINKS


class Block:
    __slots__ = ("at", "link_chars", "parts")

    def __init__(self, at: Element):
        self.at, self.parts, self.link_chars = at, [], 0


def _said(token: str, inside_main: bool) -> str:
    """hard, advert, soft, likely, doubtful or nothing: what a class or id token says."""
    words = [w.lower() for w in _WORD.findall(token)]
    noise = [w for w in words if w in HARD or w in SOFT]
    if noise and all(w in HARD or w in SOFT or w in PLAIN or w.isdigit() for w in words):
        if any(w in HARD for w in noise):
            return "advert" if any(w in ADVERTS for w in noise) else "hard"
        if not any(w in MAIN for w in words) and not (inside_main and noise == ["header"]):
            return "soft"
    if not words or RELATIONS & set(words):
        return ""
    named = [w for w in words if not w.isdigit()]
    if len(named) > 1 and named[0] in OTHERS and (named[1] in STORIES or named[-1] in STORIES):
        return "likely"
    while len(named) > 1 and named[-1] in PLAIN:
        named.pop()
    if not named or len(named) == 1 and named[0] in SOFT:
        return ""
    if named[-1] in HARD or named[0] in FIRST:
        return "likely"
    return "doubtful" if named[-1] in DOUBTFUL else ""


_ORDER = {"": 0, "form": 1, "doubtful": 2, "soft": 3, "likely": 4, "hard": 5, "advert": 6}


def judge(tag: str, attributes: str, inside_main: bool, quoted: bool) -> tuple[bool, str, str]:
    """(left out, suspect of, class) of an opening tag."""
    if tag in LEFT_OUT or (tag == "header" and not inside_main) or (tag == "footer" and not quoted):
        return True, "", ""
    suspect, shape = "form" if tag == "form" else "", ""
    if len(attributes) < 4 or tag in ("html", "body"):
        return False, suspect, shape
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return True, "", ""
        if name == "role" and value.lower() in ROLES and tag not in ("main", "article"):
            return True, "", ""
        if name == "class":
            shape = value
        if (name == "itemtype" and TYPES.search(value)) or (name == "itemprop" and value.lower() == "comment"):
            suspect = "hard"
        if name not in ("class", "id") or tag in HEADINGS or tag == "main" or (name == "id" and tag not in CONTAINERS):
            continue
        for token in value.split() if name == "class" else [value]:
            said = _said(token, inside_main)
            if token in UNSEEN or (said == "advert" and tag not in BLOCK):
                return True, "", ""
            if tag == "article":
                said = "hard" if said in ("hard", "likely") and {"comment", "comments"} & {w.lower() for w in _WORD.findall(token)} else ""
            elif tag not in CONTAINERS:
                said = {"advert": "advert", "hard": "soft", "soft": "soft"}.get(said, "") if tag in TEXTUAL else ""
            if said and _ORDER[said] > _ORDER[suspect]:
                suspect = said
    return False, suspect, shape


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """The block-level elements, parents before children, and the blocks outside left-out elements, in page order."""
    root = Element("#root", None, "", "")
    elements, blocks, block = [root], [], None
    # the open elements: tag ("" once an inline element is closed under others), nearest block-level element, left out
    tags, holders, outs = ["#root"], [root], [False]
    places: dict[str, list[int]] = defaultdict(list)
    block_places: list[int] = [0]
    links = main = 0  # open elements of the kind

    def last(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else -1

    def pop_to(i: int) -> None:
        nonlocal links, main, block
        while len(tags) > i:
            tag = tags.pop()
            holders.pop()
            outs.pop()
            if not tag:
                continue
            places[tag].pop()
            links -= tag == "a"
            main -= tag in ("article", "main")
            if tag in BLOCK:
                block_places.pop()
                block = None

    def close_inline(tag: str) -> None:
        """Closes an inline element; blocks that were opened inside it stay open."""
        nonlocal links
        i = last(tag)
        if i > block_places[-1]:
            pop_to(i)
        elif not outs[i]:
            places[tag].pop()
            tags[i] = ""
            links -= tag == "a"
        else:
            pop_to(i)

    def text(raw: str) -> None:
        nonlocal block
        if outs[-1] or not raw:
            return
        if block is None:
            if raw.isspace():
                return
            block = Block(holders[-1])
            blocks.append(block)
        raw = _html.unescape(raw) if "&" in raw else raw
        block.parts.append(raw)
        if links:
            block.link_chars += len(raw.strip())

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = max(m.end(), m.start() + 1)
        if m[1] is None:
            if page.startswith("<![CDATA[", m.start()):
                text(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if not m[3]:
            continue
        tag = m[1].lower()
        if page[m.start() + 1] == "/" and tag != "br":
            i = last(tag)
            if i < 0:
                if tag == "p":
                    block = None
            elif tag not in ("html", "body") and (tag in PASS_FENCES or i > max(map(last, FENCES))):
                if tag in BLOCK or tag in RAW:
                    pop_to(i)
                else:
                    close_inline(tag)
            continue
        if tag == "br":
            if block is not None:
                block.parts.append(" ")
            continue
        if tag not in IN_HEAD and last("head") >= 0:
            pop_to(last("head"))
        if tag in CLOSES_P and tags[block_places[-1]] == "p":
            pop_to(block_places[-1])
        if tag in HEADINGS and tags[-1] in HEADINGS:
            pop_to(len(tags) - 1)
        if tag in IMPLIED:
            ends, fence = IMPLIED[tag]
            while (i := max(map(last, ends))) > max(map(last, fence)):
                pop_to(i)
        if tag == "a" and last("a") >= 0:
            close_inline("a")
        if tag in BLOCK:
            block = None
        if tag in VOID or (m[2].endswith("/") and tag in ("svg", "path", "script", "math")):
            continue
        out, suspect, shape = (True, "", "") if outs[-1] else judge(tag, m[2], main > 0, last("blockquote") >= 0)
        holder = holders[-1]
        if tag in BLOCK:
            if not out:
                holder = Element(tag, holder, suspect, shape)
                elements.append(holder)
            block_places.append(len(tags))
        places[tag].append(len(tags))
        tags.append(tag)
        holders.append(holder)
        outs.append(out)
        links += tag == "a"
        main += tag in ("article", "main")
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = close.start() if close else end
    return elements, blocks


def _drop_runs(elements: list[Element]) -> None:
    """Runs of comments go: two or more children of one parent, alike in tag and class, each with a link to reply."""
    for e in reversed(elements[1:]):  # a reply counts for the elements around it, up to the nearest of those that are alike
        e.parent.replies += e.replies
    alike: dict[tuple[int, str, str], list[Element]] = defaultdict(list)
    for e in elements[1:]:
        if e.replies and e.tag in COMMENTED:
            alike[id(e.parent), e.tag, e.shape].append(e)
    for run in alike.values():
        if len(run) > 1:
            for e in run:
                e.gone = True


def main_text(page: str | None) -> str:
    if not page:
        return ""
    elements, blocks = parse(page)
    found = [(b, t) for b in blocks if (t := " ".join("".join(b.parts).split()))]
    for b, t in found:
        points = min(len(t) / 100, 3.0) + len(_COMMAS.findall(t)) + (1.0 if len(t) >= SHORT else 0.0)
        b.at.points += points * (1 - min(1.0, b.link_chars / len(t)))
        b.at.chars += len(t)
        b.at.link_chars += b.link_chars
        b.at.blocks += 1
        b.at.replies += b.link_chars > 0 and len(t) < SHORT and t.split()[0].casefold().strip(".:!") in REPLY
    total = sum(len(t) for _, t in found)
    _drop_runs(elements)
    for e in reversed(elements):  # children before parents
        over = e.parent
        if over is None:
            continue
        comment = e.tag == "article" and e.suspect == "hard"
        e.holds_main = e.holds_main or (e.tag in ("article", "main") and not comment and e.prose())
        if e.suspect and (comment or not e.holds_main):
            if e.suspect in ("likely", "doubtful"):
                e.gone = e.gone or (e.chars < LIKELY_SHARE * total and not (e.suspect == "doubtful" and e.headed))
            else:
                e.gone = e.gone or e.suspect in ("hard", "advert") or not e.prose(FORM_CHARS if e.suspect == "form" else PROSE_CHARS)
        if e.gone:
            continue
        over.headed = over.headed or e.headed or (e.tag in HEADINGS and e.chars > 0)
        textual = e.tag == "p" or e.tag in HEADINGS
        over.points += e.points if textual else e.points / 2
        over.chars += e.chars
        over.link_chars += e.link_chars
        over.blocks += e.blocks
        over.holds_main = over.holds_main or e.holds_main
    for e in elements[1:]:  # parents before children
        e.gone = e.gone or e.parent.gone
    kept = [(b, t) for b, t in found if not b.at.gone]
    score = lambda e: (e.points + WEIGHTS.get(e.tag, 0.0)) * (1 - e.density())
    scored = [e for e in elements if e.chars and not e.gone and e.tag != "p" and e.tag not in HEADINGS]
    if not scored:
        return "\n".join(t for _, t in kept)
    top = max(scored, key=score)
    above = [top]
    while above[-1].parent is not None:
        above.append(above[-1].parent)
    outer = max((i for i, e in enumerate(above) if e.tag in ("article", "main")), default=None)
    whole = max((i for i, e in enumerate(above) if e.tag == "article"), default=outer or 0)
    open_to = max(whole, 1) if outer is None else outer  # up to here all goes in that is not link-dense
    least = max(10.0, 0.2 * score(top))
    others: set[int] = set()  # branches whose text stands in other articles
    articles: dict[int, int] = defaultdict(int)
    for e in reversed(elements[1:]):
        inside = e.chars if e.tag == "article" else articles[id(e)]
        articles[id(e.parent)] += 0 if e.gone else inside
        if e.chars and inside == e.chars:
            others.add(id(e))
    # of each element: the level of the chain above the container that it hangs from, and its branch there
    level_of = {id(e): (i, None) for i, e in enumerate(above)}
    for e in elements[1:]:
        if id(e) not in level_of:
            level, branch = level_of[id(e.parent)]
            level_of[id(e)] = level, branch or e

    own = above[whole] if above[whole].tag == "article" else None

    def belongs(b: Block, t: str) -> bool:
        level, branch = level_of[id(b.at)]
        if level <= whole:
            return True
        if own is not None and branch is not None and id(branch) in others:
            return False
        density = min(1.0, b.link_chars / len(t)) if branch is None else branch.density()
        if density >= DENSE:
            return False
        if level <= open_to:
            return True
        if outer is not None:  # beside the article or main: only what is of its kind, or its title
            return branch is not None and (branch.holds_main or branch.tag in ("h1", "h2"))
        if branch is None:
            return len(t) >= PROSE_CHARS and density < PROSE_LINKS
        return branch.tag in HEADINGS or branch.prose() or score(branch) >= least or (branch.tag == top.tag and branch.shape == top.shape != "")

    return "\n".join(t for b, t in kept if belongs(b, t))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                texts = [main_text(x.as_py()) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

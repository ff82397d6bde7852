"""Main text of HTML pages by consensus host paths.

Each page's containers are scored by the text they hold in blocks, links not
counted: what they hold directly in full, what inner containers hold by half a
level. The best one is lifted to the container that holds the rest of the same
text (see ``_lifted``). A page votes for the generalised tag-class path found;
votes are summed per host in Spark, and every page of the host is extracted
again from the containers at the winning path, with the blocks that stand
directly in the body. A page without such a container keeps its own best one.
A whole page without a body tag is its own body.

Boxes beside the text are known by tag, role, and words of class and id. A word
alone removes no article, main part or container that the consensus path goes
through, and nothing that holds most of the page's text.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitworks.llm.common import checked, free_name, prepared, quoted, stored
from gaitworks.llm.url_filter import host_and_path

RESULTS = ("text", "n_chars")
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol "
    "p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body center div main section table tbody td tr".split())
#: Text beside an article or the main part is not its own, unless another of them or the main part holds it.
SEALED = ("article", "main")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
SKIPPED = RAW | frozenset(
    "aside audio button canvas datalist dialog footer form head header map menu meter nav object optgroup option output progress select "
    "svg template video".split()
)
SKIPPED_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split()
)
SKIPPED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|notification|alert|popup|"
    r"modal|overlay|newsletter|subscribe|subscription|signup|login|sidebar|side-bar|widgets?|menu|nav|navbar|navigation|breadcrumbs?|"
    r"header|masthead|footer|comments?|commentlist|disqus|respond|repl(?:y|ies)|share|sharing|social|related|recommend\w*|pagination|"
    r"pager|search|toolbar|skip-link)(?:$|[\s_-])",
    re.I,
)
#: What follows such a word in a name says what the element is about or has near it, not what it is.
MENTIONS = re.compile(r"(?:^|[_-])(?:has|have|with|without|no|non|not|hides?|cat|category|categories|tags?|tagged|topic|taxonomy)[_-]", re.I)
#: Readers or advertisers may well write more than the author: such an element stays only if it holds nearly everything, and there is no article.
OTHERS = re.compile(
    r"(?:^|[_-])(?:comments?|commentlist|disqus|respond|repl(?:y|ies)|ads?|adverts?|advertis\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr)"
    r"(?:$|[_-])",
    re.I,
)
#: An element that starts here ends an open one of these first.
CLOSES = {name: frozenset({"p"}) for name in BLOCKS - {"body", "html", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}} | {
    "li": frozenset({"li", "p"}),
    "dt": frozenset({"dt", "dd", "p"}),
    "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}),
    "td": frozenset({"td", "th", "p"}),
    "th": frozenset({"td", "th", "p"}),
    "tbody": frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "p"}),
}
#: What an implied end does not reach beyond.
STOPS = frozenset("ul ol dl table div section article main body td blockquote".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DIGITS = re.compile(r"\d+")
_BODY = re.compile(r"<body[\s/>]", re.I)


def _attributes(text: str) -> dict[str, str]:
    return {name.lower(): a or b or c for name, a, b, c in _ATTRIBUTE.findall(text)} if text.strip(" /\n\t\r\f") else {}


def _unwanted(tag: str, attributes: dict[str, str]) -> bool:
    if tag in SKIPPED:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return True
    return attributes.get("role", "").strip().lower() in SKIPPED_ROLES


def _widget(tag: str, attributes: dict[str, str]) -> str | None:
    """The part of a class or id that names the element as a box beside the text."""
    if not attributes or tag in ("html", "body", *SEALED):
        return None
    for names in (attributes.get("class"), attributes.get("id")):
        if names and SKIPPED_NAMES.search(names):
            for name in names.split():
                head = MENTIONS.split(name, maxsplit=1)[0]
                if SKIPPED_NAMES.search(head):
                    return head
    return None


def _label(tag: str, attributes: dict[str, str]) -> str:
    """Tag and classes with every number alike; ids only of elements without a class."""
    names = attributes.get("class") or attributes.get("id") or ""
    return ".".join([tag, *sorted(_DIGITS.sub("0", name.lower()) for name in names.split())])


def _longer(path: str, label: str) -> str:
    """A path one step down; very deep ones are known by a digest."""
    path = f"{path}/{label}"
    return path if len(path) <= 400 else "#" + hashlib.blake2b(path.encode("utf-8", "replace"), digest_size=16).hexdigest()


NOT, BESIDE, WANTED = 0, 1, 2


class _Element:
    __slots__ = ("tag", "path", "inner", "wanted", "widget")

    def __init__(self, tag: str, path: str, inner: str | None, wanted: int, widget: int = -1):
        self.tag, self.path, self.inner, self.wanted, self.widget = tag, path, inner, wanted, widget


Walked = tuple[Counter, dict[str, tuple[str | None, str]], list[str]]


def _walk(page: str, target: str | None, best: bool, implied: bool = False) -> Walked:
    """Scores of the container paths, container and tag of each, and the text blocks for ``target``.

    With ``implied``, what stands in no container stands in a body of path "".
    """
    found, kept, widest = _pass(page, target, best, implied, frozenset())
    if widest > kept:  # else no box that a name removed can hold most of the text
        held: dict[int, list[int]] = {}
        articles = _pass(page, None, True, implied, None, held)[2]
        whole = held[-1][0]
        for n, outer, _ in reversed(held.values()):  # a box comes after the one around it
            if outer != -1:
                held[outer][0] += n
        del held[-1]
        spared = frozenset(at for at, (n, _, foreign) in held.items() if (20 * n > 19 * whole and not articles if foreign else 2 * n > whole))
        if spared:
            found = _pass(page, target, best, implied, spared)[0]
    return found


def _pass(
    page: str, target: str | None, best: bool, implied: bool, spared: frozenset[int] | None, held: dict[int, list[int]] | None = None
) -> tuple[Walked, int, int]:
    """What ``_walk`` returns, the text found, and the length of the longest box removed for its name.

    ``spared`` are the places of the boxes that stay in spite of their names. If
    it is None all of them stay, and ``held`` gets the text in each but not in
    inner ones, the place of the next one around it (-1: the page, which has all
    text) and whether others wrote it; instead of the length, the number of
    articles and main parts in none of them is returned.
    """
    scores: Counter = Counter()
    tree: dict[str, tuple[str | None, str]] = {"": (None, "body")} if implied else {}
    blocks: list[tuple[int, str]] = []
    sealed = False
    root = (WANTED if target == "" else BESIDE) if implied else NOT
    stack: list[_Element] = [_Element("", "", "" if implied else None, root)]
    pieces: list[str] = []
    links = 0
    linked = 0
    skip_tag, skip_depth = "", 0
    kept, widest, widget_at, articles = 0, 0, -1, 0
    if held is not None:
        held[-1] = [0, -1, 0]
    lower: str | None = None
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal linked, kept
        if not pieces:
            return
        text = "".join(pieces)
        pieces.clear()
        if "&" in text:
            text = entities.unescape(text)
        text = " ".join(text.split())
        if text:
            wanted, own = stack[-1].wanted, max(len(text) - 2 * linked, 0)
            kept += own
            if held is not None:
                held[-1][0] += own
                if stack[-1].widget != -1:
                    held[stack[-1].widget][0] += own
            if best:
                if stack[-1].inner is not None:
                    scores[stack[-1].inner] += own
            elif wanted == WANTED or (wanted == BESIDE and len(text) > 2 * linked):
                blocks.append((wanted, text))
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not skip_tag and (best or stack[-1].wanted):
            pieces.append(piece)
            if links:
                linked += len(piece.strip())

    while at < size:
        if widget_at >= 0 and not skip_tag:
            widest, widget_at = max(widest, at - widget_at), -1
        found = _TOKEN.search(page, at)
        if found is None:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        tag = found[2] or found[5]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1] or found[4]:
            if skip_tag:
                if tag == skip_tag:
                    skip_depth -= 1
                    if skip_depth == 0:
                        skip_tag = ""
                elif tag in CONTAINERS and any(e.tag == tag for e in stack):
                    skip_depth, inner = skip_depth, tag  # an outer element ends: whatever was left open in it ends, too
                    if open_inside.get(inner, 0) > 0:
                        open_inside[inner] -= 1
                    else:
                        skip_tag, skip_depth = "", 0
                        flush()
                        while stack[-1].tag != tag:
                            stack.pop()
                        stack.pop()
                elif tag in open_inside:
                    open_inside[tag] -= 1
                continue
            if tag == "a":
                links = 0
            if tag in BLOCKS:
                flush()
                for place in range(len(stack) - 1, 0, -1):
                    if stack[place].tag == tag:
                        del stack[place:]
                        break
            continue
        raw = found[3] if found[2] else found[6]
        if tag in RAW:
            if lower is None:
                lower = page.lower() if len(page.lower()) == size else page
            end = lower.find("</" + tag, at)
            while end >= 0 and lower[end + 2 + len(tag) : end + 3 + len(tag)] not in ("", ">", "/", " ", "\n", "\t", "\r", "\f"):
                end = lower.find("</" + tag, end + 2)
            close = page.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else size
            continue
        if skip_tag:
            if tag not in VOID and not raw.endswith("/"):
                if tag == skip_tag:
                    skip_depth += 1
                elif tag in CONTAINERS:
                    open_inside[tag] = open_inside.get(tag, 0) + 1
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        attributes = _attributes(raw)
        unwanted, widget, begin = _unwanted(tag, attributes), _widget(tag, attributes), at
        if widget is not None and tag in BLOCKS and not unwanted:
            through = target and tag in CONTAINERS and f"{target}/".startswith(_longer(stack[-1].path, _label(tag, attributes)) + "/")
            if spared is not None and begin not in spared and not through:
                unwanted, widget_at = True, at
        elif widget is not None:
            unwanted = True
        if unwanted:
            if tag in BLOCKS or tag in SKIPPED:
                flush()
            skip_tag, skip_depth, open_inside = tag, 1, {}
            continue
        if tag == "a":
            links = 1
            continue
        if tag not in BLOCKS:
            continue
        flush()
        ends = CLOSES.get(tag)
        if ends:
            for place in range(len(stack) - 1, 0, -1):
                if stack[place].tag in ends:
                    del stack[place:]
                    if len(ends) == 1:
                        break
                elif stack[place].tag in STOPS:
                    break
        top = stack[-1]
        path, inner, wanted = top.path, top.inner, top.wanted
        if tag in CONTAINERS or tag == "html":
            path = _longer(path, _label(tag, attributes))
        if tag in CONTAINERS:
            tree.setdefault(path, (inner, tag))
            inner = path
            if wanted != WANTED:
                wanted = WANTED if path == target else BESIDE if tag == "body" else NOT
                if wanted == WANTED and (tag in SEALED or any(e.tag in SEALED for e in stack)):
                    sealed = True
        box = top.widget
        if held is not None and widget is not None:
            held[begin], box = [0, box, bool(OTHERS.search(widget))], begin
        articles += tag in SEALED and box == -1
        stack.append(_Element(tag, path, inner, wanted, box))
    flush()
    if widget_at >= 0:
        widest = max(widest, size - widget_at)
    if sealed or all(wanted != WANTED for wanted, _ in blocks):
        blocks = [b for b in blocks if b[0] == WANTED]
    return (scores, tree, [text for _, text in blocks]), kept, widest if held is None else articles


def _lifted(path: str, scores: Counter, totals: Counter, tree: dict[str, tuple[str | None, str]]) -> str:
    """The container that holds the whole text of which ``path`` holds the largest part.

    That is the outermost article, or else the main part, around it; from there,
    the outermost container that has text of its own or other containers with a
    quarter as much text in all. The body's own text does not lift to it, as it
    is taken without what else the body holds.
    """
    chain = [path]
    while (above := tree[chain[-1]][0]) is not None:
        chain.append(above)
    for tag in SEALED:
        if marked := [place for place, p in enumerate(chain) if tree[p][1] == tag]:
            chain = chain[marked[-1] :]
            break
    sealed = tree[chain[0]][1] in SEALED
    beside: dict[str, list[str]] = {p: [] for p in chain}
    for p, (above, _) in tree.items():
        if above in beside:
            beside[above].append(p)
    out = chain[0]
    for below, above in zip(chain, chain[1:]):
        tag = tree[above][1]
        free = not sealed or tag == "main"
        others = sum(totals[p] for p in beside[above] if p != below and (free or tree[p][1] in SEALED))
        if (others and 4 * others >= totals[below]) or (free and tag != "body" and scores[above]):
            out = above
        if tag == "body":
            break
    return out


def best_path(page: str | None, implied: bool = False) -> tuple[str, int] | None:
    """The container path with the main text of this page, and how much it holds."""
    scores, tree, _ = _walk(page, None, True, implied) if page else (Counter(), {}, [])
    scores = +scores
    if not scores:
        return None
    totals, credit = Counter(scores), Counter(scores)
    for path in reversed(tree):  # a container comes after the one around it
        above = tree[path][0]
        if above is not None:
            totals[above] += totals[path]
            if tree[above][1] != "body" or tree[path][1] not in SEALED:
                credit[above] += credit[path] / 2
    path = _lifted(min(credit, key=lambda p: (-credit[p], p)), scores, totals, tree)
    return path, totals[path]


def extract(page: str | None, consensus: str | None, implied: bool = False) -> str:
    """The blocks of the containers at the consensus path, else at the page's own best one, joined by line ends.

    ``implied`` is for whole pages, where the body tag may be left out; a mere
    fragment without a container has no text.
    """
    if not page:
        return ""
    if consensus == "" and _BODY.search(page):
        consensus = None
    blocks = _walk(page, consensus, False, implied)[2] if consensus is not None else []
    if not blocks:
        own = best_path(page, implied)
        blocks = _walk(page, own[0], False, implied)[2] if own else []
    return "\n".join(blocks)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: Counter = Counter()
        for host, page in zip(batch.column(0), batch.column(1)):
            found = best_path(page.as_py(), implied=True)
            if found is not None:
                votes[host.as_py(), found[0]] += 1
        columns = [pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.string()), pa.array(list(votes.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "path", "votes"])


def consensus(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, path``: the container path with the most pages of the host behind it, the least one of a tie."""
    host = host_and_path(quoted(url))[0]
    voted = pages.select(host.alias("host"), quoted(html).alias("html")).mapInArrow(_votes, "host string, path string, votes long")
    sums = voted.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return sums.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path"))["path"].alias("path"))


def main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Every row, without the html, with ``text`` (empty if there is none) and ``n_chars``.

    Null html is empty; a null url's host is empty. Very long pages are read
    whole; repeated rows stay, and each votes; an empty table gives no rows.
    Columns of the input with a result's name are replaced.
    """
    prepared(pages.sparkSession)
    winners = stored(consensus(pages, url, html), "html-paths")
    kept = [c for c in pages.columns if c.lower() not in (*RESULTS, html.lower())]
    host, path = free_name(pages.columns, "host"), free_name(pages.columns, "path")
    keyed = pages.select("*", host_and_path(quoted(url))[0].alias(host))
    joined = keyed.join(checked(winners.toDF(host, path)), host, "left")
    source = joined.select(quoted(html), path, *[quoted(c) for c in kept])
    schema = pages.select(*[quoted(c) for c in kept]).schema.add("text", "string").add("n_chars", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py(), path.as_py(), implied=True) for page, path in zip(batch.column(0), batch.column(1))]
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *columns], names=schema.names)

    return source.mapInArrow(work, schema)

"""Main text of web pages: flat text blocks, described by word count and link density of theirs and their neighbours',
classified by a decision tree that is trained on a small labelled table.

A page is cut into blocks at block-level tags. Besides the shallow features, a block knows whether it stands in an
element that is furniture by its tag, class or id, how much else stands in its own element, whether it is in an article,
whether it is a heading, and whether it ends like a sentence. A class tells of furniture if all its parts do, or are words
of layout, and only on pages that have text elsewhere. `train` fits a CART tree to the blocks of LABELLED, in which such
classes also stand around articles, and furniture has none; `main_text` keeps the blocks that the tree calls content.

Nulls: null html is empty and has an empty text; a null page_id or url stays null. Repeated rows give one result row
each. Broken markup is read as far as it goes: unclosed scripts, quotes and comments end with the page. Empty tables
give empty results; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements that begin a new block, that hold no text of the page, that may lack an end tag.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN_TAGS = frozenset("head iframe script style svg template textarea title video audio canvas".split())
LOOSE_TAGS = frozenset("p li option hr dt dd tr td th".split())
#: Elements that are furniture by their tag, and words of a class, id or role that say so.
FURNITURE_TAGS = frozenset("aside button dialog fieldset footer form menu nav noscript select".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement advertising alert author-box banner bio breadcrumb breadcrumbs byline captcha comment commentlist comments complementary consent contentinfo cookie cookies copyright disclaimer discussion disqus dialog feedback footer form gdpr login menu meta modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination paywall popup promo promoted promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription survey tags teaser toolbar tooltip topbar widget".split()
)
#: Words of layout, which a class may hold beside them.
LAYOUT_WORDS = frozenset(
    "area article articles bar block body bottom box btn button buttons center col column container content cta entry float global group header heading icon icons img inner item items layout left link links list main mini module more most page panel popular post posts primary right row secondary section site slot small stories sub text title top trail wrap wrapper".split()
)
ARTICLE_WORDS = frozenset("article articlebody article-body entry-content main maincontent main-content post post-body post-content story".split())

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "furniture", "article", "heading", "sentence", "peers")

#: The labelled table: invented pages whose blocks begin with their label, + for content and - for anything else.
LABELLED = [
    """<header><a href=/>-The Daily Ferry</a></header><nav><ul><li><a href=/1>-News</a><li><a href=/2>-Sport</a><li><a href=/3>-Harbour</a></ul></nav>
<div class="cookie-banner"><p>-We use cookies to make this site work for you. Read more in our policy.</p><button>-Accept</button></div>
<article><h1>+The old ferry sails again</h1><p>+After eleven years in the yard the ferry left the harbour on Monday with two hundred guests on board and a brass band on the upper deck.</p>
<p>+Its captain, who had steered it as a young man, said that little had changed but the price of coal and the number of gulls.</p>
<div class="ad">-Cheap tyres for every car, fitted while you wait. Call today.</div><h2>+A long repair</h2><p>+The hull was <a href=/h>found to be sound</a>, but the engine had to be built anew from drawings that a museum lent to the yard.</p><p>+Then it rained.</p>
<p>+More trips are planned for May.</p></article><aside><h3>-Most read</h3><ul><li><a href=/r1>-Bridge closed for a week</a><li><a href=/r2>-Ten walks by the sea</a></ul></aside>
<section class="comments"><h3>-Comments</h3><p>-I sailed on it as a child and I am glad that it is back, thank you for the report.</p><p>-Me too.</p></section>
<footer><p>-Copyright The Daily Ferry. All rights reserved.</p><a href=/i>-Imprint</a></footer>""",
    """<ul><li><a href=/a>-Home</a><li><a href=/b>-About us</a><li><a href=/c>-Contact</a></ul><h1>+Baking with rye</h1>
<p>+Rye takes up more water than wheat and its dough stays sticky, so that it is better stirred than kneaded.</p><p>+Leave it to rest for an hour at least, in a warm place and under a cloth that has been wrung out well.</p><ul><li>+500 g of rye flour</li><li>+a spoon of salt</li><li>+water</li></ul>
<p>+Bake it hot at first, then let the oven cool down for the rest of the hour.</p><p>+Enjoy it fresh.</p><ul><li><a href=/d>-Wheat bread</a><li><a href=/e>-Rolls</a><li><a href=/f>-Cakes and tarts</a></ul><p><a href=/p>-Print</a> | <a href=/q>-Mail to a friend</a></p>""",
    """<main><h1>+Release notes</h1><p>+See the <a href=/g>guide to the new settings</a>, the <a href=/k>list of known faults</a> and the <a href=/w>notes on upgrading from older versions</a> before you begin.</p>
<p>+This version reads files of any size.</p><pre>+run --fast input.txt</pre><p>+<a href=/long>Everything that has changed since the last version is told in the full report of the project.</a></p><p>+It needs less memory, starts faster, and no longer writes to the folder that it was started in, as many of you have asked.</p><p>+Thanks to all who helped.</p></main>
<div class="share"><a href=/t>-Tweet</a> <a href=/m>-Mail</a></div><div class="related"><h3>-Related articles</h3><a href=/o>-Version four is out</a></div>""",
    """<div id="menu"><a href=/1>-Start</a> <a href=/2>-Archive</a> <a href=/3>-Links</a></div><div class="post-content"><h2>+On gardens</h2><p>+A garden teaches patience to those who have none and gives it back to those who had too much of it.</p>
<blockquote>+Plant pears for your heirs.</blockquote><p>+So it is said, and so my grandfather did.</p><p>+The trees are still there.</p></div><div class="sidebar"><p>-I am a gardener from the north who writes about soil, seeds and the weather, mostly in the evening.</p><a href=/me>-More about me</a></div>
<div class="newsletter"><p>-Get one letter a month with all that grows, free and without adverts.</p><form><label>-Your address</label><button>-Subscribe</button></form></div><div id="footer">-Made with care in the north.</div>""",
    """<article><header><h1>+Minutes of the meeting</h1></header><p>+Present: nine members.</p><p>+The chair opened the meeting at seven and read the minutes of the last one, which were agreed to without a vote.</p><table><tr><td>+Dues</td><td>+40</td></tr><tr><td>+Rent</td><td>+25</td></tr></table><p>+The treasurer's report was taken as read.</p><p>+Next meeting in June.</p>
<nav class="pager"><a href=/1>-Previous</a> <a href=/2>-Next</a></nav></article><p>-Page 3 of 12</p><p><a href=/top>-Back to top</a></p>""",
    """<p><a href=/l>-Log in</a></p><p><a href=/r>-Register</a></p><article><p>+It is short.</p></article><div class="advert"><p>-Learn a language in three weeks with our new course, now at half the price for readers of this site.</p></div>""",
    """<table><tr><td><a href=/1>-Home</a></td><td><a href=/2>-Products</a></td><td><a href=/3>-Service</a></td></tr></table><p>+The pump is to be cleaned once a month with warm water and a soft brush, never with petrol or any other solvent.</p><p>+Before it is opened the valve has to be closed and the pressure let out slowly by the screw at its side.</p><p>+Worn seals are replaced in pairs.</p><p>-<a href=/a>Terms</a> <a href=/b>Privacy</a> <a href=/c>Jobs</a></p>""",
    """<article><h1>+Recipe of the week: plum soup</h1><p>+Serves four.</p><p>+Simmer the plums with sugar and a stick of cinnamon until they fall apart, then strain them and let the soup cool.</p><p><a href=/x>-Read also: apple soup</a></p><p>+It is best on the second day, served with a spoon of cream and a slice of dark bread that was toasted in butter.</p>
<p class="notice">-This recipe is provided without any warranty by our kitchen team.</p><ul class="tags"><li><a href=/s>-soup</a><li><a href=/p>-plum</a></ul></article><div class="subscribe">-Subscribe now and never miss another soup.</div>""",
    """<div><p>+Where the road leaves the wood, a path on the left leads down to the mill, which can be seen from far off in winter.</p><p>+It was built in 1704, burned down twice, and has been a house for walkers since the war, open from April to October.</p><h3>+How to get there</h3><p>+By bus from the station, or on foot.</p></div><div><a href=/p1>-Photos</a></div><div><a href=/p2>-Map</a></div><div>-Search</div>""",
    """<nav><a href=/1>-World</a></nav><article><p>+A whale was seen off the pier this morning by a class that had come to draw boats.</p></article><footer>-The Pier Post</footer>""",
    """<nav><ul><li><a href=/1>-One</a><li><a href=/2>-Two</a></ul></nav><article><p>+No news today.</p></article><footer>-Us.</footer>""",
    """<div><a href=/1>-Index</a></div><p>+Of all the clocks in the town hall only the one on the stairs keeps time, and nobody knows who winds it.</p><p><a href=/2>-Next</a></p>""",
    """<div><a href=/1>-Index</a> <a href=/2>-Map</a></div><div>-Updated daily</div><div><a href=/3>-Jobs</a></div><article><h1>+Stairs</h1><p>+<a href=/s>The stairs of the tower have been closed by the mayor for the whole of the summer.</a></p><p>+Try the lift.</p></article><div>-Ref. 14</div><div><a href=/4>-Top</a></div>""",
]

LABELLED += [
    """<div class="survey-comments"><h1>+How the town lives</h1><p>+We asked nine hundred people of the town how they spend their evenings and what they would change if it were theirs to decide.</p><p>+Most of them read, walk by the river, or sit with their neighbours until the lamps are lit in the square.</p><p>+Few go out.</p></div><aside><p>-This paper is printed on Thursdays by the friends of the town library.</p></aside><p><a href=/1>-Index</a></p><footer>-Printed in the town. All rights.</footer>""",
    """<section id="search"><p>+The search for the lost manuscript began in a cellar, where a clerk found two of its leaves wrapped around a candlestick.</p><p>+It took eleven more years until the rest was found, bound into the back of a cookery book.</p></section><footer><p>-Finds and Losses, a journal of the society.</p><p>-Imprint</p></footer>""",
    """<header>-The Valley Paper, every day</header><nav><a href=/1>-World</a> <a href=/2>-Town</a></nav><section class="social"><h2>+A history of tea</h2><p>+Tea came to the valley with the railway, and for a while it was sold at the station only, by the spoon.</p><p>+The first tea room had four chairs and a queue that reached as far as the bridge on market days.</p><p>+Both are gone.</p></section><footer>-The Valley Paper</footer>""",
    """<div><h1>+The lock keeper</h1><p>+For thirty years nobody passed the lock without a word from its keeper about the weather, the price of eels or the state of the banks.</p><p>+By hand.</p><p>+Done</p></div>""",
    """<div><h2>+Notes on glue</h2><p>+Glue from bones is soaked overnight, warmed until it runs from the brush, and never boiled, since it loses its strength.</p><p>+Keep it dry.</p></div><div><p>-Print</p></div><div><p>-Share this page</p><p>-Report a fault</p></div>""",
    """<article><p>+Snow fell.</p></article><section class="comments"><p>-It did here as well, more than in the last ten winters together if I remember that rightly.</p><p>-Not where we live, but the roads were closed all the same until the late afternoon.</p></section>""",
    """<article><h1>+The small fair</h1><p>+It took place on the green, with three stalls, a pony and a man who guessed the weight of a cheese.</p></article><div class="related-articles"><p>-The great fair of the county opens in May with all that belongs to it, as it has done since it began.</p></div><div id="comments"><p>-I guessed it right and ate the cheese with my sisters, who say hello to the man.</p></div>""",
    """<article><h1>+The weir</h1><p>+The weir was built by monks, who drew their fish from it, and it has been mended by everyone since.</p><p>+It leaks again.</p></article><section class="comments"><h3>-Three comments</h3><p>-My father mended it twice with nothing but clay and willow, and it held for longer than the concrete did.</p><p>-Clay is what the old book about it says as well, on the page with the drawing of the sluice.</p><p>-Let us meet there on Saturday with spades and a cart, and see how far we get before the rain.</p></section>""",
    """<div><h1>+The tower clock</h1><p>+It strikes thirteen at one, since a wheel was cut with a tooth too many, and the town will not have it changed.</p></div><div class="related-posts"><p>-The organ that has played by itself at night since the bellows were given a motor of their own.</p><p>-The bridge that leads to a field, because the road it was built for was never paid for by anyone.</p><p>-The well in the cellar of the inn, which is deeper than the tower is high.</p></div><aside><p>-About us: we are five friends who collect what is odd in small towns, and print it once a year.</p><p>-Write to us if you know of something that is odder than a clock with a tooth too many.</p></aside>""",
    """<div class="newsletter"><p>-Sign up for our letter and get the best of the week on Sunday morning, free of charge.</p></div><div><p><a href=/a>-Start</a></p></div><article><p>+One line.</p></article>""",
]

_MARK = re.compile(r"""=\s*["']|>""")
_COMMENT_END = re.compile(r"--!?>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
#: A class that begins so tells of something else: has-sidebar, no-comments.
_ABOUT = frozenset("has have no not non with without hide hidden is show".split())
_SENTENCE = re.compile(r"[.!?…。][\"'»”’)\]]*$")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    furniture: bool
    article: bool
    heading: bool
    element: int
    by_tag: bool


def _hints(attributes: str) -> tuple[bool, bool]:
    """Whether a class, id or role says furniture, by itself or by parts none of which is about anything but layout; or
    article, by itself or by its first part."""
    furniture = article = False
    for m in _ATTRIBUTE.finditer(attributes):
        for word in (m[1] or m[2] or m[3] or "").lower().replace("_", "-").split():
            parts = word.split("-")
            if parts[0] not in _ABOUT:
                known = [p for p in parts if p and not p.isdigit()]
                furniture |= word in FURNITURE_WORDS or (not FURNITURE_WORDS.isdisjoint(known) and all(p in FURNITURE_WORDS or p in LAYOUT_WORDS for p in known))
                article |= not ARTICLE_WORDS.isdisjoint((word, parts[0]))
    return furniture, article


def _tag_end(page: str, at: int, unclosed: set[str]) -> int:
    """Where the tag ends whose name begins at `at`, or 0; a quote after = hides what it encloses. Quotes that nothing
    closes are remembered, so that a page is read once."""
    while m := _MARK.search(page, at):
        at = m.end()
        quote = m[0][-1]
        if quote == ">":
            return at
        if quote not in unclosed:
            close = page.find(quote, at)
            if close < 0:
                unclosed.add(quote)
            else:
                at = close + 1
    unclosed.update("\"'")
    return 0


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    in_link = False
    heading = False
    stack: list[tuple[str, bool, bool, int, bool]] = [("", False, False, 0, False)]  # open elements: tag, furniture, article, number, furniture by tag
    elements = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            words = text.count(" ") + 1
            out.append(Block(text, words, min(words, linked), stack[-1][1], stack[-1][2], heading, stack[-1][3], stack[-1][4]))
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            linked += len(text.split())

    at, n = 0, len(page)
    lowered, unclosed = None, set()
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        if page.startswith("<!--", lt):
            closed = _COMMENT_END.search(page, lt + 2)  # <!--> and <!---> are whole comments
            at = closed.end() if closed else n
            continue
        mark = page[lt + 1 : lt + 2]
        closing = mark == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if not name and mark not in ("!", "?", "/"):
            say("<")
            at = lt + 1
            continue
        stop = _tag_end(page, lt + 1, unclosed) or page.find(">", lt) + 1
        if not stop:
            break  # a tag that never ends
        at = stop
        if not name:
            continue
        tag = name[0].lower()
        if tag in HIDDEN_TAGS:
            if closing or page[stop - 2] == "/":
                continue
            if tag == "head":  # its other elements are hidden on their own
                continue
            flush()
            lowered = page.lower() if lowered is None else lowered
            close = lowered.find(f"</{tag}", stop) if len(lowered) == n else page.find(f"</{tag}", stop)
            gt = page.find(">", close) if close >= 0 else -1
            at = gt + 1 if gt >= 0 else n
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in BLOCK_TAGS:
            continue
        flush()
        if not closing and stack[-1][0] in LOOSE_TAGS and (tag == stack[-1][0] or stack[-1][0] == "p"):
            stack.pop()  # ended by what follows
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = not closing
        if tag in LOOSE_TAGS:
            hint = _hints(page[name.end() : stop]) if not closing else (False, False)
            if not (hint[0] or (stack[-1][0] == tag and closing)):
                continue  # these may lack an end tag, so they only count where a hint makes them furniture
        if closing:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if depth:
                del stack[depth:]
                in_link = heading = False
        else:
            furniture, article = _hints(page[name.end() : stop])
            _, was_furniture, was_article, _, was_by_tag = stack[-1]
            if tag in ("article", "main"):
                article = True
            if article and tag in ("article", "main", "body", "html"):
                furniture = False  # such an element is told by its tag
            by_tag = tag in FURNITURE_TAGS or (tag == "header" and not was_article)
            furniture |= by_tag
            if tag in ("html", "body"):
                furniture = article = False  # their classes describe the site
            if tag == "main":
                furniture = False
            elements += 1
            stack.append((tag, was_furniture or furniture, was_article or article, elements, was_by_tag or by_tag))
    flush()
    return out


def features(page_blocks: list[Block]) -> list[tuple[float, ...]]:
    """FEATURES of every block."""
    density = [b.linked / b.words for b in page_blocks]
    plain: Counter[int] = Counter()  # words without links, by element
    for b in page_blocks:
        plain[b.element] += b.words - b.linked
    outside = any(b.linked < b.words for b in page_blocks if not b.furniture)
    rows = []
    for i, b in enumerate(page_blocks):
        before = (float(page_blocks[i - 1].words), density[i - 1]) if i else (0.0, 0.0)
        after = (float(page_blocks[i + 1].words), density[i + 1]) if i + 1 < len(page_blocks) else (0.0, 0.0)
        peers = float(plain[b.element] - (b.words - b.linked))
        rows.append((float(b.words), density[i], *before, *after, float(b.furniture and (b.by_tag or outside)), float(b.article), float(b.heading), float(bool(_SENTENCE.search(b.text))), peers))
    return rows


class Node(NamedTuple):
    """An inner node (rows with feature <= threshold go to `low`) or, without feature, a leaf."""

    label: int
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None


def labelled(pages: list[str]) -> list[tuple[float, ...]]:
    """FEATURES and label of the blocks of labelled pages."""
    rows = []
    for page in pages:
        found = blocks(page)
        unmarked = [b._replace(text=b.text[1:]) for b in found]
        rows += [(*row, float(b.text[0] == "+")) for row, b in zip(features(unmarked), found)]
    return rows


def train(pages: list[str] | None = None, depth: int = 6, least: int = 2) -> Node:
    """A CART tree by Gini impurity; ties go to the first feature and the lowest threshold."""
    rows = labelled(LABELLED if pages is None else pages)

    def impurity(part: list[tuple]) -> float:
        p = sum(r[-1] for r in part) / len(part)
        return 2 * p * (1 - p) * len(part)

    def grow(part: list[tuple], depth: int) -> Node:
        label = int(2 * sum(r[-1] for r in part) >= len(part))
        best = (impurity(part) - 1e-9, None)
        if depth and best[0] > 0:
            for f in range(len(FEATURES)):
                values = sorted({r[f] for r in part})
                for a, b in zip(values, values[1:]):
                    t = (a + b) / 2
                    low, high = [r for r in part if r[f] <= t], [r for r in part if r[f] > t]
                    if min(len(low), len(high)) >= least and (cost := impurity(low) + impurity(high)) < best[0]:
                        best = (cost, (f, t, low, high))
        if not best[1]:
            return Node(label)
        f, t, low, high = best[1]
        return Node(label, f, t, grow(low, depth - 1), grow(high, depth - 1))

    return grow(rows, depth)


def is_content(tree: Node, row: tuple[float, ...]) -> bool:
    while tree.feature >= 0:
        tree = tree.low if row[tree.feature] <= tree.threshold else tree.high
    return bool(tree.label)


def extract(page: str, tree: Node) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, row in zip(found, features(found)) if is_content(tree, row))


def main_text(pages: DataFrame, tree: Node | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    tree = tree or train()
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py() or "", tree) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

"""HTML extraction by the maximum-scoring run of words and tags.

A page is a sequence of tags and words.  Words score by the kind of block they stand in,
tags by their name; the scores are log-odds of standing in the article, counted on labelled
pages, which are pages that mark their article.  Words of content blocks come out positive,
tags negative.  One linear scan finds the contiguous run with the largest sum: the article.
Words in elements that are never content (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, comments) score a little below zero anywhere, and are left
out of the run's text; tags in such elements do not score.  An element is such by its
name or by a whole word of its class, id or role; by the first or last part of such a word
where the part is plain (`PLAIN`), as in `comment-list` or `postComments`, unless another one
turns it into a remark (`REMARKS`), as in `with-comments`; else, as in `header-large`, its
words score half as well and are shown.  The page's first article and mains are never such;
later articles are by their class, and in such elements stay so, as readers' comments do.
Elements whose end tag may be left out (`OPTIONAL`) end as HTML says.

At most `LABELLED_PAGES` pages train the weights, the first by hash of the id; every page
is extracted from the whole of its HTML.  The driver gets a score per known tag and kind.

A null or empty page, or one without words, gives the empty text.  Repeated rows repeat, an
empty table stays empty (without labelled pages the default weights hold), and extra columns
are ignored.  Of runs with equal sums the first, longest one is taken.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closeline.llm.common import checkpointed, first_by, joined

#: Pages the weights are fitted on.
LABELLED_PAGES = 2000
#: Limits of a word's score, and of a tag's.
WORD_SCORE, TAG_SCORE = (-4.0, 2.0), (-1.0, -0.02)
UNKNOWN_WORD, UNKNOWN_TAG = 1.0, -0.2
#: Words that are never content cost little, as an advert may stand within an article; they
#: are left out of its text.
NEVER_WORD = -0.2

#: Elements whose text is not shown, that never hold content, that do not
#: interrupt a word, and that start the content anew.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")
NEVER = ("nav", "header", "footer", "aside", "form", "button", "select", "dialog", "head", "menu")
INLINE = (
    "a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span "
    "strike strong sub sup time tt u var wbr"
).split()
RESTART = ("article", "main")
#: Words of class, id and role attributes that mark such elements.
MARKS = (
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment "
    "commentlist comments consent cookie cookies disqus footer gdpr header menu menubar modal nav "
    "navbar navigation newsletter notice notices notification popup promo promoted related "
    "replies reply share sharing sidebar social sponsor sponsored subscribe toolbar widget"
).split()
#: Marks that as the first or last part of a word say the same, and parts that
#: make such a word a remark about the content.
PLAIN = frozenset(
    "ad ads advert advertisement breadcrumb breadcrumbs comment commentlist comments consent "
    "cookie cookies disqus gdpr newsletter notice notices related replies reply share sharing "
    "social sponsored subscribe".split()
)
REMARKS = frozenset(
    "allow and closed disabled enabled has hide is no not off on open show with without".split()
)

#: Fixed values of HTML: elements without content, elements whose end tag may be left out,
#: tags that end an open p, and for other tags the elements they end, up to which one.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
OPTIONAL = frozenset("p li dt dd td th tr tbody thead tfoot".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split()
)
CELLS, ROWS, GROUPS = ("td", "th"), ("td", "th", "tr"), ("td", "th", "tr", "tbody", "thead", "tfoot")
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (CELLS, ("tr", "table")),
    "th": (CELLS, ("tr", "table")),
    "tr": (ROWS, ("table",)),
    "tbody": (GROUPS, ("table",)),
    "thead": (GROUPS, ("table",)),
    "tfoot": (GROUPS, ("table",)),
}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")

#: Kinds of blocks and tags the weights know.
KNOWN = frozenset(
    "article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th tbody "
    "thead blockquote pre figure figcaption br hr img body html address center".split()
) | frozenset(INLINE)


def _mark(attributes: str) -> str:
    """never where a word of class, id or role is a mark, marked where a part of one is, else empty."""
    found = ""
    for name, value in ATTRIBUTE.findall(attributes):
        if name.lower() not in ("class", "id", "role"):
            continue
        for word in value.strip("\"'").split():
            if word.lower() in MARKS:
                return "never"
            parts = [part.lower() for part in PART.findall(word)]
            if parts and not PLAIN.isdisjoint((parts[0], parts[-1])) and REMARKS.isdisjoint(parts):
                return "never"
            if not set(parts).isdisjoint(MARKS):
                found = "marked"
    return found


class Region:
    """The open elements from one that is never content, or is marked, to the innermost."""

    def __init__(self) -> None:
        self.open: list[str] = []

    def _end(self, names: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        """End the outermost of `names` that is open within the innermost of `bounds`."""
        at = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] in bounds:
                break
            if self.open[i] in names:
                at = i
        if at is not None:
            del self.open[at:]

    def start(self, name: str) -> None:
        """End what a start tag ends."""
        if name in ENDS_P:
            self._end(("p",), ("table", "td", "th", "button"))
        if name in ENDS:
            self._end(*ENDS[name])

    def end(self, name: str) -> None:
        if name in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(name) :]
        elif self.open[0] in OPTIONAL and name not in INLINE and name not in VOID and name != "p":
            # The end of an element around the region.
            self.open.clear()


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """(what, kind, text): tags with their name, text with the kind of its block.

    `what` is tag, inline, text, marked, never or edge.  Never is text that cannot be content,
    edge a tag in or around it; marked is text in an element that a part of a word marks.
    """
    never, marked, block = Region(), Region(), "body"
    later = False
    for m in TOKEN.finditer(page):
        if m["text"] is not None:
            yield ("never" if never.open else "marked" if marked.open else "text", block, m["text"])
        elif m["tag"]:
            name, ends = m["tag"].lower(), bool(m["end"])
            opens = not ends and name not in VOID and not m["attributes"].endswith("/")
            hidden = bool(never.open)
            for region in (never, marked):
                if region.open:
                    if not ends and name in RESTART and not (later and region is never):
                        region.open.clear()
                    elif ends:
                        region.end(name)
                    else:
                        region.start(name)
                    if region.open and opens and (name not in INLINE or name == region.open[0]):
                        region.open.append(name)
            if not ends:
                hidden = bool(never.open)
                if not hidden and (name not in ("body", "html", *RESTART) or later and name == "article"):
                    mark = "never" if name in NEVER else _mark(m["attributes"])
                    hidden = mark == "never" and opens
                    if hidden:
                        never.open.append(name)
                    elif mark == "marked" and opens and not marked.open and name != "article":
                        marked.open.append(name)
                later = later or name == "article"
            if hidden:
                yield "edge", name, ""
            elif name in INLINE:
                yield "inline", name, ""
            else:
                block = "body" if ends else name if name not in ("br", "hr", "img") else block
                yield "tag", name if ends or name in KNOWN else "other", ""
        elif m["raw"]:
            yield "tag", m["raw"].lower(), ""


def counted(page: str, counts: Counter) -> None:
    """Add a labelled page's words and tags, in and out of its article, to `counts`."""
    inside = False
    for m_what, kind, text in pieces(_marked_article(page)):
        if m_what == "tag" and kind == ARTICLE_EDGE:
            inside = not inside
            continue
        label = kind if kind in KNOWN else "other"
        if m_what == "edge":
            continue
        if m_what in ("text", "marked", "never"):
            counts["word", "never" if m_what == "never" else label, inside] += len(text.split())
        else:
            counts["tag", label, inside] += 1


ARTICLE_EDGE = "hr"


def _marked_article(page: str) -> str:
    """The page with its article's edges turned into rules, which no label is learned for."""
    return re.sub(r"</?article\b[^>]*>", "<hr>", re.sub(r"<hr\b[^>]*>", "", page, flags=re.I), flags=re.I)


def fitted(pages: DataFrame, most: int = LABELLED_PAGES) -> dict[tuple[str, str], float]:
    """Scores by (word or tag, kind), from pages with one marked article."""
    labelled = pages.select("page_id", "html").where(F.regexp_count("html", F.lit("(?i)<article[ >]")) == 1)
    labelled = labelled.withColumn("html_hash", F.xxhash64("html"))
    key = ["page_id", "html_hash"]
    # Pages are chosen by hash before they are fetched.
    first = first_by(checkpointed(labelled.select(key).distinct()), key, most)
    sample = joined(labelled, F.broadcast(first), key, "left_semi").dropDuplicates(key).select("html")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for page in batch["html"]:
                counted(page, counts)
        rows = [(*key, n) for key, n in counts.items()]
        yield pd.DataFrame(rows, columns=["what", "kind", "inside", "n"])

    rows = sample.mapInPandas(count, "what string, kind string, inside boolean, n long")
    totals = {(r.what, r.kind, r.inside): r.n for r in rows.groupBy("what", "kind", "inside").agg(F.sum("n").alias("n")).collect()}
    scores = {}
    for what, kind in {k[:2] for k in totals}:
        odds = math.log((totals.get((what, kind, True), 0) + 0.5) / (totals.get((what, kind, False), 0) + 0.5))
        low, high = WORD_SCORE if what == "word" else TAG_SCORE
        scores[what, kind] = min(high, max(low, odds if what == "word" else odds - 2.0))
    return scores


def extracted(page: str | None, scores: dict[tuple[str, str], float]) -> str:
    """Text of the best run of the page; blocks and words are one space apart."""
    parts: list[tuple[str, bool]] = []
    best = total = 0.0
    start = 0
    span = (0, 0)
    for what, kind, text in pieces(page or ""):
        known = kind if kind in KNOWN else "other"
        if what in ("tag", "inline"):
            total += scores.get(("tag", known), UNKNOWN_TAG)
            if what == "tag":
                parts.append((" ", True))
        elif what == "edge":
            parts.append((" ", True))
        else:
            decoded = html.unescape(text)
            score = NEVER_WORD if what == "never" else scores.get(("word", known), UNKNOWN_WORD)
            score -= abs(score) / 2 if what == "marked" else 0
            total += score * len(decoded.split())
            parts.append((decoded, what != "never"))
        if total <= 0:
            total, start = 0.0, len(parts)
        elif total > best:
            best, span = total, (start, len(parts))
    return " ".join("".join(text if shown else " " for text, shown in parts[span[0] : span[1]]).split())


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of `pages`."""
    scores = fitted(pages)

    @F.pandas_udf("string")
    def extract(column: pd.Series) -> pd.Series:
        return column.map(lambda page: extracted(page, scores))

    out = pages.select("page_id", "url", extract("html").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))

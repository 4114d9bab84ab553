"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of tokens.  Words score positive and tags negative, with weights learnt from
labelled pages: the log odds that a word in such a block, or such a tag, lies inside
the article.  One linear scan finds the contiguous run of tokens with the largest total, and its text
is the page's; menus, adverts, forms and the like inside the run are left out.
(J. Pasternack, D. Roth, Extracting Article Text from the Web with Maximum Subsequence
Segmentation, 2009.)

Which elements are left out: those whose own name says so (``nav``, ``footer``, ``form`` and the like), and those
whose class, id or role speaks against them by more than their contents speak for them.  Words of these
attributes have weights from the labelled pages, on top of what is believed beforehand of a few words;
a word counts less as part of a compound, and nothing if the compound names something else
(``share-price``, ``related-work``).  How many of its words are links and whether it holds
sentences is weighed with weights from the labelled pages too.  Contents alone leave nothing out.

Labelled pages are those that mark their article (``article``, ``main`` or
``itemprop=articleBody``); the weights hold for pages that do not.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.workers import in_batches
from cardloom.llm.words import slices

#: At most so many labelled pages teach the weights (those whose id hashes lowest).
TRAIN_PAGES = 2000
#: A word in a kind of block that no labelled page has, such a tag; bounds of weights.
NEW_WORD, NEW_TAG, MOST, LEAST_TAG = 1.0, -0.5, 4.0, -0.05
#: A word and a tag of an element that is left out in any case: a large one within an article must not break it in two.
EXCLUDED_WORD, EXCLUDED_TAG = -0.2, -0.05
#: Beliefs about words of attributes, as weights: a plain one, an ambiguous one, the part of a weight that
#: a compound keeps; labelled elements count against a belief as so many; bound of the weights of contents.
PLAIN, AMBIGUOUS, COMPOUND, BELIEF, MOST_SHAPE = 4.0, 2.2, 0.75, 20, 1.0

# Element names by kind.
RAW = frozenset("script style textarea title noscript template iframe object svg math canvas select".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
INLINE = frozenset("a b i em strong span img input".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr caption".split())
CONTENT = frozenset(("article", "main"))
EXCLUDED = frozenset("head nav aside footer form menu dialog button fieldset".split())
# Words in class, id and role that speak against an element, some in any use, others by themselves or among
# their kind; and words that name nothing.
PLAIN_WORDS = frozenset(
    "advert adverts advertisement advertising adsbygoogle sponsor sponsored navbar navigation breadcrumb breadcrumbs sidebar contentinfo"
    " comment comments disqus cookie cookies consent gdpr newsletter popup masthead pagination".split()
)
AMBIGUOUS_WORDS = frozenset(
    "ad ads promo promotion nav menu header footer complementary respond notice notices banner alert modal overlay subscribe subscription signup login"
    " search share sharing social related recommended widget toolbar pager".split()
)
NEUTRAL_WORDS = frozenset(
    "list item box area section wrapper wrap container block content body text left right top bottom inner outer main primary secondary links link button buttons bar icons"
    " icon site page global user reader readers form thread reply replies js wp fixed sticky mobile desktop unit slot zone panel group row col posts articles stories".split()
)
#: With these, a header belongs to the article.
OF_ARTICLE = frozenset("article post entry story headline".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ENDS = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in RAW}
_BODY = re.compile(r"itemprop\s*=\s*[\"']?articleBody", re.I)
_SENTENCE = re.compile(r"\w{2,}[.!?…。](?:\s|$)")
_PART = re.compile(r"[a-z]+|[0-9]+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class Element:
    """An element that is open on the stack at some time: its name, parent, marks (each a tuple of words), what it holds.

    ``inside``: within a marked article; ``named``: its name, or that of one around it, says that it is no part of the article;
    ``holds``: a marked article lies in it.
    """

    __slots__ = ("name", "parent", "marks", "inside", "named", "holds", "words", "linked", "sentences")

    def __init__(self, name: str, parent: int, marks: tuple, inside: bool, named: bool):
        self.name, self.parent, self.marks, self.inside, self.named = name, parent, marks, inside, named
        self.holds, self.words, self.linked, self.sentences = False, 0, 0, 0

    def shape(self) -> tuple[str, str]:
        """What its contents look like: the share of words in links, and whether there are sentences."""
        links = self.linked / max(self.words, 1)
        return f"links:{0 if not links else 1 + (links > 0.25) + (links > 0.75)}", f"prose:{min(self.sentences, 2) if self.words >= 8 else 'none'}"


class Token:
    """A tag or a run of text: its kind, how many words it has, its text, whether it ends a block, the element it is in (or -1)."""

    __slots__ = ("kind", "words", "text", "edge", "element")

    def __init__(self, kind: str, words: int, text: str, edge: bool, element: int):
        self.kind, self.words, self.text, self.edge, self.element = kind, words, text, edge, element


def marks_of(tag: str) -> tuple:
    """The names in class, id and role, each as its words in lower case."""
    if "=" not in tag:
        return ()
    found = (name for m in _MARKS.finditer(tag) for name in (m[1] or m[2] or m[3] or "").split())
    return tuple(words for words in (tuple(_PART.findall(_HUMP.sub("-", name).lower())) for name in found) if words)


def tokens(page: str) -> tuple[list[Token], list[Element]]:
    """The tokens of a page in order, and its elements."""
    out: list[Token] = []
    elements: list[Element] = []
    stack: list[int] = []  # open elements
    opened: Counter = Counter()  # how many of each name are open
    link = 0  # not 0 within a link: one more than how many elements were open when it began
    at, end = 0, len(page)

    def close() -> None:
        nonlocal link
        opened[elements[stack.pop()].name] -= 1
        if link > len(stack) + 1:  # a link does not outlast the element that it began in
            link = 0

    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        piece = m[0]
        inner = stack[-1] if stack else -1
        if piece[0] != "<" or len(piece) == 1:
            text = html.unescape(piece)
            words = len(text.split())
            out.append(Token(f"w:{elements[inner].name if stack else 'body'}", words, text, False, inner))
            if words and stack:
                e = elements[inner]
                e.words += words
                e.linked += words if link else 0
                e.sentences += len(_SENTENCE.findall(text))
            continue
        name_m = _NAME.match(piece)
        if not name_m:  # comment, doctype
            continue
        name = name_m[1].lower()
        closing, block = piece[1] == "/", name in BLOCKS
        out.append(Token(f"t:{name if block or name in INLINE else 'other'}", 0, "", block, inner))
        if name == "a":
            link = 0 if closing else len(stack) + 1
        if closing:
            if opened[name] > 0:
                while elements[stack[-1]].name != name:
                    close()
                close()
            continue
        if name in RAW and not piece.endswith("/>"):
            found = _ENDS[name].search(page, at)
            at = found.start() if found else end
            continue
        if name in VOID:
            continue
        marks = () if name in ("html", "body", *CONTENT) else marks_of(piece)
        if not block and name not in EXCLUDED and not marks:
            continue
        if block:  # a block ends an open paragraph, an item an open item
            while stack and ((top := elements[stack[-1]].name) == "p" or (top in LEAVES and top == name)):
                close()
        inner = stack[-1] if stack else -1
        around = elements[inner] if stack else None
        inside = bool(around and around.inside)
        named = bool(around and around.named) or name in EXCLUDED or (name == "header" and not inside)
        starts = name in CONTENT or bool(_BODY.search(piece))
        if starts and not inside:
            i = inner
            while i >= 0 and not elements[i].holds:
                elements[i].holds = True
                i = elements[i].parent
        elements.append(Element(name, inner, marks, inside or starts, named))
        stack.append(len(elements) - 1)
        opened[name] += 1
    for i in range(len(elements) - 1, -1, -1):  # an element holds what those in it hold; they come after it
        e = elements[i]
        if e.parent >= 0:
            around = elements[e.parent]
            around.words, around.linked, around.sentences = around.words + e.words, around.linked + e.linked, around.sentences + e.sentences
    return out, elements


def believed(word: str) -> float:
    """How much a word speaks against an element before any page is seen."""
    return PLAIN if word in PLAIN_WORDS else AMBIGUOUS if word in AMBIGUOUS_WORDS else 0.0


def speaks(mark: tuple, weight: dict[str, float], inside: bool) -> float:
    """How much a name in class, id or role speaks against an element."""
    known = [weight.get(f"m:{w}", believed(w)) for w in mark]
    if "header" in mark and (inside or not OF_ARTICLE.isdisjoint(mark)):
        return 0.0
    if len(mark) == 1:
        return known[0]
    # a word that is neither known nor neutral: the compound names something else
    other = any(not k and w not in NEUTRAL_WORDS and not w.isdigit() for w, k in zip(mark, known, strict=True))
    total = COMPOUND * sum(known)
    if not other:
        return total
    return total - 1 if max(known) >= PLAIN else 0.0


def left_out(elements: list[Element], weight: dict[str, float]) -> list[bool]:
    """Which elements are no part of an article, by their names, marks and contents."""
    out: list[bool] = []
    for e in elements:
        gone = e.named or (e.parent >= 0 and out[e.parent])
        if not gone and e.marks and not e.holds:
            against = max(speaks(m, weight, e.inside) for m in e.marks)
            gone = against > 0 and against + sum(weight.get(f, 0.0) for f in e.shape()) > 0
        out.append(gone)
    return out


def _feature(t: Token, gone: list[bool]) -> str:
    return f"{t.kind[:2]}excluded" if t.element >= 0 and gone[t.element] else t.kind


def count_features(found: tuple[list[Token], list[Element]]) -> tuple[Counter, Counter] | None:
    """Of a labelled page: how often each feature of tokens and of elements is inside and outside the article."""
    toks, elements = found
    if not any(e.inside for e in elements):
        return None
    gone = left_out(elements, {})
    within, outside = Counter(), Counter()
    for t in toks:
        inside = t.element >= 0 and elements[t.element].inside and not gone[t.element]
        (within if inside else outside)[_feature(t, gone)] += t.words if t.kind[0] == "w" else 1
    for e in elements:
        if not e.holds and e.name not in CONTENT:
            (within if e.inside and not e.named else outside).update([*{f"m:{w}" for m in e.marks for w in m if not w.isdigit()}, *e.shape()])
    return within, outside


def weights(counts: list[tuple[str, int, int]]) -> dict[str, float]:
    """Weights from (feature, times inside, times outside).

    Of tokens the log odds of the inside; of marks the log odds of the outside, where a belief counts as ``BELIEF`` elements
    outside and so many inside as give its weight; of contents the log odds of the outside, within bounds.
    """
    out = {}
    for feature, a, b in counts:
        odds = math.log((a + 0.5) / (b + 0.5))
        if feature[0] == "m" and feature[1] == ":":
            belief = believed(feature[2:])
            odds = math.log((b + BELIEF) / (a + BELIEF * math.exp(-belief))) if belief else -odds if min(a, b) == 0 and a + b >= BELIEF else 0.0
            out[feature] = max(-MOST, min(MOST, odds))
        elif feature[:2] in ("w:", "t:"):
            odds = max(-MOST, min(MOST, odds))
            out[feature] = odds if feature[0] == "w" else min(LEAST_TAG, odds)
        else:
            out[feature] = max(-MOST_SHAPE, min(MOST_SHAPE, -odds))
    return out | {"w:excluded": EXCLUDED_WORD, "t:excluded": EXCLUDED_TAG}


def main_text(found: tuple[list[Token], list[Element]], weight: dict[str, float]) -> str:
    """The text of the maximum-scoring run."""
    toks, elements = found
    gone = left_out(elements, weight)
    best, total, start, run = 0.0, 0.0, 0, (0, 0)
    for i, t in enumerate(toks):
        feature = _feature(t, gone)
        total += t.words * weight.get(feature, NEW_WORD) if feature[0] == "w" else weight.get(feature, NEW_TAG)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, run = total, (start, i + 1)
    return " ".join("".join(" " if t.edge else t.text for t in toks[run[0] : run[1]] if t.edge or t.element < 0 or not gone[t.element]).split())


def learn(pages: DataFrame, key: str = "page_id", page: str = "html", most: int = TRAIN_PAGES) -> dict[str, float]:
    """Weights from at most ``most`` labelled pages; without any, every word counts alike."""
    labelled = pages.where(F.col(page).rlike(r"(?i)<(article|main)\b|itemprop\s*=\s*[\"']?articleBody")).select(F.xxhash64(key, page).alias("h"), F.col(page).alias("html"))
    # Only hashes are sorted; the pages themselves stay where they are.
    last = labelled.select("h").orderBy("h").limit(most).agg(F.max("h")).first()[0]
    sample = labelled.where(F.col("h") <= F.lit(last).cast("long"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within, outside = Counter(), Counter()
        for batch in batches:
            for text in batch.column("html").to_pylist():
                both = count_features(tokens(text))
                if both:
                    within.update(both[0])
                    outside.update(both[1])
        names = sorted({*within, *outside})
        yield pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()), "a": pa.array([within[n] for n in names], pa.int64()), "b": pa.array([outside[n] for n in names], pa.int64())})

    # A row for each kind of tag and block, a fixed list of names, and for each word of marks that the sample has often.
    counts = in_batches(sample.select("html"), count, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = counts.where(~F.startswith("feature", F.lit("m:")) | (F.col("a") + F.col("b") >= BELIEF)).collect()
    return weights([(r["feature"], r["a"], r["b"]) for r in counts])


def extract(pages: DataFrame, weight: dict[str, float], key: str = "page_id", page: str = "html") -> DataFrame:
    """Key, url, text and n_chars of every page.

    Edge cases: a null or empty page, or one where no run scores above zero, has the empty
    text; null and repeated keys are kept as they are; a missing end tag, a
    cut-off tag or comment is read as browsers do; an empty table gives an empty result;
    other columns are ignored.
    """
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "_html")):
            texts = [main_text(tokens(x), weight) if x else "" for x in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_pydict({key: batch.column(key), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})

    return in_batches(pages.select(key, "url", F.col(page).alias("_html")), run, f"{key} {kind}, url string, text string, n_chars long")

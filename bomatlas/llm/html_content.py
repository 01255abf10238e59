"""HTML extraction: the main text of a page as its maximum-scoring run of words and tags.

A page is a row of tokens, words and tags. Words score by what encloses them, tags score
below zero, and one scan finds the contiguous run with the largest sum. All weights are log
odds counted on labelled pages: how often a landmark element, a class, an id or a role holds
words of the main text and how often others, and the same for classes of words and for tags.
Elements that the labelled pages show to be beside the text (menus, adverts, comments) give
no words, neither to the scan nor to the result, so one inside an article doesn't end up in it.

Counting is a Spark aggregate over the labelled pages; extraction reads each page on its own.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bomatlas.llm.labelled_pages import labelled_pages

_ATTRIBUTES = r"""(?:[^<>"']|"[^"]*"|'[^']*')*+"""
#: Comments, elements whose content is no markup, tags, declarations, and a tag that the page breaks off in.
_MARKUP = re.compile(
    rf"<!--.*?(?:--!?>|\Z)"
    rf"|<(?P<raw>script|style|title|textarea|iframe|xmp|noembed|noframes)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-z][^\s/<>]*)(?P<with>{_ATTRIBUTES}|[^<>]*)>"
    rf"|<[!?/][^<>]*>"
    rf"|<[a-z/!?][^<>]*\Z",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s"'=/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")
_NAMED = ("class", "id", "role", "itemprop")

# Fixed values of the HTML standard.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var wbr button input select textarea output".split()
)
#: Elements that an opening of the same group ends, and where the search for them stops.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
#: Elements whose name says what they are for. Others tell by class, id and role only.
_LANDMARKS = set(
    "article main nav aside header footer form dialog button label select fieldset menu noscript template ins".split()
)
#: An article's own heading part is text of the article.
_HEADING = {"header", "head", "masthead"}

#: Log odds from which a container speaks for or against its words; the least and most of any weight.
EVIDENCE, MOST, LEAST_TAG = 2.5, 6.0, -0.1
#: ``FORM``: words that only a form around them speaks against; some sites put one around the whole page.
CONTENT, NOISE, FORM, PLAIN = "content", "noise", "form", "plain"
#: A block of fewer words is short: a caption, a link, a notice.
SHORT = 8


@dataclass(frozen=True)
class Weights:
    """Log odds of containers by feature, of words by class, of tags by name."""

    containers: dict[str, float]
    words: dict[str, float]
    tags: dict[str, float]


def _features(name: str, attributes: str) -> list[str]:
    """What an element says about its words: a landmark's name, and the parts of its class, id and role."""
    found = [name] if name in _LANDMARKS else []
    if name in ("html", "body") or not attributes:
        return found
    for key, value in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key == "hidden":
            found.append("[hidden]")
        elif key in _NAMED:
            for label in html.unescape(value.strip("\"'")).split():
                parts = [p for p in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", label).lower()) if p]
                # "has-sidebar" is about the page, not about what the element holds.
                if not {"has", "with", "no", "without"} & set(parts):
                    found += [f".{p}" for p in parts]
    return found


def _judge(features: list[str], inherited: str, odds: dict[str, float]) -> str:
    """What the words of an element are: what it says itself, else what encloses it says."""
    if inherited == NOISE:
        return CONTENT if "main" in features else NOISE
    strong = {f: odds[f] for f in features if abs(odds.get(f, 0.0)) >= EVIDENCE}
    for_ = any(v > 0 for v in strong.values())
    against = [f for f, v in strong.items() if v < 0]
    if inherited == CONTENT or for_:
        against = [f for f in against if f.lstrip(".") not in _HEADING]
    if against == ["form"]:
        return FORM
    return NOISE if against else CONTENT if for_ else inherited


@dataclass
class Token:
    """A tag, or a stretch of text inside one block."""

    tag: str | None
    text: str
    block: int
    kind: str
    features: tuple[str, ...]
    linked: bool
    title: bool


def tokens(page: str, odds: dict[str, float]) -> list[Token]:
    """The page's tags and texts in order. Unclosed, misnested and broken-off markup is read as browsers do, roughly."""
    out: list[Token] = []
    open_: list[tuple[str, str, tuple[str, ...]]] = []  # name, kind, features of it or else of what is around it
    block = at = 0

    def kind() -> str:
        return open_[-1][1] if open_ else PLAIN

    def text(raw: str) -> None:
        if raw:
            names = [o[0] for o in open_]
            out.append(Token(None, html.unescape(raw), block, kind(), open_[-1][2] if open_ else (), "a" in names, "h1" in names))

    def close(names: set[str], until: set[str]) -> None:
        for i in range(len(open_) - 1, -1, -1):
            if open_[i][0] in names:
                del open_[i:]
                return
            if open_[i][0] in until:
                return

    for found in _MARKUP.finditer(page):
        text(page[at : found.start()])
        at = found.end()
        name = (found["name"] or found["raw"] or "").lower()
        if found["raw"]:
            out.append(Token(name, "", block, kind(), (), False, False))
            block += name not in _INLINE
        if not found["name"]:
            continue
        if name == "br":
            text(" ")
        block += name not in _INLINE
        if found["end"]:
            # The end of an inline element doesn't close blocks that were opened since.
            inner = {o[0] for o in open_} - _INLINE - {name} if name in _INLINE else set()
            out.append(Token(name, "", block, kind(), (), False, False))
            close({name}, inner)
            continue
        if name in _ENDS:
            close(*_ENDS[name])
        elif name not in _INLINE:
            close({"p"}, {o[0] for o in open_} - _INLINE - {"p"})
        if name not in _VOID:
            features = _features(name, found["with"])
            around = open_[-1][2] if open_ else ()
            open_.append((name, _judge(features, kind(), odds), tuple(features) or around))
        out.append(Token(name, "", block, kind(), (), False, False))
    text(page[at:])
    return out


def _word_class(token: Token, n_words: int, marked: bool) -> str:
    """Words that no container speaks for: by link, heading, length of the block, and whether other words have a container that does."""
    if token.kind != PLAIN:
        return token.kind
    own = "link" if token.linked else "title" if token.title else PLAIN if n_words >= SHORT else "short"
    return own + ("+" if marked else "")


def _block_words(row: list[Token]) -> Counter:
    n: Counter = Counter()
    for token in row:
        if token.tag is None:
            n[token.block] += len(token.text.split())
    return n


def _tag_class(token: Token) -> str:
    return f"{token.tag}+" if token.kind == CONTENT else str(token.tag)


def _marked(row: list[Token]) -> bool:
    return any(t.kind == CONTENT and t.tag is None and t.text.strip() for t in row)


def blocks(row: list[Token]) -> list[tuple[int, str]]:
    """Each block's number and its text, white space turned into single spaces; empty ones left out."""
    out: list[tuple[int, list[str]]] = []
    for token in row:
        if token.tag is None:
            if not out or out[-1][0] != token.block:
                out.append((token.block, []))
            out[-1][1].append(token.text)
    joined = [(number, " ".join("".join(parts).split())) for number, parts in out]
    return [(number, text) for number, text in joined if text]


def main_text(page: str | None, weights: Weights) -> str:
    """The text of the best run; where forms hold all there is, they count as plain. A page without markup is its text."""
    odds = weights.containers
    row = tokens(page or "", odds)
    if all(t.tag is None for t in row):
        return "".join(text for _, text in blocks(row))
    text = _best_run(row, weights)
    if not text and any(t.kind == FORM for t in row):
        return _best_run(tokens(page or "", {k: v for k, v in odds.items() if k != "form"}), weights)
    return text


def _best_run(row: list[Token], weights: Weights) -> str:
    marked, n_words = _marked(row), _block_words(row)
    best = total = 0.0
    low = begin = end = 0
    for i, token in enumerate(row):
        if token.tag is not None:
            score = weights.tags.get(_tag_class(token), LEAST_TAG if token.kind == CONTENT else -1.0)
        elif token.kind in (NOISE, FORM):
            score = 0.0
        else:
            score = weights.words.get(_word_class(token, n_words[token.block], marked), 0.0) * len(token.text.split())
        if total <= 0:
            total, low = 0.0, i
        total += score
        if total > best:
            best, begin, end = total, low, i + 1
    return "\n\n".join(text for _, text in blocks([t for t in row[begin:end] if t.kind not in (NOISE, FORM)]))


def _odds(inside: int, outside: int) -> float:
    return max(-MOST, min(MOST, math.log((inside + 0.5) / (outside + 0.5))))


def _inside(row: list[Token], text: str) -> set[int]:
    """Blocks of the page that the label names, each line of the label once and in order where it can be."""
    wanted = Counter(text.split("\n\n"))
    found = set()
    for number, words in blocks(row):
        if wanted[words] > 0:
            wanted[words] -= 1
            found.add(number)
    return found


def _counted(labelled: DataFrame, odds: dict[str, float] | None) -> dict[tuple[str, str], tuple[int, int]]:
    """How often each container feature (no ``odds``), or each class of words and of tags, lies inside the labelled text and outside."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for page, text in zip(batch.column("html").to_pylist(), batch.column("text").to_pylist()):
                row = tokens(page or "", odds or {})
                marked, n_words, inside = _marked(row), _block_words(row), _inside(row, text or "")
                ends = [i for i, t in enumerate(row) if t.tag is None and t.block in inside and t.text.strip()]
                for i, token in enumerate(row):
                    if token.tag is None:
                        n, within = len(token.text.split()), token.block in inside
                        if odds is None:
                            seen.update({("container", f, within): n for f in set(token.features)})
                        else:
                            seen["word", _word_class(token, n_words[token.block], marked), within] += n
                    elif odds is not None:
                        seen["tag", _tag_class(token), bool(ends) and ends[0] < i < ends[-1]] += 1
        rows = [(kind, key, n if within else 0, 0 if within else n) for (kind, key, within), n in seen.items()]
        columns = list(zip(*rows)) or [()] * 4
        types = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types)], names=["kind", "key", "inside", "outside"])

    parts = labelled.select("html", "text").mapInArrow(count, "kind string, key string, inside long, outside long")
    whole = parts.groupBy("kind", "key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    # One row for each name that markup uses: vocabulary of the labelled pages, not text.
    return {(r.kind, r.key): (r.inside, r.outside) for r in whole.collect()}


def learn(labelled: DataFrame) -> Weights:
    """Weights from pages ``html`` and their main ``text`` (blocks joined by an empty line); nulls count as empty.

    The containers' odds come first, since the classes of words and tags depend on them.
    Without pages nothing has weight, and :func:`extracted` finds no text.
    """
    odds = {key: _odds(*n) for (_, key), n in _counted(labelled, None).items()}
    counts = _counted(labelled, odds)
    return Weights(
        odds,
        {key: _odds(*n) for (kind, key), n in counts.items() if kind == "word"},
        {key: min(LEAST_TAG, _odds(*n)) for (kind, key), n in counts.items() if kind == "tag"},
    )


def default_pages(spark: SparkSession) -> DataFrame:
    """The labelled pages that come with the package."""
    return spark.createDataFrame(labelled_pages(), "html string, text string")


def extracted(pages: DataFrame, weights: Weights, page: str = "html") -> DataFrame:
    """All columns of ``pages`` with ``text`` and ``n_chars`` (code points).

    Blocks are joined by an empty line, white space inside a block is one space, character
    references are decoded. A null or empty page, or one without a run that scores above
    zero, gives an empty text; of equal runs the first counts. Repeated pages each have their
    row, an empty table has none, pages of any length are read whole. Columns of ``pages``
    named like an added one are replaced.
    """
    added = ("text", "n_chars")
    keep = [c for c in pages.columns if c not in added]
    frame = pages.select(F.col(f"`{page}`").alias("_page"), *[F.col(f"`{c}`") for c in keep])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), weights) for p in batch.column(0)]
            yield pa.record_batch(
                [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, *added]
            )

    schema = T.StructType([*frame.schema.fields[1:], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return frame.mapInArrow(extract, schema)

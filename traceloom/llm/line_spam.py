"""Pages of keywords, links or product tags instead of sentences, by the shapes of their lines.

Each line (a long line: each of its sentences) is reduced to a shape: its kind of separator, the
words in an item, links, hash signs, codes and capitals, and whether it ends like a sentence.
Shapes are grouped on the page with the words they hold. A page is flagged if the words of its
non-sentence shapes outweigh the others and, unless most are links, tags or stuffed sentences,
their vocabulary repeats as keywords do; records (rows of codes, times, references with a title) are no such
shapes. Text that looks like sentences but turns round one phrase is a shape of its own.

The reduction is one narrow pass: a page's shapes are grouped where the page is read.

Defined results
* null, empty and blank texts: not flagged; plain keywords of which none comes again: not flagged,
  however many (headings and titles are like that);
* very long texts are read line by line, whole;
* a doc_id that occurs twice: each row by its own text, flagged once;
* words are counted between white space; in scripts without blanks two characters count as one;
* other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a page's words in non-sentence shapes above which it is flagged.
MAX_SHARE = 0.5
#: Share of a page's sentence words in one repeated phrase that makes its sentences stuffed.
PHRASE_SHARE = 0.15
PHRASE_COUNT = 4
#: Times it must come in the sentences that hold it, on average.
PHRASE_EACH = 1.4

#: Words that bind sentences (fixed list; English, German and French).
BINDING = frozenset(
    "a an the and or of to in on at by for with from as is are was were be been has have had does do did not but if that which who this these those it its we our they you your shall should may can cannot must will would so because than then when where while until unless after before both each any every into onto over under about against between within without during "
    "der die das den dem des ein eine einen einem einer und oder ist sind war wird wurde werden nicht für von zu zum zur mit bei auf aus nach vor über unter durch um wenn sofern dass muss darf hat haben als im am ist ohne gemäß "
    "le la les l un une des du de d et ou est sont était sera ne pas pour par avec sans sur sous dans en au aux que qui si doit doivent peut a ont être selon ce cette ces il elle".split()
)
_URL = re.compile(r"(?:https?://|www\.)\S+", re.I)
_HASH = re.compile(r"#[^\W_][\w-]*")
_MARK = re.compile(r"^\s*(?:[-*•–>+]|\[[ xX]?\]|\(?\d{1,3}[.)])\s+")
_CITE = re.compile(r"^\s*\[\d+\]\s")
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_END = re.compile(r"[.!?:。！？:]['\"”’)\]]*\s*$")
_INNER_END = re.compile(r"[.!?]\s")
_SENTENCES = re.compile(r"(?<=[.!?。！？])['\"”’)]*(?:\s+|(?<=[。！？]))")
_CODE = re.compile(r"\S*\d\S*")
_YEAR = re.compile(r"(?:19|20)\d\d")
#: separator, the characters it needs, how to cut at it
_SEPARATORS = (
    ("|", "|", re.compile(r"\s*\|\s*")),
    ("tab", "\t", re.compile(r"\t+")),
    ("dash", "-–—", re.compile(r"\s+[-–—]\s+")),
    (";", ";", re.compile(r"\s*;\s*")),
    ("slash", "/", re.compile(r"\s+/\s+")),
    ("dot", "•·", re.compile(r"\s*[•·]\s*")),
    (",", ",、，", re.compile(r"\s*[,、，]\s*")),
)


def _size(text: str) -> int:
    if text.isascii():
        return len(text.split())
    cjk = len(_CJK.findall(text))
    return len((_CJK.sub(" ", text) if cjk else text).split()) + (cjk + 1) // 2


def _bound(words: list[str]) -> int:
    return sum(map(BINDING.__contains__, words))


def shape(line: str) -> tuple[str, tuple]:
    """(kind, shape) of a line; see ``_shape``."""
    return _shape(line, [])


def _shape(line: str, said: list[str]) -> tuple[str, tuple]:
    """(kind, shape) of a line: kind 'links', 'tags', 'list', 'keywords', 'phrase' (a short line that
    may be keywords or wrapped text), 'record' or 'sentence'."""
    # the plain tests in front spare most lines the expressions
    links = _URL.findall(line) if "://" in line or "www." in line.lower() else []
    rest = _URL.sub(" ", line) if links else line
    if not rest[:1].isalpha():
        rest = _MARK.sub("", rest)
    words = _WORDS.findall(rest.lower())
    said[:] = words
    if links:
        label = len(words) / len(links)
        if _CITE.match(line) and label >= 4 or label > 6:
            return "record", ("cite", min(int(label) // 4, 3))
        return "links", ("links", min(len(links), 3), int(label + 0.5) > 0)
    marks = _HASH.findall(rest) if "#" in rest else []
    if marks and 2 * len(marks) >= len([t for t in rest.split() if len(t) > 1]):
        return "tags", ("#", len(marks) > 1)
    ends = bool(_END.search(line))
    bound = _bound(words)
    if ends and 5 * bound > len(words):
        return "sentence", ("sentence", ends)
    tokens = rest.split()
    codes = len(_CODE.findall(rest))
    for name, mark, cut in _SEPARATORS:
        if sum(map(rest.count, mark)) < 2:
            continue
        items = [i for i in cut.split(rest.strip(" |;,/-")) if i]
        if len(items) < 3:
            continue
        coded = sum(not _YEAR.fullmatch(i) and (len(i) < 2 or bool(_CODE.search(i))) for i in items) if codes else sum(len(i) < 2 for i in items)
        if 2 * coded >= len(items):
            return "record", (name, min(len(items), 6))
        sizes = list(map(_size, items))
        if 5 * sum(x > 4 for x in sizes) > len(items):
            continue
        # keywords of several words hold binding words too: then items must come again
        again = len({i.lower() for i in items}) <= 0.75 * len(items)
        if not again and (5 * bound > len(words) and name != "|" or ends and len(items) < 6):
            continue
        return "list", (name, min(len(items) // 4, 3), round(sum(sizes) / len(items)))
    if 3 * codes > len(tokens):
        return "record", ("codes", min(len(tokens), 6))
    n = _size(rest)
    if not ends and words and n <= 8 and ":" not in rest:
        return "keywords" if not bound or n > 5 * bound else "phrase", ("words", min(n, 6), rest[:1].isupper(), rest.istitle())
    if not ends and n > 8 and words and not _CJK.search(rest) and (12 * bound < len(words) or 2 * len(set(words)) <= len(words) and 40 * len(_INNER_END.findall(rest)) < len(words)):
        return "keywords", ("run", min(n // 8, 3))
    return "sentence", ("sentence", ends)


_PAIR = re.compile(r"(?<![^\W_])(?=([^\W\d_]+)[ \xa0]+([^\W\d_]+))")


def _phrase(sentences: list[str], said: Counter) -> str:
    """The pair of content words, or the single one, that the distinct sentences turn round; ''
    if there is none. Words with a mark between them are no pair. ``said``: their words."""
    whole = sum(said.values())
    if 2 * max((n for w, n in said.items() if w not in BINDING), default=0) < PHRASE_SHARE * whole:
        return ""  # no pair can be commoner than its words
    distinct = [s.lower() for s in dict.fromkeys(sentences) if s.isascii() or not _CJK.search(s)]
    single: Counter = Counter()
    for s in distinct:
        single.update(_WORDS.findall(s))
    total = sum(single.values())
    for w in BINDING.intersection(single):
        del single[w]
    pairs = Counter(p for s in distinct for p in _PAIR.findall(s) if p[0] not in BINDING and p[1] not in BINDING)
    for counts, size in ((pairs, 2), (single, 1)):
        if counts:
            p, n = counts.most_common(1)[0]
            if n >= PHRASE_COUNT and size * n >= PHRASE_SHARE * total:
                phrase = " ".join(p) if size == 2 else p
                # a turn of speech comes once in a sentence
                if n >= PHRASE_EACH * sum(phrase in " ".join(_WORDS.findall(s)) for s in distinct):
                    return phrase
    return ""


def page_shapes(text: str) -> list[tuple[str, tuple, int, list[str]]]:
    """(kind, shape, words, the lines) of a page's shapes."""
    groups: dict[tuple, list] = {}
    sentences: list[str] = []
    seen: set[str] = set()
    said: Counter = Counter()
    words: list[str] = []
    for raw in re.split(r"[\r\n\f\x0b\x85\u2028\u2029]+", text):
        line = raw.strip("﻿ \t\xa0")
        if not line:
            continue
        kind, form = _shape(line, words)
        if kind == "sentence":
            if line not in seen:
                seen.add(line)
                said.update(words)
            sentences.extend(x for x in _SENTENCES.split(line) if x)
            continue
        g = groups.setdefault((kind, form), [0, []])
        g[0] += _size(line)
        g[1].append(line)
    phrase = _phrase(sentences, said)
    for s in sentences:
        kind = "sentence"
        if phrase and phrase in " ".join(_WORDS.findall(s.lower())):
            kind = "stuffed"
        g = groups.setdefault((kind, ()), [0, []])
        g[0] += _size(s)
        g[1].append(s)
    return [(k, f, n, lines) for (k, f), (n, lines) in groups.items()]


#: Share of distinct words among the content words of short lines at or below which they are keywords.
FEW_WORDS = 0.3
SPAM_KINDS = ("links", "tags", "list", "keywords", "stuffed")


def judge(text: str | None) -> tuple[bool, float, str]:
    """(flagged, share of words in non-sentence shapes, the shape kind that holds most)."""
    if not text or not text.strip():
        return False, 0.0, ""
    shapes = page_shapes(text)
    if any(k == "phrase" for k, *_ in shapes):
        words = [w.lower() for k, _, _, lines in shapes if k in ("phrase", "keywords") for x in lines for w in _WORDS.findall(x)]
        words = [w for w in words if w not in BINDING]
        kind = "keywords" if len(set(words)) <= FEW_WORDS * len(words) else "sentence"
        shapes = [(kind if k == "phrase" else k, *rest) for k, *rest in shapes]
    total = sum(n for _, _, n, _ in shapes)
    bad = sorted(((n, k, lines) for k, _, n, lines in shapes if k in SPAM_KINDS), key=lambda x: (-x[0], x[1]))
    size = sum(n for n, _, _ in bad)
    if not bad or total == 0:
        return False, 0.0, ""
    share = size / total
    if share <= MAX_SHARE:
        return False, share, bad[0][1]
    # links, tags and stuffed sentences that are most of the page need no further sign
    if sum(n for n, k, _ in bad if k not in ("keywords", "list")) > MAX_SHARE * total:
        return True, share, bad[0][1]
    # headings and the like don't repeat themselves: keywords do
    words = [w.lower() for n, k, lines in bad if k in ("keywords", "list") for x in lines for w in _WORDS.findall(x)]
    return bool(words) and len(set(words)) <= 0.75 * len(words), share, bad[0][1]


def page_verdicts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, flagged, share, kind) of every page."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [judge(t) for t in batch.column(1).to_pylist()]
            flagged, share, kinds = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flagged, pa.bool_()), pa.array(share, pa.float64()), pa.array(kinds, pa.string())], names=[key, "flagged", "share", "kind"])

    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, flagged boolean, share double, kind string")


def spam_pages(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The keys of flagged pages, each once."""
    return page_verdicts(documents, key, text).filter("flagged").select(key).distinct()


def shape_report(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pages and flagged pages by the non-sentence shape that holds most of their words."""
    v = page_verdicts(documents, key, text)
    return v.groupBy("kind").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if("flagged").alias("n_flagged"))

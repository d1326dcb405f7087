"""Column functions over text: tokens, node text, levels, concepts, headings, notes, references."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from traceloom.functions import vocabulary as V
from traceloom.functions.likeness import Prepared, likeness


def tokens(text: Column, stopwords: Sequence[str] = V.STOPWORDS) -> Column:
    """Lower-case words of three or more letters and digits, without stop words, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9]+"), 0)
    return F.filter(found, lambda x: (F.length(x) > 2) & ~x.isin(*stopwords))


def joined(values: Column) -> Column:
    """The elements of an array joined by a blank; null if there is nothing."""
    return F.nullif(F.array_join(values, " "), F.lit(""))


def node_text(text: Column, title: Column, notes: Column, tags: Column) -> Column:
    """What a requirement is compared by: text, title, notes and tags."""
    return F.concat_ws(" ", text, title, joined(notes), joined(tags))


def is_requirement(node_type: Column, text: Column) -> Column:
    return F.coalesce(F.lower(node_type).isin(*V.REQUIREMENT_TYPES), F.lit(False)) | F.coalesce(F.contains(F.lower(text), F.lit("shall")), F.lit(False))


def risk_applies(level: Column, target: str | None, scale: Sequence[str]) -> Column:
    """Whether a level, a range or a list of levels concerns the target."""
    if target is None or not scale:
        return F.lit(True)
    rank = F.array(*[F.lit(s) for s in scale])
    parts = F.transform(F.split(level, "-"), lambda x: F.trim(x))
    low, high = F.array_position(rank, F.element_at(parts, 1)), F.array_position(rank, F.element_at(parts, -1))
    at = F.array_position(rank, F.lit(target))
    inside = F.when((low == 0) | (high == 0) | (at == 0), True).otherwise((low <= at) & (at <= high))
    return F.when(F.lower(level).isin("all", "n/a", ""), True).when(F.contains(level, F.lit(target)), True).when(F.contains(level, F.lit("-")), inside).otherwise(False)


def is_concept(tag: Column) -> Column:
    """Whether a tag can be a concept: two or more letters, one line, no number, no stray short word."""
    t = F.trim(tag)
    stray = (F.length(t) <= 3) & (F.lower(t) == t) & t.rlike("[a-z]") & ~t.isin(*V.SHORT_CONCEPTS)
    return F.coalesce((F.length(t) >= 2) & ~F.contains(t, F.lit("  ")) & ~t.rlike("[\\r\\n]") & ~F.replace(t, F.lit(" ")).rlike("^[0-9]+$") & ~stray, F.lit(False))


@F.pandas_udf(DoubleType())
def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff/Obershelp likeness of two texts, in this order (it isn't symmetric)."""
    last, prepared = "", Prepared("")
    for a, b in pairs:
        out = []
        for x, y in zip(a, b):
            if (y or "") != last:
                last = y or ""
                prepared = Prepared(last)
            out.append(likeness(x or "", prepared))
        yield pd.Series(out, dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """No likeness is above this: twice the shorter length by the sum of both."""
    return F.when(F.length(a) + F.length(b) == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b)))


def letter_counts(text: Column, alphabet: str = "abcdefghijklmnopqrstuvwxyz0123456789 ") -> Column:
    """How often each character occurs; the last place counts all others."""
    each = [F.length(text) - F.length(F.replace(text, F.lit(c))) for c in alphabet]
    return F.array(*each, F.length(F.regexp_replace(text, "[a-z0-9 ]", "")))


def shared_bound(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """A closer bound from letter counts: characters that both have, whatever their order."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return F.when(na + nb == 0, 1.0).otherwise(2.0 * both / (na + nb))


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(#+)", 1))


def section_id(heading: Column) -> Column:
    """The number a heading begins with, '' if none."""
    return F.regexp_extract(F.trim(F.regexp_replace(heading, r"[*_`]", "")), r"^([A-Z][\dA-Z.]*|\d[\d.]*)\s+(.*)$", 1)


def section_level(ident: Column) -> Column:
    return F.when(ident == "", 0).otherwise(F.size(F.split(ident, r"\.")) + 1)


def clause_class(text: Column) -> Column:
    """requirement, recommendation, permission, guideline or overview."""
    word = lambda w: text.rlike(rf"(?i)(^|[^A-Za-z0-9_]){w}($|[^A-Za-z0-9_])")
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "overview").when(word("shall"), "requirement").when(word("should"), "recommendation").when(word("may"), "permission").when(text.rlike(r"(?m)^\s*(NOTE|EXAMPLE)"), "guideline").otherwise("overview")
    )


# How file names and titles name a part.
PART_IN_NAME = (r"(?i)part[_\s-]*(\d+)", r"26262[_-](\d+)", r"\d{4,5}[_-](\d{1,2})")
PART_IN_TEXT = (r"Part\s+(\d+)", r"ISO[/_\s]+(?:DIS[/_\s]+)?\d+-(\d+)")
# How texts name levels, notes, references, clauses and traces.
LEVEL_PATTERN = r"(?i)ASIL\s*[:(]?\s*([A-D][\s,A-D\-&/]*[A-D]?)"
NOTE_PATTERN = r"(?i)(?:NOTE\s*\d*|EXAMPLES?)\s+"
REFERENCE_PATTERN = r"(?i)(?:see|in accordance with|according to|per)\s+([^.;:]+)"
REFERENCE_PART, REFERENCE_SECTION = r"Part\s+(\d+)", r"(?:Clause|Section)?\s+(\d+\.\d+(?:\.\d+)?)"
_SECTION_NUMBER = r"([0-9]+(?:\.[0-9]+)*)"
CLAUSE_PATTERNS = (
    rf"(?i)(?:ISO|IEC)\s+\d+(?:-\d+)?\s+{_SECTION_NUMBER}",
    rf"(?i)(?:clause|section|per|subsection|sub-section)\s+{_SECTION_NUMBER}",
    rf"(?i)(?:requires?|satisfies?|per|derived?\s+from|traced?\s+to|mapped?\s+to)\s+{_SECTION_NUMBER}",
)
TRACE_TAIL = r"\s+([A-Za-z0-9\s\-_]+?)(?:[.,;\n]|$)"
TRACE_FROM = (r"(?i)(?:derives?|derived)\s+from",)
TRACE_TO = (r"(?i)(?:traced?|traces)\s+to", r"(?i)satisfies?", r"(?i)verified?\s+by")


def part_number(text: Column, file_name: Column) -> Column:
    """The part a standard's file or title names, '' if none."""
    found = [F.nullif(F.regexp_extract(file_name, p, 1), F.lit("")) for p in PART_IN_NAME]
    found += [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in PART_IN_TEXT]
    return F.coalesce(*found, F.lit(""))


def level_in_text(text: Column) -> Column:
    """The level or range of levels a text names, '' if none."""
    found = F.trim(F.regexp_extract(text, LEVEL_PATTERN, 1))
    return F.coalesce(F.regexp_replace(F.regexp_replace(found, r"\s+", " "), r"[()\[\]]", ""), F.lit(""))


def notes_in_text(text: Column) -> Column:
    """The texts of NOTE and EXAMPLE blocks, white space collapsed, at most 300 characters each."""
    marked = F.regexp_replace(text, NOTE_PATTERN, "\u0001")
    parts = F.filter(F.split(marked, "\u0001"), lambda x, i: i > 0)
    clean = F.transform(parts, lambda x: F.substring(F.trim(F.regexp_replace(x, r"\s+", " ")), 1, 300))
    return F.filter(clean, lambda x: x != "")


def references_in_text(text: Column) -> Column:
    """(part, section, context) of phrases like 'see Part 3, 7.4'; the context ends at a full
    stop, so dotted sections are cut, as in the format this follows."""
    found = F.regexp_extract_all(text, F.lit(REFERENCE_PATTERN), 1)
    parts = F.transform(found, lambda c: F.struct(F.regexp_extract(c, REFERENCE_PART, 1).alias("part"), F.regexp_extract(c, REFERENCE_SECTION, 1).alias("section"), F.substring(F.trim(c), 1, 100).alias("context")))
    return F.filter(parts, lambda x: x.part != "")


def clauses_in_text(text: Column) -> Column:
    """Section numbers after a standard's number or words like clause, per, satisfies; sorted."""
    return F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in CLAUSE_PATTERNS])))


_IN_WORD = r"[\p{L}\p{N}_]"


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _term_pattern(terms: Sequence[str]) -> str:
    """The longest term at each place where one may begin, by trees over first letters. A term is
    bounded as a word is: where it begins or ends with a letter or digit none may adjoin, where with
    another character one must. A look-ahead, so that terms inside others are found too."""
    escape = lambda t: re.sub(r"([^\w\s])", r"\\\1", t)
    end = lambda t: f"(?!{_IN_WORD})" if _in_word(t[-1]) else f"(?={_IN_WORD})"
    trees = []
    for inside in (True, False):
        by_letter: dict[str, list[str]] = {}
        for t in sorted((t for t in terms if _in_word(t[0]) == inside), key=lambda t: (-len(t), t)):
            by_letter.setdefault(t[0], []).append(escape(t[1:]) + end(t))
        if by_letter:
            tree = "|".join(f"{escape(first)}(?:{'|'.join(rest)})" for first, rest in by_letter.items())
            trees.append(f"(?<{'!' if inside else '='}{_IN_WORD})(?:{tree})")
    return f"(?=({'|'.join(trees)}))"


def terms_in_text(text: Column, terms: Sequence[str]) -> Column:
    """Terms (in lower case) that stand in a text as written, whatever its case, and bounded as
    words, sorted. One regular expression finds the longest at each place; whether a term it begins
    with is bounded there as well is known beforehand."""
    terms = sorted({t for t in terms if t})
    if not terms:
        return F.when(text.isNotNull(), F.array().cast("array<string>"))
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_term_pattern(terms)), 1))
    known = set(terms)
    heads = {t: [t[:n] for n in range(1, len(t)) if t[:n] in known and _in_word(t[n - 1]) != _in_word(t[n])] + [t] for t in terms}
    several = {t: ps for t, ps in heads.items() if len(ps) > 1}
    if several:
        more = F.create_map(*[x for t, ps in several.items() for x in (F.lit(t), F.array(*[F.lit(p) for p in ps]))])
        found = F.array_distinct(F.flatten(F.transform(found, lambda t: F.coalesce(F.try_element_at(more, t), F.array(t)))))
    return F.array_sort(found)


def traces_in_text(text: Column) -> tuple[Column, Column]:
    """(from, to): what a text says it is derived from, and what it is traced to, satisfies or is
    verified by; without repeats, in order."""
    def find(patterns: Sequence[str]) -> Column:
        every = F.concat(*[F.regexp_extract_all(text, F.lit(p + TRACE_TAIL), 1) for p in patterns])
        return F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: (x != "") & (F.length(x) < 200)))

    return find(TRACE_FROM), find(TRACE_TO)


def tags_in_text(text: Column, acronyms: Sequence[str] = V.TAG_ACRONYMS, keywords: Sequence[str] = V.TAG_KEYWORDS) -> Column:
    """Known acronyms as written or emphasised, and keywords with a capital letter, sorted."""
    marked = F.transform(F.regexp_extract_all(text, F.lit(r"[*_]{1,2}([A-Za-z\s]+?)[*_]{1,2}"), 1), lambda x: F.upper(F.trim(x)))
    marked = F.array_intersect(marked, F.array(*[F.lit(a) for a in (*acronyms, *V.EMPHASISED_ACRONYMS)]))
    upper = F.array_intersect(F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Z0-9]{2,})\b"), 1), F.array(*[F.lit(a) for a in acronyms]))
    words = F.transform(terms_in_text(text, keywords), lambda x: F.initcap(x))
    return F.array_sort(F.array_distinct(F.concat(marked, upper, words)))


# Lines of converted pages that are no content.
NOISE_LINES = (
    r"(?i)Normen-Download-Beuth", r"©\s*ISO\s+\d{4}", r"All rights reserved", r"ISO/DIS\s+\d+-\d+:\d{4}", r"^\s*\d+\s*\x{feff}?\s*$", r"DRAFT INTERNATIONAL STANDARD", r"COPYRIGHT PROTECTED DOCUMENT", r"KdNr\.\d+", r"^\s*\x{feff}\s*$",
)


def is_noise_line(line: Column) -> Column:
    return F.coalesce((F.trim(line) != "") & line.rlike("|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p in NOISE_LINES)), F.lit(False))


def priority_of(line: Column) -> Column:
    """HIGH, MEDIUM or LOW by the tag in a line."""
    return F.when(F.contains(line, F.lit("[HIGH]")), "HIGH").when(F.contains(line, F.lit("[MEDIUM]")), "MEDIUM").otherwise("LOW")


def without_priority(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"\[(HIGH|MEDIUM|LOW)\]", ""))


def html_escaped(text: Column) -> Column:
    """Escaped for HTML; null gives ''."""
    out = F.coalesce(text, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def text_bar(score: Column, step: int = 5) -> Column:
    """A bar of '#', one for each full step of a score."""
    return F.repeat(F.lit("#"), F.floor(score / step).cast("int"))


def document_id(prefix: str, date: Column) -> Column:
    """The prefix with a date without dashes, DRAFT without a date."""
    return F.concat(F.lit(f"{prefix}-"), F.coalesce(F.replace(F.substring(date, 1, 10), F.lit("-")), F.lit("DRAFT")))


def dashboard_letter(score: Column) -> Column:
    """The second scale of letters: 90, 80, 70, 60."""
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def score_class(score: Column) -> Column:
    return F.when(score >= 85, "good").when(score >= 60, "fair").otherwise("poor")


def inverse_percent(score: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 - score))

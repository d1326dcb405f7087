"""Noise in text from scanned pages: divided words, misread characters, head lines, page numbers.

1. Statistics of the whole corpus: words, adjacent pairs and skip-gram pairs, counted apart for
   texts that were never on paper.
2. Links: words that look alike to a scanner have the same strokes (``strokes``: every glyph edit
   keeps them), so a word that only scans hold meets its frequent neighbours by an equi-join on
   its strokes, whatever their length; pairs that two glyph edits can't explain are dropped.
3. Context: where several readings are left, or a real word could be a misread, commoner one, each
   occurrence is decided by itself, by the skip-gram model: the readings' word vectors (shifted positive
   pointwise mutual information, which is what skip-gram training with negative samples factorises,
   projected to ``DIMENSIONS`` by signed hashing) against the sum of its neighbours' context vectors
   (of the same projection). Vectors are made for the readings, and no other words.
4. Lines: a page number is a line that only numbers. A head line is one whose word pairs the
   unscanned texts don't know and that comes again in its volume, or that is wholly strange.
5. With that furniture gone, words divided at line ends are joined where the whole is a word or
   the mark only ever divides; misread words are corrected; the lines are reflowed.

Words of a text are joined with the statistics by equi-joins, which adaptive execution
broadcasts where they are small; nothing is collected to the driver.

Defined results
* rows without a volume were never on paper: they feed the statistics and have no defects;
* null and empty texts, null notes: no defects, reflowed to themselves;
* a hyphen that belongs (``end-to-end``, ``short- and``, identifiers) is kept;
* identifiers and numbers are never misread words;
* a corpus without unscanned texts: words are judged by frequency alone, and no line is strange,
  so none is reported as a head line;
* a real word is a misread one only where its neighbours say so: the word before it is never followed by
  it in unscanned texts but by the other, and the other's vector is much nearer to its neighbours' ones;
* a divided word goes on where a later line begins in lower case, any number of blank lines, page numbers
  and capitalised lines further on;
* words, lines and texts of any length are read whole, item by item;
* a clause delivered twice counts once, as delivered first; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from traceloom.llm.common import once
from traceloom.session import scratch_path, stored

#: wrong -> right glyphs that scanning confuses (fixed list)
GLYPHS = (
    ("г", "r"), ("f", "t"), ("t", "f"), ("à", "a"), ("á", "a"), ("é", "e"), ("è", "e"), ("í", "i"), ("ó", "o"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("0", "o"), ("1", "l"), ("1", "i"), ("ii", "u"), ("cl", "d"), ("d", "cl"),
    ("9", "g"), ("5", "s"), ("6", "b"), ("8", "b"), ("rn", "m"), ("m", "rn"), ("m", "in"), ("m", "ni"), ("in", "m"), ("b", "h"), ("h", "b"), ("h", "li"), ("li", "h"), ("vv", "w"), ("c", "e"), ("e", "c"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("u", "ii"), ("i", "l"), ("l", "i"), ("о", "o"), ("а", "a"), ("е", "e"),
)
#: What glyphs are made of, so that both sides of each pair above have the same strokes.
STROKES = {
    **dict.fromkeys("iІíî1!|rгl", "l"), **dict.fromkeys("cceéèе", "c"), **dict.fromkeys("tf", "t"), **dict.fromkeys("oо0ó", "o"), **dict.fromkeys("aаàá", "a"), **dict.fromkeys("g9", "g"), **dict.fromkeys("s5", "s"),
    **dict.fromkeys("nuhb68", "ll"), "m": "lll", "d": "cl", "w": "vv", "ﬁ": "tl", "ﬂ": "tl",
}
#: How much nearer a reading's vector must be before a real word counts as misread.
MARGIN = 0.25
#: Lines in lower case behind a hyphen that may go on its word (others can't, and aren't counted).
GOES_ON = 4
#: marks that divide a word at a line end; the last three never stand for anything else
HYPHENS = "-‑¬\xad‐"
DIVIDERS = "¬\xad‐"
DIMENSIONS = 256
WINDOW = 2
#: A frequent neighbour: in so many unscanned texts, or so many times the rare word's count.
CLEAN_COUNT = 2
FREQUENT_RATIO = 5

#: Readings of tokens kept at a time in one worker (they are made again when needed).
TOKENS_KEPT = 200_000

_BREAK = re.compile(r"\r\n|[\n\r\f\x0b\x85\u2028\u2029]")
_CORE = re.compile(r"^[(\[{\"“”‘'«<]*(.*?)[)\]}\"“”’'».,;:?!>]*$", re.S)
_WORD = re.compile(r"^[^\W\d_](?:[^\W_]|[-‑!|])*$|^[^\W_!|]?[!|\d]?[^\W\d_](?:[^\W_]|[-‑!|])*$")
#: a number apart from the rest, as heads have it
_NUMBERED = re.compile(r"(?:\.\s){2,}|\s{2,}\d+\s*$|^\s*\d+\s{2,}|\s\d+\s*$")
_PAGE = re.compile(r"^\W*(?:p(?:[.,]|a[g9q][ec])?\s*)?\d{1,5}(?:\s*(?:of|/|von|sur)\s*\d{1,5})?\W*$", re.I)
_MARKED_NUMBER = re.compile(r"^\s*[-–—\[(|]?\s*(?:p\S{0,3}\s*)?\d{1,5}\s*(?:of\s*\d{1,5})?\s*[-–—\])|]?\s*$", re.I)


class Token(NamedTuple):
    """A run of what isn't white space: its word ('' if it is none), the hyphen it ends with, and
    whether a dividing mark lies inside it."""

    line: int
    raw: str
    word: str
    end: str
    inner: bool


def _read(raw: str) -> tuple[str, str, bool]:
    """(word, end, inner) of a token."""
    end = raw[-1] if len(raw) > 1 and raw[-1] in HYPHENS and raw[-2].isalnum() else ""
    core = _CORE.match(raw[:-1] if end else raw)[1]
    inner = any(c in core for c in "¬\xad")
    if inner:
        core = core.replace("¬", "").replace("\xad", "")
    letters = sum(c.isalpha() for c in core)
    plain = letters >= 2 and 2 * (len(core) - letters) <= len(core) and bool(_WORD.match(core)) and not (core[:1].isupper() and any(c.isdigit() for c in core) and letters < 4)
    return core if plain else "", end, inner


class _Readings(dict):
    """Token -> its reading: texts repeat their words."""

    def __missing__(self, raw: str) -> tuple[str, str, bool]:
        made = _read(raw)
        if len(raw) <= 64:
            if len(self) >= TOKENS_KEPT:
                self.clear()
            self[raw] = made
        return made


_readings = _Readings()


def lines_of(text: str) -> list[str]:
    return _BREAK.split(text)


def tokens_of(text: str) -> list[Token]:
    return [Token(i, t, *_readings[t]) for i, line in enumerate(lines_of(text)) for t in line.split()]


def joints(tokens: list[Token]) -> Iterator[tuple[int, int, str]]:
    """(k, n, word): token k ends with a hyphen and may go on in token n: next to it if lines were
    joined since, else at the start of a later line that doesn't begin with a capital, however far page
    furniture pushed it."""
    starts = [k for k, t in enumerate(tokens) if (k == 0 or tokens[k - 1].line != t.line) and t.word and not t.word[0].isupper()]
    at = 0
    for k, t in enumerate(tokens):
        if t.end and t.word:
            if k + 1 < len(tokens) and tokens[k + 1].line == t.line:
                nexts = [k + 1] if tokens[k + 1].word else []
            else:
                while at < len(starts) and starts[at] <= k:
                    at += 1
                nexts = starts[at : at + GOES_ON]
            for n in nexts:
                yield k, n, (t.word + tokens[n].word).lower()


def is_page_number(line: str) -> bool:
    return bool(_MARKED_NUMBER.match(line)) and bool(_PAGE.match(line))


def _pairs(tokens: list[Token]) -> list[str]:
    """The words in their order, '<n>' for a name after an article, '' for what is no word."""
    out, before = [], ""
    for t in tokens:
        w = t.word
        low = w.lower()
        if w[:1].isupper() and w[1:].islower() and before == "the":
            out.append("<n>")
        else:
            out.append(low)
        before = low
    return out


def strokes(word: str) -> str:
    """The strokes of a word: equal for words that glyph edits turn into each other."""
    return "".join([STROKES.get(c, c) for c in word])


def stroke_column(word: Column) -> Column:
    """The same as an expression."""
    for glyph, made in STROKES.items():
        if len(made) > 1 or len(glyph) > 1:
            word = F.replace(word, F.lit(glyph), F.lit(made))
    single = {g: m for g, m in STROKES.items() if len(g) == 1 and len(m) == 1 and g != m}
    return F.translate(word, "".join(single), "".join(single.values()))


_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _wrong, _right in GLYPHS:
    _BY_FIRST.setdefault(_wrong[0], []).append((_wrong, _right))


def glyph_edits(wrong: str, right: str, most: int = 2) -> int | None:
    """The least number of glyph edits, at most ``most``, that explain one word as a misreading of another."""
    level = {(0, 0)}
    for used in range(most + 1):
        after, stack, seen = set(), list(level), set(level)
        while stack:
            i, j = stack.pop()
            while True:
                if i == len(wrong) and j == len(right):
                    return used
                if used < most and i < len(wrong):
                    after.update((i + len(a), j + len(b)) for a, b in _BY_FIRST.get(wrong[i], ()) if wrong.startswith(a, i) and right.startswith(b, j))
                if i < len(wrong) and j < len(right) and wrong[i] == right[j]:
                    i, j = i + 1, j + 1
                    if (i, j) in seen:
                        break
                    seen.add((i, j))
                else:
                    break
        level = after
    return None


ITEM = "clause_key bigint, volume string, field_name string, item_pos int, text string"
_KEY = ["clause_key", "field_name", "item_pos"]


def scan_items(clauses: DataFrame) -> DataFrame:
    """One row for each text (item_pos 0) and note (from 1) of each clause."""
    c = once(clauses, "clause_key", "volume", "text", "notes")
    texts = c.select("clause_key", "volume", F.lit("text").alias("field_name"), F.lit(0).alias("item_pos"), "text")
    notes = c.select("clause_key", "volume", F.posexplode("notes").alias("p", "text")).select("clause_key", "volume", F.lit("notes").alias("field_name"), (F.col("p") + 1).alias("item_pos"), "text")
    return texts.unionAll(notes).filter(F.col("text").isNotNull())


def corpus_statistics(items: DataFrame) -> DataFrame:
    """(kind, a, b, n, n_clean): kind 'w' words, 'b' adjacent pairs, 's' skip-gram pairs,
    'j' words of scans put together over a line end. Counted in each batch before anything is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, clean, joined, adjacent, skips = (Counter() for _ in range(5))
            for volume, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = tokens_of(text)
                seq = _pairs(tokens)
                plain = [t.word.lower() for t in tokens if t.word]
                words.update(plain)
                if volume is None:
                    clean.update(plain)
                    adjacent.update(zip(seq, seq[1:]))
                else:
                    joined.update(w for _, _, w in joints(tokens))
                kept = [w for w in seq if w]
                for d in range(1, WINDOW + 1):
                    skips.update(zip(kept, kept[d:]))
            rows = [("w", w, "", n, clean[w]) for w, n in words.items()]
            rows += [("j", w, "", n, 0) for w, n in joined.items()]
            rows += [("b", *p, n, n) for p, n in adjacent.items() if all(p)]
            rows += [("s", *p, n, 0) for p, n in skips.items()]
            kind, a, b, n, m = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=["kind", "a", "b", "n", "n_clean"])

    counted = items.select("volume", "text").mapInArrow(run, "kind string, a string, b string, n bigint, n_clean bigint")
    return counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"), F.sum("n_clean").alias("n_clean"))


def projected(word: str) -> tuple[Column, Column]:
    """(dimension, sign) of a word's context vector, by a hash."""
    h = F.xxhash64(word)
    return F.pmod(h, F.lit(DIMENSIONS)).cast("int"), F.when(F.shiftright(h, 20).bitwiseAND(1) == 1, 1.0).otherwise(-1.0)


def skip_gram_vectors(pairs: DataFrame, words: DataFrame, used: DataFrame, shift: float = 1.0) -> DataFrame:
    """(word, vector) of the ``used`` words: shifted positive PMI of the pairs (a, b, n), which stand in
    the order of the text, with the words' counts (word, n); projected by signed hashing."""
    both = pairs.select("a", "b", "n").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    x = both.join(used.select(F.col("word").alias("a")), "a", "left_semi").groupBy("a", "b").agg(F.sum("n").alias("n"))
    total = words.agg(F.sum("n").alias("n_total"))
    x = x.join(words.select(F.col("word").alias("a"), F.col("n").alias("n_a")), "a").join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b").crossJoin(F.broadcast(total))  # one row
    # each word has up to 2 * WINDOW neighbours
    pmi = F.log(F.col("n").cast("double") * F.col("n_total") / (2.0 * WINDOW * F.col("n_a") * F.col("n_b"))) + F.lit(shift)
    d, sign = projected("b")
    x = x.withColumn("p", F.greatest(pmi, F.lit(0.0)) * sign).withColumn("d", d)
    sums = x.groupBy("a", "d").agg(F.sum("p").alias("p"))
    return sums.groupBy(F.col("a").alias("word")).agg(F.map_from_entries(F.collect_list(F.struct("d", "p"))).alias("vector"))


def word_links(statistics: DataFrame) -> DataFrame:
    """(word, correction, correction_clean, n_correction, edits, real): what a word may be a misreading of. Words
    that only scans hold: their frequent neighbours by two glyph edits; ``real`` words, which unscanned texts hold
    too: much commoner words by one."""
    words = statistics.filter("kind = 'w'").select(F.col("a").alias("word"), "n", "n_clean")
    joined = statistics.filter("kind = 'j'").select(F.col("a").alias("word"), "n").join(words.filter("n_clean > 0"), "word", "left_anti")
    rare = words.filter("n_clean = 0").select("word", "n").unionAll(joined).groupBy("word").agg(F.max("n").alias("n"))
    asked = rare.select("word", "n", F.lit(0).cast("bigint").alias("own_clean")).unionAll(words.filter("n_clean > 0").select("word", "n", F.col("n_clean").alias("own_clean")))
    asked = asked.withColumn("strokes", stroke_column(F.col("word")))
    known = words.filter(F.length("word") >= 2).select(F.col("word").alias("correction"), F.col("n").alias("n_correction"), F.col("n_clean").alias("correction_clean"), stroke_column(F.col("word")).alias("strokes"))
    frequent = (F.col("correction_clean") >= CLEAN_COUNT) | (F.col("n_correction") >= FREQUENT_RATIO * F.col("n"))
    commoner = F.col("correction_clean") >= FREQUENT_RATIO * F.col("own_clean")
    x = asked.join(known, "strokes").filter((F.col("word") != F.col("correction")) & F.when(F.col("own_clean") > 0, commoner).otherwise(frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits = [glyph_edits(w, c) for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edits, pa.int32())], names=[*batch.schema.names, "edits"])

    x = x.select("word", "correction", "correction_clean", "n_correction", (F.col("own_clean") > 0).alias("real"))
    x = x.mapInArrow(run, "word string, correction string, correction_clean bigint, n_correction bigint, real boolean, edits int")
    x = x.filter(F.col("edits") <= F.when(F.col("real"), 1).otherwise(2))
    # beside a neighbour that unscanned texts hold, one that only scans hold is a misreading of the same
    known = F.max("correction_clean").over(Window.partitionBy("word", "real"))
    return x.withColumn("known", known).filter((F.col("correction_clean") > 0) | (F.col("known") == 0)).drop("known")


def type_corrections(links: DataFrame) -> DataFrame:
    """(word, correction, correction_clean) of the words that only scans hold: where contexts say nothing, a
    neighbour in unscanned texts, then the fewest edits, then the commonest."""
    best = F.max_by(F.struct("correction", "correction_clean"), F.struct(F.col("correction_clean") > 0, -F.col("edits"), "n_correction", "correction"))
    return links.filter(~F.col("real")).groupBy("word").agg(best.alias("b")).select("word", "b.*")


def open_words(links: DataFrame) -> DataFrame:
    """(word) of words whose occurrences are decided by context: those with several readings, and real ones."""
    return links.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.bool_or("real").alias("real")).filter("n > 1 or real").select("word")


def open_occurrences(judged: DataFrame) -> DataFrame:
    """(item key, k, word, before, near): the occurrences that context decides, with their neighbours."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["clause_key", "field_name", "item_pos", "k", "word", "before", "near"]
        types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]
        for batch in batches:
            rows = []
            for key, field, pos, text, ks, kinds, opens in zip(*(c.to_pylist() for c in batch.columns)):
                seq = _pairs(tokens_of(text))
                for k in sorted(k for k, kind, x in zip(ks, kinds, opens) if x and kind == "t"):
                    near = [w for w in (*seq[max(0, k - WINDOW) : k], *seq[k + 1 : k + 1 + WINDOW]) if w]
                    rows.append((key, field, pos, k, seq[k], seq[k - 1] if k else "", near))
            columns = zip(*rows) if rows else ([] for _ in names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    few = judged.filter(F.exists("open", lambda x: x)).select(*_KEY, "text", "k", "kind", "open")
    return few.mapInArrow(run, "clause_key bigint, field_name string, item_pos int, k int, word string, before string, near array<string>")


def context_corrections(occurrences: DataFrame, statistics: DataFrame, links: DataFrame) -> DataFrame:
    """(item key, k, own, own_clean): corrections of single occurrences, by their neighbours. An
    occurrence that this leaves alone has no row."""
    several = open_words(links)
    context = occurrences.select(*_KEY, "k", F.explode("near").alias("x"))
    readings = links.select("word", "correction", "correction_clean", "n_correction", "real", "edits")
    own = links.filter("real").select("word").distinct().join(statistics.filter("kind = 'w'").select(F.col("a").alias("word"), F.col("n").alias("n_correction"), F.col("n_clean").alias("correction_clean")), "word")
    readings = readings.unionByName(own.select("word", F.col("word").alias("correction"), "correction_clean", "n_correction", F.lit(True).alias("real"), F.lit(0).alias("edits")))
    used = links.join(several, "word", "left_semi").select("correction").union(several).distinct().toDF("word")
    words = statistics.filter("kind = 'w'").select(F.col("a").alias("word"), "n")
    vectors = skip_gram_vectors(statistics.filter("kind = 's'").select("a", "b", "n"), words, used)
    d, sign = projected("x")
    around = context.groupBy(*_KEY, "k", d.alias("d")).agg(F.sum(sign).alias("p")).groupBy(*_KEY, "k").agg(F.map_from_entries(F.collect_list(F.struct("d", "p"))).alias("va"))
    x = occurrences.join(readings, "word").join(vectors.select(F.col("word").alias("correction"), F.col("vector").alias("vb")), "correction", "left").join(around, [*_KEY, "k"], "left")
    at = lambda v, d: F.coalesce(F.try_element_at(v, d), F.lit(0.0))
    dot = lambda p, q: F.aggregate(F.map_keys(p), F.lit(0.0), lambda s, d: s + at(F.col(p), d) * at(F.col(q), d))
    likeness = F.coalesce(F.try_divide(dot("va", "vb"), F.sqrt(dot("va", "va") * dot("vb", "vb"))), F.lit(0.0))
    # whether unscanned texts hold the word before it and this reading, one after the other
    pairs = statistics.filter("kind = 'b'").select(F.concat_ws("\t", "a", "b").alias("pair"), F.lit(True).alias("known"))
    x = x.withColumn("likeness", likeness).withColumn("pair", F.concat_ws("\t", "before", "correction")).join(pairs, "pair", "left")
    itself = F.col("correction") == F.col("word")
    r = F.struct(F.coalesce("known", F.lit(False)).alias("known"), "likeness", F.col("correction_clean") > 0, -F.col("edits"), "n_correction", "correction", "correction_clean")
    g = x.groupBy(*_KEY, "k", "real").agg(F.max(F.when(~itself, r)).alias("best"), F.max(F.when(itself, F.struct(F.coalesce("known", F.lit(False)).alias("known"), "likeness"))).alias("own"))
    sure = ~F.col("real") | (F.col("best.known") & ~F.col("own.known") & (F.col("best.likeness") > F.col("own.likeness") + MARGIN))
    return g.filter(F.col("best").isNotNull() & sure).select(*_KEY, "k", F.col("best.correction").alias("own"), F.col("best.correction_clean").alias("own_clean"))


def item_words(items: DataFrame) -> DataFrame:
    """Rows (item key, line, k, kind, word, before) of scanned items: 't' tokens with the word
    before them, 'j' a word divided at a line end joined with the start of one of the next lines,
    'c' the same as a compound with its hyphen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["clause_key", "field_name", "item_pos", "line", "k", "kind", "word", "before"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for key, field, pos, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                tokens = tokens_of(text)
                seq = _pairs(tokens)
                before, last = [], -1
                for t, w, x in zip(tokens, seq, ["", *seq]):
                    before.append(f"{x}\t{w}" if x and w and t.line == last else "")
                    last = t.line
                more = [(tokens[k].line, k, mark + str(n), w) for k, n, joined in joints(tokens) for mark, w in (("j", joined), ("c", f"{tokens[k].word}-{tokens[n].word}".lower()))]
                size = len(tokens) + len(more)
                out[0] += [key] * size
                out[1] += [field] * size
                out[2] += [pos] * size
                out[3] += [t.line for t in tokens] + [r[0] for r in more]
                out[4] += [*range(len(tokens)), *(r[1] for r in more)]
                out[5] += ["t"] * len(tokens) + [r[2] for r in more]
                out[6] += [t.word.lower() for t in tokens] + [r[3] for r in more]
                out[7] += before + [""] * len(more)
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return items.select("clause_key", "field_name", "item_pos", "text").mapInArrow(run, "clause_key bigint, field_name string, item_pos int, line int, k int, kind string, word string, before string")


def _spread(name: str) -> Column:
    """A join key in which the empty text, which most rows may have, is many keys that nothing else has."""
    return F.when(F.col(name) == "", F.concat(F.lit("\0"), F.pmod(F.xxhash64(*_KEY, "k"), F.lit(4096)).cast("string"))).otherwise(F.col(name))


def judged_items(items: DataFrame, statistics: DataFrame, links: DataFrame) -> DataFrame:
    """Each scanned item with what is known of its words: the arrays of FACTS, side by side."""
    info = statistics.filter("kind = 'w'").select(F.col("a").alias("word"), "n", "n_clean").join(type_corrections(links), "word", "full_outer")
    info = info.join(open_words(links).withColumn("open", F.lit(True)), "word", "left").withColumnRenamed("word", "__word")
    pairs = statistics.filter("kind = 'b'").select(F.concat_ws("\t", "a", "b").alias("__before"), F.lit(True).alias("pair"))
    w = item_words(items).withColumn("__word", _spread("word")).withColumn("__before", _spread("before"))
    w = w.join(info, "__word", "left").join(pairs, "__before", "left")
    fact = F.struct("kind", "k", F.coalesce("n_clean", F.lit(0)).alias("clean"), F.coalesce("n", F.lit(0)).alias("n"), "correction", F.coalesce("correction_clean", F.lit(0)).alias("fixed"), F.coalesce("pair", F.col("before") == "").alias("pair"), F.coalesce("open", F.lit(False)).alias("open"))
    facts = w.groupBy(*_KEY).agg(F.array_sort(F.collect_list(fact)).alias("f"))  # tokens last, in their order
    # side by side as plain arrays, which Arrow hands to Python fastest
    flat = facts.select(*_KEY, *[F.col(f"f.{c}").alias(c) for c in (*FACTS, "open")])
    judged = stored(items.join(flat, _KEY, "left"), "scan-judged")
    some = F.coalesce(F.exists("open", lambda x: x), F.lit(False))
    own = context_corrections(open_occurrences(judged), statistics, links).groupBy(*_KEY).agg(F.collect_list(F.struct("k", F.col("own").alias("correction"), F.col("own_clean").alias("fixed"))).alias("own"))
    # the few items with such occurrences are joined with what was decided, the others pass as they are
    kept = [*_KEY, "volume", "text", *FACTS]
    none = F.lit(None).cast("array<struct<k:int,correction:string,fixed:bigint>>").alias("own")
    return judged.filter(~some).select(*kept, none).unionAll(judged.filter(some).select(*kept).join(own, _KEY, "left").select(*kept, "own"))


#: What is known of a word: its place, what it is to the item, counts in unscanned texts and in
#: all, its correction with that one's count in unscanned texts, and whether the pair is known. The
#: tokens ('t') come last, in their order; before them words over line ends ('c' and 'j').
FACTS = ("k", "kind", "clean", "n", "correction", "fixed", "pair")


class Fact(NamedTuple):
    clean: int
    n: int
    correction: str | None
    fixed: int
    pair: bool


class Page:
    """One scanned item with its facts: of each token in lists, of words over line ends by their places."""

    def __init__(self, text: str, own: list | None, *facts: list | None):
        self.text, self.lines, self.tokens = text, lines_of(text), tokens_of(text)
        ks, kinds, *rest = (f or [] for f in facts)
        at = len(ks) - len(self.tokens)
        self.clean, self.n, self.correction, self.fixed, self.pair = (r[at:] for r in rest)
        for o in own or ():
            self.correction[o["k"]], self.fixed[o["k"]] = o["correction"], o["fixed"]
        self.joint: dict[tuple[int, int], Fact] = {}
        self.compound: set[tuple[int, int]] = set()
        for i in range(at):
            k, kind = ks[i], kinds[i]
            if kind[0] == "j":
                self.joint[k, int(kind[1:])] = Fact(*(r[i] for r in rest))
            elif rest[0][i] > 0:
                self.compound.add((k, int(kind[1:])))
        self.of_line: dict[int, list[int]] = {}
        for k, t in enumerate(self.tokens):
            self.of_line.setdefault(t.line, []).append(k)
        self.numbers = {i for i in self.of_line if is_page_number(self.lines[i])}

    def strangeness(self, line: int) -> tuple[int, int, int]:
        """(pairs judged, pairs known, words known) of a line; pairs at a divided word, or at a misread
        one of the running text, aren't judged."""
        ks = self.of_line[line]
        judged = known = words = 0
        for i, k in enumerate(ks):
            t = self.tokens[k]
            words += bool(t.word) and not (i == len(ks) - 1 and t.end) and not (i == 0 and self._divided_before(line)) and (self.clean[k] > 0 or self.fixed[k] > 0)
            if i == 0 or not t.word or not self.tokens[ks[i - 1]].word:
                continue
            if self.fixed[k] or t.end or self.fixed[ks[i - 1]] or self.tokens[ks[i - 1]].end or i == 1 and line > 0 and self._divided_before(line):
                continue
            judged += 1
            known += self.pair[k]
        return judged, known, words

    def _divided_before(self, line: int) -> bool:
        """Whether a line begins, in lower case, where the last one ended within a word."""
        if not self.tokens[self.of_line[line][0]].word[:1].islower():
            return False
        for n in range(line - 1, -1, -1):
            if n in self.of_line and n not in self.numbers:
                return bool(self.tokens[self.of_line[n][-1]].end)
        return False

    def head_candidates(self) -> list[tuple[int, str, int]]:
        """(line, what it says without numbers, how sure)."""
        out = []
        for line, ks in self.of_line.items():
            # halves of divided words say nothing
            words = [k for k in ks if self.tokens[k].word and not (k == ks[-1] and self.tokens[k].end) and not (k == ks[0] and self._divided_before(line))]
            if line in self.numbers or len(words) < 2:
                continue
            judged, known, clean = self.strangeness(line)
            # 2: strange by itself, 1: strange if the same line is found elsewhere, 0: perhaps, if it is surely one elsewhere
            if judged:
                sure = 2 if not known and (judged >= 2 or not clean or _NUMBERED.search(self.lines[line])) or 4 * known <= judged >= 4 else 1 if 3 * known <= judged else -1
            else:
                sure = 2 if 3 * clean <= len(words) else 0
            if sure >= 0:
                out.append((line, head_key(self.lines[line]), sure))
        return out

    def divided(self, k: int, n: int) -> bool:
        """Whether token k, which ends with a hyphen, and token n were one word."""
        left, right = self.tokens[k], self.tokens[n]
        f = self.joint.get((k, n))
        if f is None or not right.word[:1].islower() and right.word[:1].isalpha():
            return False
        if f.clean > 0 or left.end in DIVIDERS:
            return True
        if (k, n) in self.compound:
            return False
        if f.correction:
            return True
        # a plain hyphen: a word of its own on either side belongs to a compound
        whole = lambda x: self.clean[x] > 0 and len(self.tokens[x].word) > 2
        return f.n > 2 * max(1, self.n[k]) or not whole(n) and not whole(k)

    def read(self, heads: set[int]) -> tuple[set[str], str]:
        """(kinds of defects, the repaired and reflowed text)."""
        defects: set[str] = set()
        if self.numbers - heads:
            defects.add("page_number")
        if heads:
            defects.add("running_header")
        gone = heads | self.numbers
        keep = [k for k, t in enumerate(self.tokens) if t.line not in gone]
        parts: list[tuple[int, str]] = []
        i = 0
        while i < len(keep):
            k = keep[i]
            t = self.tokens[k]
            if t.inner:
                defects.add("broken_word")
            n = keep[i + 1] if i + 1 < len(keep) else None
            if t.end and n is not None and self.divided(k, n):
                defects.add("broken_word")
                fix = self.joint[k, n].correction
                if fix or _strange_glyphs(t.word + self.tokens[n].word):
                    defects.add("misread")
                stem = t.raw[:-1] + self.tokens[n].raw
                parts.append((t.line, _respell(stem, t.word + self.tokens[n].word, fix)))
                i += 2
                continue
            fix = self.correction[k] if t.word and not (t.end and n is not None and self.tokens[n].line != t.line and t.end in DIVIDERS) else None
            if fix or t.word and _strange_glyphs(t.word):
                defects.add("misread")
            raw = t.raw.replace("¬", "").replace("\xad", "") if t.inner else t.raw
            parts.append((t.line, _respell(raw, t.word, fix)))
            i += 1
        return defects, self._reflow(parts, gone)

    def _reflow(self, parts: list[tuple[int, str]], gone: set[int]) -> str:
        """One line for each paragraph: a blank line or a list mark begins one."""
        out: list[str] = []
        before = None
        for line, word in parts:
            fresh = before is None
            if before is not None and line != before:
                between = range(before + 1, line)
                blank = any(not self.lines[n].strip() for n in between) and not any(n in gone for n in between)
                fresh = blank or bool(re.match(r"^\s*(?:[-–*•]|\d+[.)])\s", self.lines[line])) or self.lines[before].rstrip().endswith(":")
            if fresh:
                out.append(word)
            else:
                out[-1] += " " + word
            before = line
        return "\n".join(out)


def head_key(line: str) -> str:
    """What a head line says, without numbers and marks: its strokes, which misreadings keep."""
    low = re.sub(r"(?<![^\W_])\d+(?![^\W_])", " ", line.lower())
    return re.sub(r"[\W\d_]", "", strokes(low))


def _strange_glyphs(word: str) -> bool:
    """Letters of two scripts in one word."""
    if word.isascii():
        return False
    latin = cyrillic = False
    for c in word:
        latin |= "a" <= c.lower() <= "z"
        cyrillic |= "Ѐ" <= c <= "ӿ"
    return latin and cyrillic


def _respell(raw: str, word: str, fix: str | None) -> str:
    if not fix:
        return raw
    if word[:1].isupper():
        fix = fix.upper() if word.isupper() and len(word) > 1 else fix[:1].upper() + fix[1:]
    return raw.replace(word, fix, 1)


def head_lines(judged: DataFrame) -> DataFrame:
    """(item key, heads): the head lines of each item that has some."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["clause_key", "field_name", "item_pos", "volume", "line", "says", "sure"]
        types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32()]
        for batch in batches:
            rows = []
            for key, field, pos, volume, *page in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(key, field, pos, volume, *c) for c in Page(*page).head_candidates()]
            columns = zip(*rows) if rows else ([] for _ in names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    schema = "clause_key bigint, field_name string, item_pos int, volume string, line int, says string, sure int"
    c = judged.select(*_KEY, "volume", "text", "own", *FACTS).mapInArrow(run, schema)
    c = stored(c, "scan-lines")
    # how often a line comes in its volume: summed before it is shuffled, so one head may fill a volume
    strange = c.filter("sure >= 1").groupBy("volume", "says").agg(F.count(F.lit(1)).alias("n"))
    others = F.coalesce("n", F.lit(0)) - F.when(F.col("sure") >= 1, 1).otherwise(0)
    heads = c.join(strange, ["volume", "says"], "left").withColumn("others", others).filter((F.col("sure") == 2) | (F.col("others") > 0))
    return heads.groupBy(*_KEY).agg(F.collect_list("line").alias("heads"))


def repaired(clauses: DataFrame) -> DataFrame:
    """(clause_key, field_name, item_pos, defects, text) of every scanned item, reflowed."""
    spark = clauses.sparkSession
    scan_items(clauses).write.parquet(path := scratch_path(spark, "scan-items"))
    items = spark.read.parquet(path)
    corpus_statistics(items).write.partitionBy("kind").parquet(path := scratch_path(spark, "scan-statistics"))
    statistics = spark.read.schema("a string, b string, n bigint, n_clean bigint, kind string").parquet(path)
    scanned = items.filter(F.col("volume").isNotNull())
    judged = judged_items(scanned, statistics, stored(word_links(statistics), "scan-links"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for heads, *page in zip(*(c.to_pylist() for c in batch.columns[3:])):
                defects, text = Page(*page).read(set(heads or ()))
                found.append(sorted(defects))
                texts.append(text)
            arrays = [*batch.columns[:3], pa.array(found, pa.list_(pa.string())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["clause_key", "field_name", "item_pos", "defects", "text"])

    heads = head_lines(judged)
    if statistics.filter("kind = 'b'").isEmpty():
        heads = heads.limit(0)
    both = judged.join(heads, _KEY, "left").select(*_KEY, "heads", "text", "own", *FACTS)
    return both.mapInArrow(run, "clause_key bigint, field_name string, item_pos int, defects array<string>, text string")


def scan_defects(clauses: DataFrame) -> DataFrame:
    """(clause_key, field_name, item_pos, defect): one row for each kind of defect of an item."""
    return repaired(clauses).select(*_KEY, F.explode("defects").alias("defect"))

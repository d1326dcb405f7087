"""Free-typed values mapped to the entries of a reference list, or reported as unmatched.

The entries of a kind form a BK-tree under the Levenshtein distance of their letters, which is a
true metric, so the triangle inequality prunes whole subtrees and every entry within the
threshold is returned. The list is split into shards of bounded size; each shard's tree is
broadcast on its own (a small list is one shard), and the winners of the shards are merged. Each
distinct value is looked up once, however often it was typed.

A value is looked up in the readings that typing suggests: as written, without brackets, notes,
list marks and filler words, with its words turned round at a comma or an ``of``, and by its
short name. Short names are strings of the same tree, looked up at distance 0. Words that end in a
full stop match any entry word they begin: the beginnings of entry words form a tree of their own,
and an entry is meant if each of its words is. Every hit has a rank: what the reading leaves out,
the reading's place, abbreviations before edits, the distance (with exchanged neighbours as one
edit), the entry_id. The least rank wins, in a shard as among shards, so their number changes nothing.

Defined results
* null and blank values: no row, but they count for the position;
* values that are a ``name`` of their kind letter for letter: no row;
* labels (values that begin with ``#`` after white space): no row;
* no entry within the threshold, a value without letters, an empty list: entry_id 0;
* entries that share a name or short name: the smallest entry_id;
* values and entries of any length are looked up; a reading that is longer than the longest entry by
  more than the threshold has no entry within it;
* a record delivered twice counts once, as delivered first; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import SPACE, once
from traceloom.session import stored

#: Entries in a shard: the most a broadcast tree holds.
SHARD_ENTRIES = 20_000
#: Most edits, exchanged neighbours as one, at any length.
MOST_EDITS = 3
#: Readings whose hits are kept at a time in one worker (they are looked up again when needed).
READINGS_KEPT = 200_000


def letters(text: str) -> str:
    return "".join(c for c in text if c.isalnum())


def _places(text: str) -> dict[str, int]:
    where: dict[str, int] = {}
    for i, c in enumerate(text):
        where[c] = where.get(c, 0) | 1 << i
    return where


def levenshtein(a: str, b: str, where: dict[str, int] | None = None) -> int:
    """Bit-parallel edit distance (insert, delete, replace); ``where``: the places of a's characters."""
    if not a or not b:
        return len(a) or len(b)
    get = (where or _places(a)).get
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, distance = full, 0, len(a)
    for c in b:
        eq = get(c, 0)
        d0 = (((eq & plus) + plus) ^ plus) | eq | minus
        hp, hn = minus | (full & ~(d0 | plus)), d0 & plus
        if hp & top:
            distance += 1
        elif hn & top:
            distance -= 1
        hp = (hp << 1 | 1) & full
        plus, minus = ((hn << 1) & full) | (full & ~(d0 | hp)), hp & d0
    return distance


def edits(a: str, b: str) -> int:
    """Edits with exchanged neighbours as one; only ranks what the tree has found."""
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return last[-1]


class Node:
    __slots__ = ("text", "where", "letters", "values", "children")

    def __init__(self, text: str, value):
        self.text, self.where, self.letters = text, _places(text), frozenset(text)
        self.values, self.children = [value], {}


class BkTree:
    """Strings under ``levenshtein``; each node's children by their distance to it."""

    def __init__(self):
        self.root: Node | None = None
        self.longest = 0

    def add(self, word: str, value) -> None:
        self.longest = max(self.longest, len(word))
        if self.root is None:
            self.root = Node(word, value)
            return
        node = self.root
        while True:
            d = levenshtein(node.text, word, node.where)
            if d == 0:
                node.values.append(value)
                return
            child = node.children.get(d)
            if child is None:
                node.children[d] = Node(word, value)
                return
            node = child

    def within(self, word: str, most: int) -> list[tuple[int, str, list]]:
        """(distance, string, values) of every string at most ``most`` away."""
        if self.root is None or len(word) - self.longest > most:
            return []
        found, stack, n, own = [], [self.root], len(word), frozenset(word)
        while stack:
            node = stack.pop()
            # a leaf needs no distance where lengths or letters alone exceed the threshold
            if not node.children and (abs(n - len(node.text)) > most or len(own - node.letters) > most or len(node.letters - own) > most):
                continue
            d = levenshtein(node.text, word, node.where)
            if d <= most:
                found.append((d, node.text, node.values))
            if node.children:
                low, high = d - most, d + most
                stack.extend(c for k, c in node.children.items() if low <= k <= high)
        return found


def allowed(length: int) -> int:
    """Edits allowed to a reading of so many letters."""
    return 0 if length < 5 else 1 if length < 7 else 2 if length < 10 else 3 if length < 13 else 4


_BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}")
_LIST_MARK = re.compile(r"^\s*(?:\d+\s*[.)]|[*•\-–—·>]+)\s+")
_CAMEL = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[A-Z])")
_WORD = re.compile(r"[^\W_]+\.?")
_NOTE = re.compile(r"\s+[-–—:]\s+.*$")
_SHORT = re.compile(r"^\W*((?:[^\W\d_]\.?){2,8})(?:$|\W+$|\s*[(\[{,;:*–—-]|\s+rev\b)", re.I)


def readings(value: str) -> list[tuple[int, list[str]]]:
    """(cost, words) of what a typed value may say; words keep a full stop at their end."""
    text = unicodedata.normalize("NFKC", value).strip()
    text = _LIST_MARK.sub("", text)
    bare = _BRACKETS.sub(" ", text)
    inner = " ".join(m.strip("()[]{}") for m in _BRACKETS.findall(text))
    out: list[tuple[int, list[str]]] = []

    def add(cost: int, t: str) -> None:
        words = [w.lower() for w in _WORD.findall(_CAMEL.sub(" ", t) if not t.isupper() else t)]
        if words and all(words != w for _, w in out):
            out.append((cost, words))

    add(0, text)
    add(1, bare)
    add(1, _NOTE.sub("", bare))
    if "," in bare:
        head, _, tail = bare.rpartition(",")
        add(1, f"{tail} {head}")
        add(2, bare.partition(",")[0])
    for _, words in list(out):
        if "of" in words[1:-1]:
            at = words.index("of", 1)
            add(1, " ".join(words[at + 1 :] + words[:at]))
    add(2, inner)
    for cost, words in list(out):
        for first, last in ((1, 0), (0, 1), (1, 1), (0, 2), (2, 0)):
            if len(words) - first - last >= 2:
                add(cost + 2 + first + last, " ".join(words[first : len(words) - last]))
    return out


#: Rank of a hit: (what its reading leaves out, the reading's place, 0 for abbreviations and 1 for
#: edits, edits, entry_id); the last is 0 where there is none.
NONE = (1 << 20, 0, 0, 0, 0)


class Matcher:
    """The entries of one kind: rows (entry_id, name, short_name)."""

    def __init__(self, entries: list[tuple[int, str, str | None]]):
        self.tree, self.heads = BkTree(), BkTree()
        self.at: dict[tuple[int, int, str], set[int]] = {}
        self.kept: dict[tuple[str, int], tuple[int, int] | None] = {}
        vocabulary = set()
        for entry_id, name, short in sorted(entries, key=lambda e: (e[0], e[1], e[2] or "")):
            words = [w.lower().rstrip(".") for w in _WORD.findall(unicodedata.normalize("NFKC", name))]
            self.tree.add(letters("".join(words)), (entry_id, False))
            for i, w in enumerate(words):
                self.at.setdefault((len(words), i, w), set()).add(entry_id)
                vocabulary.add(w)
            if short and letters(short):
                self.tree.add(letters(short).lower(), (entry_id, True))
        for w in sorted(vocabulary):
            for n in range(2, len(w) + 1):
                self.heads.add(w[:n], w)

    def abbreviated(self, words: list[str]) -> int | None:
        """The smallest entry whose words, one by one, are or begin with these."""
        meant: set[int] | None = None
        for i, w in enumerate(words):
            whole = [w] if not w.endswith(".") else [x for _, _, values in self.heads.within(w[:-1], 0) for x in values] if len(w) > 2 else []
            here = set().union(*(self.at.get((len(words), i, x), ()) for x in whole))
            meant = here if meant is None else meant & here
            if not meant:
                return None
        return min(meant) if meant else None

    def nearest(self, word: str, most: int) -> tuple[int, int] | None:
        """(edits, entry_id) of the best entry by name within the threshold."""
        key = word, most
        if key in self.kept:
            return self.kept[key]
        best = None
        for limit in dict.fromkeys((0, most)):  # most values are exact in some reading
            for _, name, values in self.tree.within(word, limit):
                ids = [i for i, short in values if not short]
                if ids and (n := edits(word, name) if limit else 0) <= MOST_EDITS:
                    best = min(best or (n, ids[0]), (n, min(ids)))
            if best:
                break
        if len(self.kept) >= READINGS_KEPT:
            self.kept.clear()
        self.kept[key] = best
        return best

    def match(self, value: str) -> tuple[int, int, int, int, int]:
        """The least rank of a hit."""
        m = _SHORT.match(_LIST_MARK.sub("", unicodedata.normalize("NFKC", value)))
        if m:
            ids = [i for _, _, values in self.tree.within(letters(m[1]).lower(), 0) for i, short in values if short]
            if ids:
                return -1, 0, 0, 0, min(ids)
        best = NONE
        for place, (cost, words) in enumerate(readings(value)):
            if cost >= best[0]:
                continue
            if any(w.endswith(".") for w in words[:-1]) and (entry := self.abbreviated(words)):
                best = cost, place, 0, 0, entry
                continue
            word = letters("".join(words))
            if not word:
                continue
            # a reading that leaves words out must be all but exact
            hit = self.nearest(word, allowed(len(word)) if cost < 3 else min(1, allowed(len(word))))
            if hit:
                best = min(best, (cost, place, 1, *hit))
        return best


def map_values(values: DataFrame, catalog: DataFrame) -> DataFrame:
    """(kind, value, entry_id) of distinct (kind, value); entry_id 0 where no entry is meant."""
    spark = values.sparkSession
    entries = catalog.filter("entry_id is not null and name is not null").select("entry_id", "kind", "name", "short_name")
    shards = max(1, -(-entries.count() // SHARD_ENTRIES))
    # looking up is costly for the few bytes of a value: keep all partitions, which adaptive
    # execution would join by their size
    values = values.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "value")
    if shards > 1:
        values = stored(values, "typed-values")
    spread = entries.withColumn("shard", F.pmod(F.xxhash64("entry_id"), F.lit(shards)))
    rank = ["cost", "place", "stage", "edits", "entry_id"]

    def looked_up(k: int) -> tuple[DataFrame, Broadcast]:
        rows: dict[str, list] = {}
        for r in spread.filter(F.col("shard") == k).collect():  # at most about SHARD_ENTRIES rows
            rows.setdefault(r.kind, []).append((r.entry_id, r.name, r.short_name))
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matchers = {kind: Matcher(e) for kind, e in shared.value.items()}
            none = Matcher([])
            for batch in batches:
                kinds, typed = batch.column(0), batch.column(1)
                hits = [matchers.get(a, none).match(b) for a, b in zip(kinds.to_pylist(), typed.to_pylist())]
                columns = list(zip(*hits)) if hits else [()] * 5
                yield pa.RecordBatch.from_arrays([kinds, typed, *(pa.array(c, pa.int64()) for c in columns)], names=["kind", "value", *rank])

        return values.mapInArrow(run, "kind string, value string, " + ", ".join(f"{c} bigint" for c in rank)), shared

    if shards == 1:
        return looked_up(0)[0].select("kind", "value", "entry_id")
    found = None
    for k in range(shards):  # one shard in memory at a time: its winners are written before the next is sent
        one, shared = looked_up(k)
        winners = stored(one.filter("entry_id <> 0"), "shard-winners")
        shared.unpersist()
        found = winners if found is None else found.unionAll(winners)
    best = found.groupBy("kind", "value").agg(F.min(F.struct(*rank)).alias("m")).select("kind", "value", "m.entry_id")
    return values.join(best, ["kind", "value"], "left").select("kind", "value", F.coalesce("entry_id", F.lit(0)).alias("entry_id"))


def typed_values(products: DataFrame) -> DataFrame:
    """(wp_key, field_name, kind, pos, value) of the non-blank typed values, labels left out."""
    p = once(products, "wp_key", "methods_used", "tags_addressed")
    both = None
    for name, kind in (("methods_used", "method"), ("tags_addressed", "tag")):
        x = p.select("wp_key", F.posexplode(name).alias("p", "value")).select("wp_key", F.lit(name).alias("field_name"), F.lit(kind).alias("kind"), (F.col("p") + 1).alias("pos"), "value")
        both = x if both is None else both.unionAll(x)
    bare = F.trim(F.regexp_replace("value", SPACE, " "))
    return both.filter((bare != "") & ~((F.col("kind") == "tag") & bare.startswith("#")))


def mapped_values(products: DataFrame, catalog: DataFrame) -> DataFrame:
    """(wp_key, field_name, pos, entry_id) of typed values that aren't exactly a name of their kind."""
    names = catalog.filter("name is not null").select("kind", F.col("name").alias("value")).distinct()
    odd = typed_values(products).join(names, ["kind", "value"], "left_anti")
    found = map_values(odd.select("kind", "value").distinct(), catalog)
    return odd.join(found, ["kind", "value"]).select("wp_key", "field_name", F.col("pos").cast("int").alias("pos"), "entry_id")


def unmatched_report(products: DataFrame, catalog: DataFrame) -> DataFrame:
    """Typed values without an entry: (field_name, value, n_uses, n_records)."""
    names = catalog.filter("name is not null").select("kind", F.col("name").alias("value")).distinct()
    odd = typed_values(products).join(names, ["kind", "value"], "left_anti")
    uses = odd.groupBy("field_name", "kind", "value").agg(F.count(F.lit(1)).alias("n_uses"), F.countDistinct("wp_key").alias("n_records"))
    none = map_values(uses.select("kind", "value"), catalog).filter("entry_id = 0")
    return uses.join(none, ["kind", "value"], "left_semi").select("field_name", "value", "n_uses", "n_records")

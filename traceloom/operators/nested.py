"""Deeply nested records to flat, linked tables by single-pass tagged emission.

A depth-first visitor walks each payload once and emits rows (tag, primary key, parent key,
position, value, payload). ``write_tables`` stores them partitioned by tag, ``apply_schemas``
gives each tag its own typed table, and ``stored_tables`` does all three.

Defined results
* null, empty, blank and cut-off payloads: no rows;
* a payload inside a JSON string (also several times), behind a byte order mark, inside
  envelopes, packages or lists: as if it lay there bare;
* repeated members of one object are all visited, in payload order;
* values that are null or blank (also of no-break spaces): no row, and they take no position;
* lists inside lists are flattened, one bare value counts as a list of one;
* numbers come out as written (1.10, 1e5, any length), booleans as JSON writes them;
* member names count by their folded form, in payloads too: the columns of a spec get their values
  however a file spells them, all other members of an entity come out in the map ``others``
  (of several members of one folded name the first one's value);
* half a surrogate pair comes out as U+FFFD;
* objects nested deeper than the interpreter's stack are parsed by an explicit stack;
* extra columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMIT_SCHEMA = "file_id bigint, tag string, pk int, parent_pk int, pos int, value string, payload string"
_ARROW = pa.schema([("file_id", pa.int64()), ("tag", pa.string()), ("pk", pa.int32()), ("parent_pk", pa.int32()), ("pos", pa.int32()), ("value", pa.string()), ("payload", pa.string())])


@dataclass(frozen=True)
class NestedSpec:
    """What to emit. Names are compared without case and without ``_``, ``-`` and blanks."""

    entity_tag: str = "product"
    containers: tuple[str, ...] = ("work_products", "sub_products")
    id_field: str = "id"
    #: field -> tag; a dotted field means the named members of the objects anywhere below it.
    values: dict[str, str] = field(default_factory=lambda: {"tags_addressed": "tag", "methods_used": "method", "traceability_links.from": "link_from"})
    #: member that stands for an object among plain values
    name_field: str = "name"
    #: typed columns of the entities' table, by member name; other members are kept in a map
    columns: tuple[str, ...] = ("id", "title", "mapped_part", "status", "content")


class Pairs(list):
    """An object as its (name, value) pairs in payload order."""


class Number(str):
    """A number as the payload writes it."""


def _key(name: str) -> str:
    return re.sub(r"[\s_\-]+", "", name).lower()


_DECODER = json.JSONDecoder(object_pairs_hook=Pairs, parse_float=Number, parse_int=Number, parse_constant=Number, strict=False)
_STRUCT = re.compile(r'[\s]*(?:([{}\[\],:])|("(?:[^"\\]|\\.)*")|([^\s{}\[\],:"]+))', re.S)


def _parse_deep(text: str, at: int = 0) -> tuple[object, int]:
    """(value, end) of the JSON that begins at a place, by an explicit stack: for nesting that would
    exhaust the call stack."""
    stack: list = []
    names: list = []
    end = at
    for m in iter(lambda: _STRUCT.match(text, end), None):
        end = m.end()
        mark, string, word = m.groups()
        if mark in ("{", "["):
            stack.append(Pairs() if mark == "{" else [])
            names.append(None)
            continue
        if mark in ("}", "]"):
            if not stack or isinstance(stack[-1], Pairs) != (mark == "}"):
                raise ValueError("unbalanced")
            value = stack.pop()
            names.pop()
        elif mark:
            continue
        else:
            value = _DECODER.decode(string if string is not None else word)
            if stack and isinstance(stack[-1], Pairs) and names[-1] is None and string is not None:
                names[-1] = value
                continue
        if not stack:
            return value, end
        if isinstance(stack[-1], Pairs):
            stack[-1].append((names[-1], value))
            names[-1] = None
        else:
            stack[-1].append(value)
    raise ValueError("cut off")


def _decode(text: str):
    try:
        return _DECODER.decode(text)
    except RecursionError:
        value, end = _parse_deep(text)
        if text[end:].strip():
            raise ValueError("text after the end") from None
        return value


def _decode_at(text: str, at: int) -> tuple[object, int]:
    try:
        return _DECODER.raw_decode(text, at)
    except RecursionError:
        return _parse_deep(text, at)


def parse_payload(text: str | None):
    """The value in a payload, unwrapped from strings; None if there is none or it is cut off. Each
    wrapper taken off makes the text shorter, so any number of them may be there."""
    while text is not None:
        text = text.strip().lstrip("\ufeff\x00").rstrip("\x00").strip()
        if not text:
            return None
        try:
            value = _decode(text)
        except ValueError:
            # a wrapper that isn't JSON (a fence, a call): the first whole object or list counts
            start = re.search(r"[{\[]", text)
            if not start:
                return None
            try:
                value, end = _decode_at(text, start.start())
            except ValueError:
                return None
            if re.search(r'[{}\[\]"]', text[end:]):
                return None
        if not isinstance(value, str) or isinstance(value, Number):
            return value
        text = value
    return None


def _dump(value) -> str:
    """JSON of a parsed value, numbers as written; by an explicit stack."""
    out: list[str] = []
    stack: list = [("value", value)]
    while stack:
        kind, node = stack.pop()
        if kind == "raw":
            out.append(node)
        elif isinstance(node, Number):
            out.append(node)
        elif isinstance(node, Pairs):
            stack.append(("raw", "}"))
            for i in range(len(node) - 1, -1, -1):
                k, v = node[i]
                stack += [("value", v), ("raw", (", " if i else "") + json.dumps(k, ensure_ascii=False) + ": ")]
            stack.append(("raw", "{"))
        elif isinstance(node, list):
            stack.append(("raw", "]"))
            for i in range(len(node) - 1, -1, -1):
                stack += [("value", node[i]), ("raw", ", " if i else "")]
            stack.append(("raw", "["))
        else:
            out.append(json.dumps(node, ensure_ascii=False))
    return "".join(out)


def _text(value) -> str | None:
    if value is None:
        return None
    text = str(value) if isinstance(value, str) else _dump(value)
    try:
        text.encode()
    except UnicodeEncodeError:  # half a surrogate pair
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


class Visitor:
    """One walk over one payload; ``rows`` gets (tag, pk, parent_pk, pos, value, payload)."""

    def __init__(self, spec: NestedSpec):
        self.spec = spec
        self.containers = {_key(c) for c in spec.containers}
        self.id_key, self.name_key = _key(spec.id_field), _key(spec.name_field)
        self.plain = {_key(f): t for f, t in spec.values.items() if "." not in f}
        self.members: dict[str, dict[str, str]] = {}
        for f, t in spec.values.items():
            if "." in f:
                outer, inner = f.split(".", 1)
                self.members.setdefault(_key(outer), {})[_key(inner)] = t

    def visit(self, root) -> list[tuple]:
        rows: list[tuple] = []
        count = 0
        position: dict[tuple[int, str], int] = {}

        def emit(tag: str, pk: int, parent: int, value, payload: str | None = None) -> None:
            text = _text(value)
            if text is None or not text.strip():
                return
            position[pk, tag] = pos = position.get((pk, tag), 0) + 1
            rows.append((tag, pk, parent, pos, text, payload))

        # frames: (node, role, enclosing pk, its parent, extra); taken depth first, in payload order
        stack: list[tuple] = [(root, "any", 0, 0, None)]
        while stack:
            node, role, pk, parent, extra = stack.pop()
            if role == "value":  # extra: tag
                if isinstance(node, Pairs):
                    stack.extend((v, "value", pk, parent, extra) for k, v in reversed(node) if _key(k) == self.name_key)
                elif isinstance(node, list):
                    stack.extend((v, "value", pk, parent, extra) for v in reversed(node))
                else:
                    emit(extra, pk, parent, node)
                continue
            if role == "member":  # extra: wanted members -> tag
                if isinstance(node, Pairs):
                    for k, v in reversed(node):
                        key = _key(k)
                        if key in extra:
                            stack.append((v, "value", pk, parent, extra[key]))
                        elif isinstance(v, list):
                            stack.append((v, "member", pk, parent, extra))
                elif isinstance(node, list):
                    stack.extend((v, "member", pk, parent, extra) for v in reversed(node))
                continue
            if isinstance(node, str) and role in ("any", "entities") and node.lstrip()[:1] in ("{", "[", '"', "\ufeff") and not pk:
                node = parse_payload(node)  # an envelope whose body is again a string
            if isinstance(node, Pairs):
                if role == "entities":
                    count += 1
                    pk, parent = count, pk
                    ident = next((v for k, v in node if _key(k) == self.id_key), None)
                    members: dict[str, str | None] = {}
                    for k, v in node:
                        key = _key(k)
                        if key not in self.containers and key not in self.plain and key not in self.members:
                            members.setdefault(_text(key), _text(v))
                    rows.append((self.spec.entity_tag, pk, parent, 0, _text(ident), json.dumps(members, ensure_ascii=False)))
                for k, v in reversed(node):
                    key = _key(k)
                    if key in self.containers:
                        stack.append((v, "entities", pk, parent, None))
                    elif pk and key in self.plain:
                        stack.append((v, "value", pk, parent, self.plain[key]))
                    elif pk and key in self.members:
                        stack.append((v, "member", pk, parent, self.members[key]))
                    elif isinstance(v, list) or (isinstance(v, str) and not pk):
                        stack.append((v, "any", pk, parent, None))
            elif isinstance(node, list):
                stack.extend((v, role, pk, parent, None) for v in reversed(node))
        return rows


def emit_tagged(files: DataFrame, spec: NestedSpec | None = None, key: str = "file_id", payload: str = "payload") -> DataFrame:
    """Rows of EMIT_SCHEMA for each file. One narrow pass: no shuffle, no schema inference."""
    spec = spec or NestedSpec()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor = Visitor(spec)
        for batch in batches:
            columns: list[list] = [[] for _ in _ARROW]
            for file_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                root = parse_payload(text)
                if root is None:
                    continue
                for row in visitor.visit(root):
                    for column, value in zip(columns, (file_id, *row)):
                        column.append(value)
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(columns, _ARROW)], schema=_ARROW)

    return files.select(F.col(key).cast("bigint").alias("file_id"), F.col(payload).alias("payload")).mapInArrow(run, EMIT_SCHEMA)


def write_tables(emitted: DataFrame, path: str) -> None:
    """The emitted rows, one partition folder for each tag."""
    emitted.write.mode("overwrite").partitionBy("tag").parquet(path)


def apply_schemas(emitted: DataFrame, spec: NestedSpec | None = None) -> dict[str, DataFrame]:
    """One typed table for each tag: entities with the columns of the spec and a map of their other
    members, values with their links."""
    spec = spec or NestedSpec()
    link = [F.col("file_id"), F.col("pk").alias("wp_no"), F.col("parent_pk").alias("parent_no")]
    members = F.from_json("payload", "map<string,string>", {"maxStringLen": str((1 << 31) - 1)}).alias("m")
    named = [_key(c) for c in spec.columns]
    others = F.map_filter("m", lambda k, v: ~k.isin(*named)).alias("others")
    entities = emitted.filter(F.col("tag") == spec.entity_tag).select(*link, members).select("file_id", "wp_no", "parent_no", *[F.try_element_at("m", F.lit(_key(c))).alias(c) for c in spec.columns], others)
    tables = {spec.entity_tag: entities}
    for tag in spec.values.values():
        tables[tag] = emitted.filter(F.col("tag") == tag).select(*link, "pos", F.col("value").alias("item_value"))
    return tables


def stored_tables(files: DataFrame, path: str, spec: NestedSpec | None = None) -> dict[str, DataFrame]:
    """The files emitted once, written by tag under ``path``, and read back as typed tables."""
    write_tables(emit_tagged(files, spec), path)
    columns = EMIT_SCHEMA.replace("tag string, ", "") + ", tag string"
    return apply_schemas(files.sparkSession.read.schema(columns).parquet(path), spec)


def nested_rows(tables: dict[str, DataFrame], spec: NestedSpec | None = None) -> DataFrame:
    """All typed tables in one: file_id, wp_no, parent_no, kind, pos, item_value."""
    spec = spec or NestedSpec()
    out = None
    for tag, t in tables.items():
        x = t.withColumns({"pos": F.lit(0), "item_value": F.col(spec.id_field)}) if tag == spec.entity_tag else t
        one = x.select("file_id", "wp_no", "parent_no", F.lit(tag).alias("kind"), "pos", "item_value")
        out = one if out is None else out.unionAll(one)
    return out

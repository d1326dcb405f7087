"""Field roles of unknown JSON documents: objects flattened, keys counted, roles matched.

The values of a document are walked once in Arrow batches to (path, key, kind, value) leaves and
object keys; counting and matching are plain aggregations, so the driver only sees the handful
of chosen names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions import vocabulary as V


def walk(docs: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, ord, path, name, kind, value) of every member of every object, depth first. Payloads
    that are no JSON give no rows."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    root = json.loads(text) if text else None
                except (ValueError, RecursionError):
                    continue
                n, stack = 0, [("$", "", root)]
                while stack:
                    path, name, node = stack.pop()
                    kind = "object" if isinstance(node, dict) else "list" if isinstance(node, list) else "null" if node is None else "text" if isinstance(node, str) else "other"
                    if name or kind not in ("object", "list"):
                        for column, value in zip(out, (k, n, path, name, kind, node if kind == "text" else None if kind in ("object", "list", "null") else json.dumps(node))):
                            column.append(value)
                        n += 1
                    if isinstance(node, dict):
                        stack.extend((f"{path}.{x}", x, v) for x, v in reversed(node.items()))
                    elif isinstance(node, list):
                        stack.extend((f"{path}[]", name if not isinstance(v, dict) else "", v) for v in reversed(node))
            types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=[key, "ord", "path", "name", "kind", "value"])

    return docs.select(key, payload).mapInArrow(run, f"{key} {kind}, ord int, path string, name string, kind string, value string")


def key_frequency(members: DataFrame, key: str, least: int = 2) -> DataFrame:
    """(name, n, first_key, first_ord): names of object members that occur at least twice."""
    named = members.filter((F.col("name") != "") & ~F.col("path").endswith("[]"))
    g = named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(key, "ord")).alias("at"))
    return g.filter(F.col("n") >= least).select("name", "n", F.col("at")[key].alias("first_key"), F.col("at.ord").alias("first_ord"))


def field_roles(names: DataFrame, roles: Mapping[str, Sequence[str]] = V.FIELD_ROLES) -> DataFrame:
    """(role, name): for each role the first name, by where it is first met, that it goes by."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.array(*[F.lit(n) for n in ns]).alias("known")) for r, ns in roles.items()]))
    x = names.select("name", "first_key", "first_ord", pairs.alias("r")).filter(F.array_contains("r.known", F.lower("name")))
    return x.groupBy(F.col("r.role").alias("role")).agg(F.min_by("name", F.struct("first_key", "first_ord")).alias("name"))


def leaf_text(members: DataFrame, key: str) -> DataFrame:
    """(key, text): all texts of a document in order, one on each line."""
    leaves = members.filter("kind = 'text'").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("v"))
    return leaves.select(key, F.array_join("v.value", "\n").alias("text"))

"""Deeply nested JSON records as related flat tables (shared inlining).

1. Texts become VARIANT values; a byte-order mark and JSON inside a JSON string
   are read through, unreadable texts become null.
2. The schema graph is analysed over all records: every path with the kinds of
   value found there. Objects whose keys are all numbers are maps.
3. Shared inlining decides the tables: scalars and singleton objects, and their
   singleton descendants, become columns of the nearest table; repeated
   elements (lists and maps of objects) become tables; an element name that is
   reached from several parents, or from itself, becomes one shared table.
   Lists of plain values stay in their column as JSON text.
4. Each table row has its record's key, its own ``node_id``, the ``parent_id``
   and ``parent`` table that it hangs from, its ``pos`` in the list (or ``key``
   in the map) and its columns. Node ids are paths, so no join builds them.

Defined results: null, blank and unreadable texts have no rows; a bare list is
read as the value of ``list_field``; a single object where others have a list
is a list of one; whether a value is a list, a map or a single object is seen
in each record; recursive elements give rows at every depth; null entries keep their position and have null columns;
columns that miss in a record are null; extra columns of the input are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.session import checkpointed

#: More paths than this aren't a schema but data in the place of names.
MOST_PATHS = 20_000
_LAYERS = 3


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it.

    Without it each mention repeats the expression when projections are merged.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def read_variant(text: Column) -> Column:
    """The JSON object or list of a text as VARIANT, else null; strings that hold JSON are read as that JSON."""
    clean = lambda c: F.regexp_replace(c, "^[\\uFEFF\\s]+", "")
    layer = clean(text)
    for _ in range(_LAYERS):
        layer = bound(layer, lambda t: F.when(t.startswith('"'), clean(F.try_variant_get(F.try_parse_json(t), "$", "string"))).otherwise(t))
    return bound(layer, lambda t: F.when(t.rlike("^[{\\[]"), F.try_parse_json(t)))


def latest(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Per key the ``value`` of the row with the latest ``order``; equal rows count once, ties go to the larger value.

    A plain aggregate, so each task combines its rows before the shuffle.
    """
    newest = F.max(F.struct(F.col(order), F.col(value))).alias("newest")
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key)).agg(newest).select(key, F.col(f"newest.{value}").alias(value))


def _walk(value, path: str, seen: dict, maps: tuple[str, ...]) -> None:
    if isinstance(value, dict):
        if path.rpartition("/")[2] in maps or (value and all(k.isdigit() for k in value)):
            seen[path, "map"] = seen.get((path, "map"), 0) + 1
            for v in value.values():
                _walk(v, path + "/*", seen, maps)
            return
        seen[path, "object"] = seen.get((path, "object"), 0) + 1
        for k, v in value.items():
            _walk(v, f"{path}/{k}", seen, maps)
    elif isinstance(value, list):
        seen[path, "list"] = seen.get((path, "list"), 0) + 1
        for v in value:
            _walk(v, path + "/*", seen, maps)
    elif value is not None:
        kind = "number" if isinstance(value, (int, float)) and not isinstance(value, bool) else "boolean" if isinstance(value, bool) else "text"
        seen[path, kind] = seen.get((path, kind), 0) + 1


def schema_paths(roots: DataFrame, value: str = "value", maps: tuple[str, ...] = ()) -> DataFrame:
    """Paths and kinds of value over all records, with counts: (path, kind, n). Each batch sends on only its own counts."""

    def run(batches):
        for batch in batches:
            seen: dict = {}
            for text in batch.column(0).to_pylist():
                if text is not None:
                    _walk(json.loads(text), "", seen, maps)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in seen], pa.string()), pa.array([k for _, k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["path", "kind", "n"]
            )

    counted = roots.select(F.to_json(value).alias("text")).mapInArrow(run, "path string, kind string, n bigint")
    return counted.groupBy("path", "kind").agg(F.sum("n").alias("n"))


@dataclass
class Edge:
    """A repeated element below a table: where it is, whether it may be a map, and at which depths of nesting it was found."""

    table: str
    parent: str
    steps: tuple[str, ...]
    is_map: bool
    depths: set[int] = field(default_factory=set)


@dataclass
class Plan:
    """Tables of shared inlining: their columns (steps -> kind) and the edges between them."""

    columns: dict[str, dict[tuple[str, ...], str]] = field(default_factory=dict)
    edges: list[Edge] = field(default_factory=list)


def inline(paths: dict[tuple[str, str], int], root: str = "document", lists: tuple[str, ...] = ()) -> Plan:
    """Decide the tables from the schema graph's (path, kind) counts; elements named in ``lists`` are tables even if each stands alone."""
    kinds: dict[str, set[str]] = {}
    for path, kind in paths:
        kinds.setdefault(path, set()).add(kind)
    below: dict[str, list[str]] = {}
    for path in kinds:
        if path:
            below.setdefault(path.rpartition("/")[0], []).append(path)
    plan = Plan({root: {}})

    def repeated(path: str) -> bool:
        many = kinds[path] & {"list", "map"} or path.rpartition("/")[2] in lists
        return bool(many) and ("object" in kinds.get(path + "/*", set()) or "object" in kinds[path])

    known: dict[tuple, Edge] = {}

    def descend(path: str, table: str, steps: tuple[str, ...], depth: int) -> None:
        for child in sorted(below.get(path, [])):
            name = child.rpartition("/")[2]
            if name == "*":
                continue
            here = (*steps, name)
            if repeated(child):
                target = name
                edge = known.get((target, table, here))
                if edge is None:
                    edge = known[target, table, here] = Edge(target, table, here, False)
                    plan.edges.append(edge)
                    plan.columns.setdefault(target, {})
                edge.is_map |= "map" in kinds[child]
                edge.depths.add(depth)
                descend(child + "/*", target, (), depth + 1)
                descend(child, target, (), depth + 1)  # single objects outside a list
            elif "object" in kinds[child]:
                descend(child, table, here, depth)
            else:
                found = kinds[child] & {"number", "boolean", "text"} if "list" not in kinds[child] else {"text"}
                before = plan.columns[table].get(here)
                plan.columns[table][here] = found.pop() if len(found) == 1 and before in (None, *found) else "text"

    descend("", root, (), 0)
    return plan


def _json_path(steps: tuple[str, ...]) -> str:
    return "$" + "".join("['" + s.replace("\\", "\\\\").replace("'", "\\'") + "']" for s in steps)


_SPARK_KIND = {"number": "double", "boolean": "boolean", "text": "string"}


def _child(parent: DataFrame, edge: Edge, key: str, maps: tuple[str, ...] = ()) -> DataFrame:
    """The rows of an edge; each record's value is read as the list, the map or the single object that it is."""
    path = _json_path(edge.steps)
    here = F.concat_ws("/", F.col("node_id"), F.lit(".".join(edge.steps)))
    at = [F.col(key), F.lit(edge.parent).alias("parent"), F.col("node_id").alias("parent_id")]
    none = F.lit(None).cast("string")
    one = F.try_variant_get("value", path, "variant")
    kind = F.schema_of_variant(one)
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    many = F.when(kind.startswith("ARRAY"), F.transform(F.try_variant_get("value", path, "array<variant>"), lambda v: entry(none, v)))
    rows = F.coalesce(many, F.when(kind.startswith("OBJECT"), F.array(entry(none, one))))
    if edge.is_map:
        fields = F.try_variant_get("value", path, "map<string,variant>")
        numbers = (F.size(fields) > 0) & F.forall(F.map_keys(fields), lambda k: k.rlike(r"^\p{Nd}+$"))
        entries = F.when(kind.startswith("OBJECT") & (F.lit(edge.steps[-1] in maps) | numbers), F.transform(F.map_entries(fields), lambda e: entry(e["key"], e["value"])))
        rows = F.coalesce(entries, rows)
    found = parent.select(*at, here.alias("here"), F.posexplode(rows).alias("pos", "entry"))
    return found.select(key, "parent", "parent_id", F.concat_ws("/", "here", F.coalesce("entry.key", F.col("pos").cast("string"))).alias("node_id"), "pos", F.col("entry.key").alias("key"), F.col("entry.value").alias("value"))


def shred(
    df: DataFrame, key: str, text: str, list_field: str = "results", root: str = "document", plan: Plan | None = None, lists: tuple[str, ...] = (), maps: tuple[str, ...] = ()
) -> dict[str, DataFrame]:
    """The flat tables of the JSON texts of ``df`` by name; ``root`` has one row per readable record.

    Every table has (key, parent, parent_id, node_id, pos, key_, value columns);
    a column's name is the dotted path below its table. Without a ``plan`` the
    schema graph is analysed first, which is one more pass over the texts.
    ``lists`` and ``maps`` name elements that are repeated by their meaning, so
    that data in which each happens to stand alone gives the same tables.
    """
    texts = df.select(F.col(key).cast("string").alias("record"), F.col(text).alias("__json"))
    bare = F.col("__json").rlike("^[\\uFEFF\\s]*\\[")
    wrapped = F.concat(F.lit('{"' + list_field + '":'), F.regexp_replace("__json", "^[\\uFEFF\\s]+", ""), F.lit("}"))
    direct = texts.filter(F.col("__json").isNotNull())
    roots = direct.select("record", read_variant(F.when(bare, wrapped).otherwise(F.col("__json"))).alias("value"))
    quoted = lambda v: F.try_parse_json(F.concat(F.lit('{"' + list_field + '":'), F.to_json(v), F.lit("}")))
    inside = bound(F.col("value"), lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), quoted(v)).otherwise(v))  # a bare list inside a string
    roots = checkpointed(roots.select("record", inside.alias("value"))).filter(F.col("value").isNotNull())
    if plan is None:
        found = schema_paths(roots, maps=maps).limit(MOST_PATHS + 1).collect()
        if len(found) > MOST_PATHS:
            raise ValueError(f"more than {MOST_PATHS} different paths: the records have data in the place of names")
        plan = inline({(r.path, r.kind): r.n for r in found}, root, lists)
    none = F.lit(None).cast("string")
    start = roots.select("record", none.alias("parent"), none.alias("parent_id"), F.col("record").alias("node_id"), F.lit(0).alias("pos"), none.alias("key"), "value")
    nodes: dict[str, DataFrame] = {root: start}
    newest, depth = {root: start}, 0
    while newest:  # one level of nesting after the other, as deep as the schema graph goes
        level: dict[str, DataFrame] = {}
        for edge in plan.edges:
            if edge.parent in newest and depth in edge.depths:
                rows = _child(newest[edge.parent], edge, "record", maps)
                level[edge.table] = level[edge.table].unionByName(rows) if edge.table in level else rows
        for name, rows in level.items():
            nodes[name] = nodes[name].unionByName(rows) if name in nodes else rows
        newest, depth = level, depth + 1
    tables = {}
    for name, rows in nodes.items():
        columns = [F.try_variant_get("value", _json_path(steps), _SPARK_KIND[kind]).alias(".".join(steps)) for steps, kind in sorted(plan.columns[name].items())]
        tables[name] = rows.select("record", "parent", "parent_id", "node_id", "pos", F.col("key").alias("key_"), *columns)
    return tables

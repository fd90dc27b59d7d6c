"""Adjacency-table shredding of nested JSON into flat, linked tables (problem 2).

Every JSON value becomes a node (node, parent, label, ordinal, kind, scalar). Nodes of one record never
leave the task that read the record, so object nodes are joined with their scalar children, and these
pivoted into the columns of the entity tables, inside the batch: the shredding needs no shuffle.
``adjacency`` gives the node table itself, ``entities`` pivots any node table with DataFrame operations.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The members that may hold a tool's schema, in order of preference.
SCHEMA_MEMBERS = ("inputSchema", "input_schema", "parameters")
#: JSON text inside JSON is opened this many times at most; real data is encoded twice.
OPENED = 8


def parsed(raw: object) -> object:
    """The value of a JSON text, opened again while it is text that holds an object or array; else None."""
    for _ in range(OPENED):
        if not isinstance(raw, str):
            return raw
        head = raw.lstrip()[:1]
        if head not in ("{", "[", '"'):
            return None
        try:
            raw = json.loads(raw)
        except (ValueError, RecursionError):
            return None
    return None


def kind_of(x: object) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "boolean"
    if isinstance(x, str):
        return "string"
    if isinstance(x, (int, float)):
        return "number"
    return "array" if isinstance(x, list) else "object"


def scalar_text(x: object) -> str | None:
    return None if x is None else x if isinstance(x, str) else json.dumps(x)


def walk(value: object) -> Iterator[tuple[int, int, str, int, str, str | None]]:
    """(node, parent, label, ordinal, kind, scalar) of a value and all below it, in reading order; the top has parent -1."""
    todo = [(value, -1, "", 0)]
    node = 0
    while todo:
        x, parent, label, ordinal = todo.pop()
        kind = kind_of(x)
        yield node, parent, label, ordinal, kind, None if kind in ("array", "object") else scalar_text(x)
        if kind == "object":
            todo.extend(reversed([(v, node, k, i) for i, (k, v) in enumerate(x.items())]))
        elif kind == "array":
            todo.extend(reversed([(v, node, "", i) for i, v in enumerate(x)]))
        node += 1


def adjacency(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, node, parent, label, ordinal, kind, scalar): one row per JSON value of a record.

    Null, blank and unreadable texts have no node. JSON text inside JSON at the top is opened.
    """

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                value = parsed(raw)
                if value is not None:
                    got = list(walk(value))
                    rows.extend(got)
                    at.extend([i] * len(got))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())
            keys = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[key, "node", "parent", "label", "ordinal", "kind", "scalar"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, node int, parent int, label string, ordinal int, kind string, scalar string")


def entities(nodes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, node, parent, label, one column per name in ``columns``): the object nodes of a node table,
    their scalar children joined and pivoted; of members with one name the last counts."""
    objects = F.col("kind") == "object"
    child = ~F.col("kind").isin("object", "array") & F.col("label").isin(columns)
    owner = F.when(child, F.col("parent")).when(objects, F.col("node"))
    rows = nodes.where(objects | child).withColumn("_owner", owner)
    pivot = [F.max_by("scalar", F.when(child & (F.col("label") == c), F.col("ordinal"))).alias(c) for c in columns]
    head = [F.max(F.when(objects & (F.col("node") == F.col("_owner")), F.col(c))).alias(c) for c in ("node", "parent", "label")]
    names = [c.alias(f"_{i}") for i, c in enumerate(pivot)]
    grouped = rows.groupBy(key, "_owner").agg(*head, *names).where("node IS NOT NULL")
    return grouped.select(key, "node", "parent", "label", *[F.col(f"_{i}").alias(c) for i, c in enumerate(columns)])


class Nodes:
    """The node table of one record: the rows of ``walk``, and for each node the rows it is parent of."""

    def __init__(self, value: object):
        self.parent: list[int] = []
        self.label: list[str] = []
        self.kind: list[str] = []
        self.scalar: list[str | None] = []
        self.below: list[list[int]] = []
        self.add(value)

    def add(self, value: object) -> int:
        """Shred a value into the table; the node of its top."""
        top = len(self.kind)
        for node, parent, label, _, kind, scalar in walk(value):
            self.parent.append(parent + top if parent >= 0 else -1)
            self.label.append(label)
            self.kind.append(kind)
            self.scalar.append(scalar)
            self.below.append([])
            if parent >= 0:
                self.below[parent + top].append(node + top)
        return top

    def child(self, node: int, label: str) -> int | None:
        if self.kind[node] == "object":
            for c in self.below[node]:
                if self.label[c] == label:
                    return c
        return None

    def opened(self, node: int | None) -> int | None:
        """The node; of a text that holds JSON the top of its nodes, which join the table; else None."""
        if node is None or self.kind[node] != "string":
            return node
        value = parsed(self.scalar[node])
        return None if value is None else self.add(value)

    def pivot(self, node: int, columns: list[str]) -> list[str | None]:
        """The scalar children of an object node as columns."""
        has = {self.label[c]: self.scalar[c] for c in self.below[node]} if self.kind[node] == "object" else {}
        return [has.get(c) for c in columns]

    def elements(self, top: int = 0) -> Iterator[int]:
        """The elements of a tool container in reading order: [x], {"tools": [x]}, {id: x} and {server: [x]}."""
        for c in self.below[top]:
            if self.kind[top] == "object" and self.kind[c] == "array":
                yield from self.below[c]
            else:
                yield c

    def tool_schema(self, tool: int) -> int | None:
        for name in SCHEMA_MEMBERS:
            c = self.child(tool, name)
            if c is not None and self.kind[c] != "null":
                return c
        return None

    def parameters(self, schema: int | None) -> Iterator[tuple[str, str, str, int, int]]:
        """(path, parent path, name, ordinal, node) of every parameter of a schema, equal paths once.

        A parameter is a member of a ``properties`` object of a schema: the given one, that of a parameter,
        of its ``items`` or of a member of its ``anyOf``; in a list of parameters each with a ``name`` is one.
        """
        seen: set[str] = set()
        todo: list[tuple[int | None, str]] = [(schema, "")]
        while todo:
            x, path = todo.pop()
            x = self.opened(x)
            if x is None:
                continue
            found: list[tuple[str, int]] = []
            below: list[tuple[int | None, str]] = []
            if self.kind[x] == "array":
                named = [(self.child(p, "name"), p) for p in self.below[x]]
                found = [(self.scalar[n], p) for n, p in named if n is not None and self.kind[n] == "string"]
            elif self.kind[x] == "object":
                inside = self.opened(self.child(x, "properties"))
                if inside is not None and self.kind[inside] == "object":
                    found = [(self.label[c], c) for c in self.below[inside]]
                items = self.opened(self.child(x, "items"))
                if items is not None:
                    below = [(y, path) for y in (self.below[items] if self.kind[items] == "array" else [items]) if self.kind[y] == "object"]
                options = self.opened(self.child(x, "anyOf"))
                if options is not None and self.kind[options] == "array":
                    below += [(y, path) for y in self.below[options] if self.kind[y] in ("object", "string")]
            for i, (name, node) in enumerate(found):
                own = f"{path}/{name}" if path else name
                if own not in seen:
                    seen.add(own)
                    yield own, path, name, i, node
                if self.kind[node] in ("object", "string"):
                    below.append((node, own))
            todo.extend(reversed(below))


def parameters(schema: object) -> Iterator[tuple[str, str, str, int, int]]:
    """``Nodes.parameters`` of a schema that stands alone."""
    return Nodes(schema).parameters(0)


def _of_schema(raw: str | None) -> Iterator[tuple[int, Nodes, int, int | None]]:
    value = parsed(raw)
    if isinstance(value, (dict, list)):
        yield 0, Nodes(value), 0, 0


def _of_tools(raw: str | None) -> Iterator[tuple[int, Nodes, int, int | None]]:
    nodes = Nodes(parsed(raw))
    for pos, tool in enumerate(nodes.elements()):
        if nodes.kind[tool] == "object":
            yield pos, nodes, tool, nodes.tool_schema(tool)


#: How a column's text is opened: to (position, node table, tool, schema).
OPENERS: dict[str, Callable] = {"schema": _of_schema, "tools": _of_tools}


def parameter_table(df: DataFrame, key: str, text: str, opener: str, attributes: list[str] = ()) -> DataFrame:
    """(rec_id, tool_pos, path, parent_path, name, ordinal, one column per attribute) of each parameter.

    ``opener`` is 'schema' (the text is one tool's schema, tool_pos 0) or 'tools' (a container of tools).
    An attribute is the scalar member of that name of the parameter's object, as text; null where it is
    absent, null or not a scalar. Unreadable, blank and null texts give no rows. Repeated rows repeat.
    """
    attributes = list(attributes)

    def run(batches):
        open_ = OPENERS[opener]
        for batch in batches:
            at, pos, path, parent, label, ordinal = [], [], [], [], [], []
            scalars: list[list[str | None]] = [[] for _ in attributes]
            for i, raw in enumerate(batch.column(1).to_pylist()):
                for tool_pos, nodes, _, schema in open_(raw):
                    for own, above, name, number, node in nodes.parameters(schema):
                        at.append(i)
                        pos.append(tool_pos)
                        path.append(own)
                        parent.append(above)
                        label.append(name)
                        ordinal.append(number)
                        if attributes:
                            for column, v in zip(scalars, nodes.pivot(node, attributes), strict=True):
                                column.append(v)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            flat = [ids, pa.array(pos, pa.int32()), pa.array(path, pa.string()), pa.array(parent, pa.string()), pa.array(label, pa.string()), pa.array(ordinal, pa.int32())]
            yield pa.RecordBatch.from_arrays([*flat, *(pa.array(s, pa.string()) for s in scalars)], names=["rec_id", "tool_pos", "path", "parent_path", "name", "ordinal", *attributes])

    kind = df.schema[key].dataType.simpleString()
    more = "".join(f", `{a}` string" for a in attributes)
    return df.select(key, text).mapInArrow(run, f"rec_id {kind}, tool_pos int, path string, parent_path string, name string, ordinal int{more}")


def tool_table(df: DataFrame, key: str, text: str, attributes: list[str]) -> DataFrame:
    """(rec_id, tool_pos, one column per attribute, n_params) of each tool object of a container column."""
    attributes = list(attributes)

    def run(batches):
        for batch in batches:
            at, pos, count = [], [], []
            scalars: list[list[str | None]] = [[] for _ in attributes]
            for i, raw in enumerate(batch.column(1).to_pylist()):
                for tool_pos, nodes, tool, schema in _of_tools(raw):
                    at.append(i)
                    pos.append(tool_pos)
                    count.append(sum(1 for _ in nodes.parameters(schema)))
                    for column, v in zip(scalars, nodes.pivot(tool, attributes), strict=True):
                        column.append(v)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(pos, pa.int32()), *(pa.array(s, pa.string()) for s in scalars), pa.array(count, pa.int32())], names=["rec_id", "tool_pos", *attributes, "n_params"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"rec_id {kind}, tool_pos int, {''.join(f'`{a}` string, ' for a in attributes)}n_params int")

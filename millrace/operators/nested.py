"""Flattening of deeply nested records by interval labels.

A depth-first traversal numbers every node of a record on the way in (``pre``) and on the way out
(``post``). Node a lies above node b exactly if ``a.pre < b.pre`` and ``a.post > b.post``, so the
flat tables need no other pointers. A record is whole in one task, where one pass over its labels
finds every parent by containment; across tables ``contained`` does so by a join on the record.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import session


@dataclass(frozen=True)
class Entity:
    """An array: where it hangs below its parent and which key names its objects; without one its elements are plain values, named by their position."""

    name: str
    id_key: str | None
    path: tuple[str, ...]
    children: tuple["Entity", ...] = field(default=())


#: The arrays of objects in a listing payload.
LISTING_ENTITIES = (
    Entity("opening", "opening_id", ("openings",), (
        Entity("shift", "shift_id", ("shifts",), (
            Entity("slot", "slot_id", ("slots",)),
        )),
    )),
    Entity("band", "band_id", ("compensation", "bands"), (
        Entity("component", "component_id", ("components",)),
    )),
    Entity("question", "question_id", ("application", "form", "questions"), (
        Entity("option", "option_id", ("options",)),
    )),
)

#: All arrays of a listing payload: those of objects, the history of the record and the lists of plain texts.
ALL_LISTING_ENTITIES = (
    *LISTING_ENTITIES, Entity("revision", "rev", ("metadata", "history")), Entity("benefit", None, ("compensation", "benefits")), Entity("requirement", None, ("requirements",)),
)

MAX_DECODINGS = 3
NODE_SCHEMA = "doc_no long, entity string, depth int, own_id string, pre long, post long, attributes string, id_path string, parent_pre long"


def decode(value: object, times: int = MAX_DECODINGS) -> object:
    """Parses text that encodes JSON, up to ``times`` layers; text that is no JSON gives None."""
    while isinstance(value, str) and times > 0:
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
        times -= 1
    return None if isinstance(value, str) else value


def _reach(node: object, path: tuple[str, ...]) -> object:
    for step in path:
        node = decode(node)
        if not isinstance(node, dict):
            return None
        node = node.get(step)
    return node


def members(value: object, id_key: str | None) -> Iterator[object]:
    """Elements of an array however it is written: a list, one bare element, an object keyed by position, or text of these; nulls are none.

    With ``id_key`` only objects count, without it only plain values.
    """
    plain = id_key is None
    made = decode(value)
    if isinstance(made, list):
        items = made
    elif isinstance(made, dict):
        items = [made] if not plain and id_key in made else [x for k, x in made.items() if k.isdigit()]
    elif plain and value is not None:
        items = [value]
    else:
        return
    for item in items:
        if plain:
            if item is not None and not isinstance(item, (dict, list)):
                yield item
        elif isinstance(item := decode(item), dict):
            yield item


def _text(value: object) -> str | None:
    if value is None:
        return None
    if not isinstance(value, str):
        return json.dumps(value)
    return value.encode("utf-8", "replace").decode("utf-8")  # a lone surrogate cannot be stored


def _without(node: dict, paths: list[tuple[str, ...]]) -> dict:
    """The members of an object but those that are tables of their own."""
    out = {}
    for k, v in node.items():
        below = [p[1:] for p in paths if p[0] == k]
        if () in below:
            continue
        out[k] = _without(v, below) if below and isinstance(v, dict) else v
    return out


def label(root: dict, entities: tuple[Entity, ...], root_name: str | None = None) -> list[tuple]:
    """(entity, depth, own id, pre, post, other members as JSON) of each node, by a depth-first walk; the root is a node if it has a name."""
    out: list[list] = []
    clock = 0
    top = Entity(root_name or "", None, (), entities)
    todo: list[tuple] = [("open", root, top, 0, None)] if root_name else [("array", root, e, 1) for e in reversed(entities)]
    while todo:
        step = todo.pop()
        if step[0] == "close":
            clock += 1
            out[step[1]][4] = clock
        elif step[0] == "array":
            _, holder, entity, depth = step
            found = list(enumerate(members(_reach(holder, entity.path), entity.id_key)))
            todo.extend(("open", x, entity, depth, i) for i, x in reversed(found))
        else:
            _, node, entity, depth, position = step
            clock += 1
            if isinstance(node, dict):
                own = _text(node.get(entity.id_key)) if entity.id_key else None
                rest = _without(node, [(entity.id_key,), *(c.path for c in entity.children)] if entity.id_key else [c.path for c in entity.children])
            else:
                own, rest = str(position), {"value": node}
            todo.append(("close", len(out)))
            out.append([entity.name, depth, own, clock, 0, _text(json.dumps(rest))])
            todo.extend(("array", node, c, depth + 1) for c in reversed(entity.children))
    return [tuple(x) for x in out]


def linked(labels: list[tuple]) -> list[tuple]:
    """Adds the path of ids from the outermost node below the root, and ``pre`` of the parent, to labels in pre-order.

    The parent is the last node opened whose interval holds that of the node.
    """
    out: list[tuple] = []
    above: list[tuple[int, int, tuple[str, ...]]] = []
    for node in labels:
        _, depth, own, pre, post, _ = node
        while above and above[-1][1] < post:
            above.pop()
        path = (*above[-1][2], own or "") if above else (own or "",)
        path = path if depth else ()
        out.append((*node, "/".join(path), above[-1][0] if above else None))
        above.append((pre, post, path))
    return out


def nodes(df: DataFrame, key: str, payload: str, body: str | None, entities: tuple[Entity, ...] = LISTING_ENTITIES, root_name: str | None = None) -> DataFrame:
    """The labelled nodes of all payloads with the key of their record and ``doc_no``, the number of its input row.

    ``body`` names the member of the payload that holds the arrays, None if the payload itself does.
    A payload that is null, no JSON, no object or without a readable body has no nodes. No shuffle.
    """
    numbered = df.select(F.col(key).alias("record_key"), F.col(payload).cast("string").alias("payload"), F.monotonically_increasing_id().alias("doc_no"))
    schema = f"record_key {numbered.schema['record_key'].dataType.simpleString()}, {NODE_SCHEMA}"
    names = ("doc_no", "entity", "depth", "own_id", "pre", "post", "attributes", "id_path", "parent_pre")
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            source: list[int] = []
            for i, (text, doc_no) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                root = decode(text)
                if isinstance(root, dict) and body is not None:
                    root = decode(root.get(body))
                if isinstance(root, dict):
                    found = linked(label(root, entities, root_name))
                    rows.extend((doc_no, *x) for x in found)
                    source.extend([i] * len(found))
            columns = list(zip(*rows)) or [()] * len(names)
            made = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *made], ["record_key", *names])

    return numbered.mapInArrow(run, schema)


def contained(outer: DataFrame, inner: DataFrame, columns: tuple[str, ...] = ("own_id",)) -> DataFrame:
    """``inner`` with ``columns`` of the rows of ``outer`` whose interval holds its own, as outer_<column>; a node with several such ancestors has a row for each."""
    up = outer.select(F.col("doc_no").alias("_doc"), F.col("pre").alias("_pre"), F.col("post").alias("_post"), *[F.col(c).alias(f"outer_{c}") for c in columns])
    return inner.join(up, (F.col("doc_no") == F.col("_doc")) & (F.col("_pre") < F.col("pre")) & (F.col("_post") > F.col("post"))).drop("_doc", "_pre", "_post")


def tables(
    df: DataFrame, key: str = "raw_id", payload: str = "payload", body: str | None = "job_model_json",
    entities: tuple[Entity, ...] = ALL_LISTING_ENTITIES, root_name: str = "posting",
) -> dict[str, DataFrame]:
    """One table per type of node, the root included, each with the columns of ``flatten``; written once and cut from their lineage."""
    whole = session.cut(flatten(df, key, payload, body, entities, root_name))

    def names(some: tuple[Entity, ...]) -> Iterator[str]:
        for e in some:
            yield e.name
            yield from names(e.children)

    return {name: whole.filter(F.col("entity") == name) for name in (root_name, *names(entities))}


def flatten(
    df: DataFrame,
    key: str = "raw_id",
    payload: str = "payload",
    body: str | None = "job_model_json",
    entities: tuple[Entity, ...] = LISTING_ENTITIES,
    root_name: str | None = None,
) -> DataFrame:
    """One row per node: key, doc_no, entity, id_path, own_id, depth, pre, post, parent_pre, attributes (JSON).

    The arrays may be lists, a bare object, objects keyed by position, or text encoding any of
    these; null elements are skipped. ``attributes`` holds all members that are no table of their
    own. Repeated rows and rows with the same or a null key stay apart (``doc_no`` numbers input
    rows), an object without an id has an empty step in its path, a plain value is named by its
    position, and columns of ``df`` other than the two named are not read. An empty table gives an
    empty result.
    """
    found = nodes(df, key, payload, body, entities, root_name)
    return found.select(F.col("record_key").alias(key), "doc_no", "entity", "id_path", "own_id", "depth", "pre", "post", "parent_pre", "attributes")

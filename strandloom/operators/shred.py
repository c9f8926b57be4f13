"""Columnar shredding of nested JSON, and flat tables rebuilt from the level sequences.

A batch of documents becomes one column per leaf path. Every entry of a column has a repetition
level (at which repeated ancestor a new element began) and a definition level (how much of the path
was present), so any table of a repeated ancestor can be rebuilt from the columns alone: the ordinal
of an ancestor at depth d is the running count of entries whose repetition level is at most d.

Layouts differ between senders. Paths are inferred per batch (a tree of everything that occurs):
an object's members whose names are all digits are elements of a keyed container ``{}``, arrays are
``[]``, other members are fields. Each repeated element also yields a column ``@`` with its key or
its 0-based place, null where the element itself is null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal
from json.decoder import scanstring

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import ship

# The arrays of an Edit and the kind that each of their entries has.
EDIT_KINDS = {"subs": "sub", "dels": "del", "inss": "ins"}
# The containers above an Edit and the fields that may name their elements.
BLOCK_CONTAINER, BLOCK_IDS = "blocks", ("id", "block_id")
NODE_CONTAINER, NODE_IDS = "alignments", ("node_id", "id")
#: Keys of repeated elements in the path tree.
REPEATED = ("[]", "{}")


class _Path:
    """A node of the path tree: its key, its parent, its children, whether scalars were met here, its columns."""

    __slots__ = ("children", "scalar", "key", "parent", "rep", "leaf", "marks", "first", "last")

    def __init__(self, key: str, parent: _Path | None):
        self.children: dict[str, _Path] = {}
        self.scalar = False
        self.key, self.parent = key, parent
        self.rep = (parent.rep if parent else 0) + (key in REPEATED)
        self.leaf: Column | None = None
        self.marks: Column | None = None
        self.first = self.last = 0  # its columns and those below are a stretch of all columns

    def child(self, key: str) -> _Path:
        found = self.children.get(key)
        if found is None:
            found = self.children[key] = _Path(key, self)
        return found

    def name(self) -> tuple[str, ...]:
        out, at = [], self
        while at.parent is not None:
            out.append(at.key)
            at = at.parent
        return tuple(reversed(out))


class Column:
    """Values of one leaf path with their repetition and definition levels."""

    __slots__ = ("path", "max_rep", "values", "reps", "defs")

    def __init__(self, path: _Path):
        self.path, self.max_rep = path, path.rep
        self.values: list = []
        self.reps: list[int] = []
        self.defs: list[int] = []

    def put(self, value, rep: int, level: int) -> None:
        self.values.append(value)
        self.reps.append(rep)
        self.defs.append(level)


# Documents may be nested as deeply as they are long: nothing below calls itself.


def _infer(document, root: _Path) -> None:
    """Adds the paths of a document to the tree."""
    stack = [(document, root)]
    while stack:
        value, path = stack.pop()
        if type(value) is dict:
            stack.extend((v, path.child("{}" if k.isdigit() else k)) for k, v in reversed(value.items()))
        elif type(value) is list:
            below = path.child("[]")
            stack.extend((v, below) for v in reversed(value))
        elif value is not None:
            path.scalar = True


def _columns(root: _Path) -> list[Column]:
    """The columns of all paths, those of a path and of all below it side by side."""
    columns: list[Column] = []
    stack = [(root, False)]
    while stack:
        path, done = stack.pop()
        if done:
            path.last = len(columns)
            continue
        path.first = len(columns)
        if path.scalar:
            path.leaf = Column(path)
            columns.append(path.leaf)
        if path.key in REPEATED:
            path.marks = Column(path)
            columns.append(path.marks)
        stack.append((path, True))
        stack.extend((c, False) for c in reversed(path.children.values()))
    return columns


def _shred(document, root: _Path, columns: list[Column]) -> None:
    """Adds a document's entries to the columns, depth first."""
    # what is left to do: a value under a path, or (None under _ABSENT) nothing for all columns of a path
    stack: list[tuple] = [(document, root, 0, 0, None)]
    while stack:
        value, path, rep, level, place = stack.pop()
        if value is _ABSENT:
            for c in columns[path.first : path.last]:
                c.put(None, rep, level)
            continue
        if place is not None:
            path.marks.put(None if value is None else place, rep, level + (value is not None))
        if path.leaf is not None:
            leaf = None if type(value) in (dict, list) else value
            path.leaf.put(leaf, rep, level + (leaf is not None))
        kind = type(value)
        after: list[tuple] = []
        for key, below in path.children.items():
            if key == "[]":
                items = enumerate(value) if kind is list else ()
            elif key == "{}":
                items = ((k, v) for k, v in value.items() if k.isdigit()) if kind is dict else ()
            else:
                inner = value.get(key) if kind is dict else None
                after.append((_ABSENT, below, rep, level, None) if inner is None else (inner, below, rep, level + 1, None))
                continue
            at = rep
            for where, item in items:
                after.append((item, below, at, level + 1, where))
                at = below.rep
            if at == rep:
                after.append((_ABSENT, below, rep, level, None))
        stack.extend(reversed(after))


_ABSENT = object()


def shred(documents: list) -> list[Column]:
    """Columns of all leaf paths of the documents; repetition level 0 begins a document."""
    root = _Path("", None)
    for d in documents:
        _infer(d, root)
    columns = _columns(root)
    for d in documents:
        _shred(d, root, columns)
    return columns


def ancestor_slots(reps: np.ndarray, depth: int) -> np.ndarray:
    """For each entry, the index of the entry of a column of ``depth`` that it lies under."""
    return np.cumsum(reps <= depth) - 1


def _objects(column: Column) -> np.ndarray:
    out = np.empty(len(column.values), dtype=object)
    out[:] = column.values
    return out


def _refuse(name: str):
    raise ValueError(name)


def _whole(digits: str):
    """An integer of any number of digits; beyond what ids and places can have, as a decimal."""
    return int(digits) if len(digits) <= 100 else Decimal(digits)


_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_PLAIN = {"true": True, "false": False, "null": None}


def parse_deep(text: str):
    """The value of a JSON text nested to any depth; ValueError if it isn't valid."""
    blank = lambda i: _BLANK.match(text, i).end()
    open_: list = []  # containers that are not closed yet
    keys: list = []  # the key that each of them waits for a value under
    at, n = blank(0), len(text)

    def key(i: int) -> int:
        if text[i : i + 1] != '"':
            raise ValueError(f"a key is expected at {i}")
        name, i = scanstring(text, i + 1, True)
        i = blank(i)
        if text[i : i + 1] != ":":
            raise ValueError(f"a colon is expected at {i}")
        keys[-1] = name
        return blank(i + 1)

    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            open_.append({} if c == "{" else [])
            keys.append(None)
            at = blank(at + 1)
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                at = key(at) if c == "{" else at
                continue
            at, value = at + 1, open_.pop()
            keys.pop()
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif m := _NUMBER.match(text, at):
            value, at = (Decimal(m.group()) if m.group(1) or m.group(2) else _whole(m.group())), m.end()
        else:
            word = next((w for w in _PLAIN if text.startswith(w, at)), None)
            if word is None:
                raise ValueError(f"a value is expected at {at}")
            value, at = _PLAIN[word], at + len(word)
        while True:  # the value is whole: it goes into its container, which may be whole then
            at = blank(at)
            if not open_:
                if at < n:
                    raise ValueError(f"text after the value at {at}")
                return value
            top = open_[-1]
            if type(top) is dict:
                top[keys[-1]] = value
            else:
                top.append(value)
            c = text[at : at + 1]
            if c == ",":
                at = blank(at + 1)
                at = key(at) if type(top) is dict else at
                break
            if c != ("}" if type(top) is dict else "]"):
                raise ValueError(f"a container isn't closed at {at}")
            at, value = at + 1, open_.pop()
            keys.pop()


def parse_json(text: str | None):
    """(value,) of strictly valid JSON of any depth with all digits of its numbers; None for anything else."""
    if text is None:
        return None
    try:
        return (json.loads(text, parse_constant=_refuse, parse_float=Decimal),)
    except json.JSONDecodeError:
        return None
    except (ValueError, ArithmeticError, RecursionError):  # a constant, very many digits, or very deep
        try:
            return (parse_deep(text),)
        except (ValueError, ArithmeticError):
            return None


def _digits(value) -> str | None:
    """An id as text: the exact digits of whole numbers, however they are written."""
    if value is None or isinstance(value, bool):
        return None
    if isinstance(value, Decimal):
        if value.is_finite() and abs(value.adjusted()) <= 100 and value == value.to_integral_value():
            return str(int(value))
        return str(value)
    return str(value).strip()


def _integer(value) -> int | None:
    """A position given as number or text; null for what is no integer of 32 bits."""
    if value is None or isinstance(value, bool):
        return None
    try:
        if isinstance(value, Decimal):
            if not value.is_finite() or value.adjusted() > 10 or value != value.to_integral_value():
                return None
        elif isinstance(value, str) and len(value) > 100:
            return None
        n = int(value)
    except (ValueError, OverflowError, ArithmeticError):
        return None
    return n if -(2**31) <= n < 2**31 else None


def _naming(path: _Path, container: str, fields: tuple[str, ...]) -> list[Column]:
    """The columns that can name the element of ``container`` above ``path``, best first."""
    at = path
    while at.parent is not None and at.parent.parent is not None:
        at = at.parent
        if at.key in REPEATED and at.parent.key == container and at.parent.parent is not None:
            found = [at.children[f].leaf for f in fields if f in at.children and at.children[f].leaf is not None]
            return [at.marks, *found] if at.key == "{}" else found
    return []


def edit_rows(columns: list[Column], doc_ids: np.ndarray) -> dict[str, list]:
    """The table of Edit entries, rebuilt from the level sequences of the columns."""
    out: dict[str, list] = {k: [] for k in ("raw_id", "block_id", "node_id", "edit_kind", "edit_no", "edit_pos", "edit_len", "edit_text")}
    for marks in columns:
        element = marks.path
        if marks is not element.marks or element.key != "[]" or element.parent.key not in EDIT_KINDS:
            continue
        reps = np.asarray(marks.reps, dtype=np.int64)
        places = _objects(marks)
        here = np.flatnonzero(np.array([p is not None for p in marks.values], dtype=bool))
        if not len(here):
            continue

        def leaf(field: str):
            below = element.children.get(field)
            c = below.leaf if below is not None else None
            # every column under an element has one entry per slot of the element unless it repeats itself
            return _objects(c)[here] if c is not None and c.max_rep == marks.max_rep else [None] * len(here)

        def named(container: str, fields: tuple[str, ...]) -> list:
            best: list = [None] * len(here)
            for c in _naming(element, container, fields):
                values = _objects(c)[ancestor_slots(reps, c.max_rep)[here]]
                best = [b if b is not None else _digits(v) for b, v in zip(best, values, strict=True)]
            return best

        out["raw_id"] += doc_ids[ancestor_slots(reps, 0)[here]].tolist()
        out["block_id"] += named(BLOCK_CONTAINER, BLOCK_IDS)
        out["node_id"] += named(NODE_CONTAINER, NODE_IDS)
        out["edit_kind"] += [EDIT_KINDS[element.parent.key]] * len(here)
        out["edit_no"] += places[here].tolist()
        out["edit_pos"] += [_integer(v) for v in leaf("pos")]
        out["edit_len"] += [_integer(v) for v in leaf("len")]
        alt, seq = leaf("alt"), leaf("seq")
        out["edit_text"] += [None if (t := a if a is not None else s) is None else str(t) for a, s in zip(alt, seq, strict=True)]
    return out


EDIT_SCHEMA = "raw_id bigint, block_id string, node_id string, edit_kind string, edit_no int, edit_pos int, edit_len int, edit_text string"
_ARROW = pa.schema(
    [("raw_id", pa.int64()), ("block_id", pa.string()), ("node_id", pa.string()), ("edit_kind", pa.string()),
     ("edit_no", pa.int32()), ("edit_pos", pa.int32()), ("edit_len", pa.int32()), ("edit_text", pa.string())]
)

#: Documents shredded together; levels of so many are held in memory at once.
DOCS_AT_ONCE = 256
#: A document of more brackets than this is shredded alone, so that its paths make no columns for others.
WIDE = 10_000


def _latest(docs: DataFrame, key: str, payload: str, received: str) -> DataFrame:
    latest = docs.groupBy(F.col(key).cast("bigint").alias("raw_id")).agg(F.max(F.struct(F.col(received), F.col(payload))).alias("__last"))
    return latest.select("raw_id", F.col("__last")[payload].alias("payload"))


def _nesting(text: str) -> int:
    """A bound on the depth of a text that costs next to nothing."""
    return min(text.count("[") + text.count("{"), text.count("]") + text.count("}"))


def _shred_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def table(ids: list, docs: list) -> pa.RecordBatch:
        ids_array = np.empty(len(ids), dtype=object)
        ids_array[:] = ids
        return pa.RecordBatch.from_pydict(edit_rows(shred(docs), ids_array), schema=_ARROW)

    for batch in batches:
        for at in range(0, batch.num_rows, DOCS_AT_ONCE):
            part = batch.slice(at, DOCS_AT_ONCE)
            ids, docs = [], []
            for raw_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                text = text.as_py()
                if (parsed := parse_json(text)) is None:
                    continue
                if _nesting(text) > WIDE:
                    yield table([raw_id], [parsed[0]])
                    continue
                ids.append(raw_id)
                docs.append(parsed[0])
            if docs:
                yield table(ids, docs)


def shred_edits(docs: DataFrame, key: str = "raw_id", payload: str = "payload", received: str = "received_at") -> DataFrame:
    """One row per non-null entry of a ``subs``, ``dels`` or ``inss`` array, with its document, block and node.

    Documents delivered several times under one key count once, in their latest version (ties: the
    greatest payload). Valid documents give their rows however deeply they are nested and however
    many digits a number has; ids written as reals of a whole value keep their digits. Defined
    results: null, empty and invalid payloads give no rows (``refused`` lists them); null entries
    keep their place and give no row; an Edit outside any block or node has a null ``block_id`` or
    ``node_id``; a ``pos`` that is absent or no integer is null; an empty table gives no rows;
    other columns are ignored; rows with a null key are kept as one document.
    """
    ship(docs.sparkSession)
    return _latest(docs, key, payload, received).mapInArrow(_shred_batches, EDIT_SCHEMA)


def refused(docs: DataFrame, key: str = "raw_id", payload: str = "payload", received: str = "received_at") -> DataFrame:
    """raw_id, reason of the documents that give no rows at all: ``null``, ``empty`` (blanks only) or ``invalid`` JSON."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, reasons = [], []
            for raw_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                reason = "null" if text is None else "empty" if not text.strip(" \t\n\r") else "invalid" if parse_json(text) is None else None
                if reason:
                    ids.append(raw_id)
                    reasons.append(reason)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(reasons, pa.string())], names=["raw_id", "reason"])

    return _latest(docs, key, payload, received).mapInArrow(run, "raw_id bigint, reason string")


def flatten_alignments(blocks: DataFrame) -> DataFrame:
    """The same table from typed alignments: MAP<node_id, STRUCT<subs, dels, inss>> per (graph, block).

    Native generators only. Null maps, null Edits, null lists and null entries give no rows; null
    entries keep their place.
    """
    nodes = blocks.select("graph_id", "block_id", F.explode("alignments").alias("node_id", "edit"))
    def entry(kind: str):
        text = {"subs": "alt", "inss": "seq"}.get(kind)
        return lambda e, i: F.struct(
            i.alias("edit_no"),
            e["pos"].alias("edit_pos"),
            (F.lit(None).cast("int") if text else e["len"]).alias("edit_len"),
            (e[text] if text else F.lit(None).cast("string")).alias("edit_text"),
            e.isNotNull().alias("present"),
        )

    kinds = [
        F.struct(F.lit(v).alias("edit_kind"), F.transform(F.col(f"edit.{k}"), entry(k)).alias("entries"))
        for k, v in EDIT_KINDS.items()
    ]
    rows = nodes.select("graph_id", "block_id", "node_id", F.explode(F.array(*kinds)).alias("k")).select(
        "graph_id", "block_id", "node_id", "k.edit_kind", F.explode("k.entries").alias("e")
    )
    return rows.where("e.present").select(
        "graph_id", "block_id", "node_id", "edit_kind", "e.edit_no", "e.edit_pos", "e.edit_len", "e.edit_text"
    )

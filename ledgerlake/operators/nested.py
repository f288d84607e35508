"""Nested records turned into related flat tables.

Each document is indexed structurally (see ``functions.jsonindex``); nodes are spans between marks
of one nesting depth. A table is given by the path to its nodes: member names, ``*`` for every member
(its name becomes a column) and ``[]`` for every object of an array (its place becomes a column; an
object in place of the array counts as an array of one). All rows carry the links to their document
and the names and places on their path, so the tables join back without loss.

Scale: one pass over the documents and no shuffle of its own; each document is indexed once, for
whichever table is wanted. Memory is bound by one Arrow batch (64 MB of text and one document), the
index of one document and ``FRAME_ROWS`` rows of output beside that document's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.jsonindex import StructuralIndex

_OBJECT, _ARRAY = ord("{"), ord("[")
_TEXT = "\u0001text"  # no name a key column has
ENTRY_FIELDS = ("start", "end", "val", "accn", "fy", "fp", "form", "filed", "frame")
#: Bytes of small documents that are indexed together.
GROUP_BYTES = 100_000
#: Rows of a frame handed to Spark, but for a single document that has more.
FRAME_ROWS = 50_000


@dataclass(frozen=True)
class Table:
    """One flat table: the objects at the end of ``path``.

    ``path`` is of (step, column) pairs; column None keeps no column (member names need none).
    ``fields`` maps a column to the member whose scalar it takes (text as written; objects and
    arrays give NULL), ``counts`` a column to the member whose own members or elements it counts, and
    whether only objects among them.
    """

    path: tuple[tuple[str, str | None], ...]
    fields: dict[str, str] = field(default_factory=dict)
    counts: dict[str, tuple[str, bool]] = field(default_factory=dict)

    def columns(self) -> list[tuple[str, str]]:
        keys = [(c, "int" if step == "[]" else "string") for step, c in self.path if c]
        return keys + [(c, "string") for c in self.fields] + [(c, "int") for c in self.counts]


_TAXONOMY = (("facts", None), ("*", "taxonomy"))
_TAG = (*_TAXONOMY, ("*", "concept_name"))
#: The tables of a filing document.
FILING_TABLES = {
    "documents": Table((), {"entity_name": "entityName", "document_cik": "cik"}, {"n_taxonomies": ("facts", True)}),
    "tags": Table(_TAG, {"label": "label", "description": "description"}, {"n_units": ("units", False)}),
    "entries": Table((*_TAG, ("units", None), ("*", "unit"), ("[]", "entry_no")), {f: f for f in ENTRY_FIELDS}),
}


@dataclass
class _Nodes:
    """Objects and arrays of one depth, in order of place, with the columns gathered on the way to them."""

    level: int
    start: np.ndarray
    end: np.ndarray
    keys: list[list]

    def only(self, keep: np.ndarray, first: np.ndarray, kind: int) -> _Nodes:
        at = np.flatnonzero(keep & (first == kind))
        return _Nodes(self.level, self.start[at], self.end[at], [[k[i] for i in at] for k in self.keys])


def rows_of(ix: StructuralIndex, table: Table, wanted: tuple[str, ...] | None = None, roots: _Nodes | None = None) -> list[list]:
    """Columns of a table's rows in one valid document, or behind the columns of ``roots``; of ``fields`` only ``wanted`` are read."""
    roots = roots or _Nodes(0, ix.tokens[:1], np.array([ix.bytes.size]), [])
    nodes = [roots]
    for step, column in table.path:
        nodes = [n for group in nodes for n in _down(ix, group, step, bool(column)) if n.start.size]
    nodes = [n.only(np.ones(n.start.size, dtype=bool), ix.bytes[n.start], _OBJECT) for n in nodes]
    out: list[list] = [[] for _ in range(len(roots.keys) + len(table.columns()))]
    for n in nodes:
        if n.start.size:
            for have, more in zip(out, _read(ix, n, table, wanted), strict=True):
                have.extend(more)
    return out


def index_documents(texts: list[bytes], numbers: list[int]) -> Iterator[tuple[StructuralIndex, _Nodes]]:
    """Indexes of the valid documents, small ones together, with the root and number of each.

    Documents are joined to one array. If that is valid and its only commas of the first depth are
    those between the documents, each of them is valid by itself; else each half is tried.
    """
    if len(numbers) == 1:
        ix = StructuralIndex(texts[0])
        if ix.valid:
            yield ix, _Nodes(0, ix.tokens[:1], np.array([ix.bytes.size]), [numbers])
        return
    if not numbers:
        return
    ix = StructuralIndex(b"[" + b",".join(texts) + b"]")
    size = np.array([len(t) for t in texts])
    ends = np.cumsum(size + 1)  # the commas, and the closing bracket
    if ix.valid:
        own = ix.here(1)
        if np.array_equal(ix.pos[own][ix.kind[own] == 2], ends[:-1]):
            yield ix, _Nodes(1, ix.next_token(ends - size), ends, [numbers])
            return
    half = len(numbers) // 2
    yield from index_documents(texts[:half], numbers[:half])
    yield from index_documents(texts[half:], numbers[half:])


def _down(ix: StructuralIndex, n: _Nodes, step: str, named: bool) -> list[_Nodes]:
    first = ix.bytes[n.start]
    every = np.ones(n.start.size, dtype=bool)
    objects = n.only(every, first, _OBJECT)
    if step == "[]":
        arrays = n.only(every, first, _ARRAY)
        out = []
        if arrays.start.size:
            start, end, owner, place = ix.elements(n.level + 1, (arrays.start, arrays.end))
            keys = [[k[i] for i in owner] for k in arrays.keys]
            out.append(_Nodes(n.level + 1, start, end, [*keys, place.tolist()] if named else keys))
        objects.keys = [*objects.keys, [0] * objects.start.size] if named else objects.keys
        return [*out, objects]
    if not objects.start.size:
        return []
    m, owner = ix.members(n.level + 1, (objects.start, objects.end))
    if step == "*":
        m, owner, names = ix.last_of_name(m, owner)
    else:
        m, owner = _last(*_pick(m, owner, ix.which(m, (step,)) == 0))
        names = []
    keep = np.flatnonzero((m.first == _OBJECT) | (m.first == _ARRAY))
    keys = [[k[i] for i in owner[keep]] for k in objects.keys]
    return [_Nodes(n.level + 1, m.open[keep], m.end[keep], [*keys, [names[i] for i in keep]] if named and step == "*" else keys)]


def _pick(m, owner: np.ndarray, keep: np.ndarray):
    at = np.flatnonzero(keep)
    return m.pick(at), owner[at]


def _last(m, owner: np.ndarray):
    """Of members of one name the last of each owner."""
    return _pick(m, owner, np.r_[owner[1:] != owner[:-1], True]) if owner.size else (m, owner)


def _read(ix: StructuralIndex, n: _Nodes, table: Table, wanted: tuple[str, ...] | None) -> list[list]:
    """Columns of the rows of one group of objects."""
    size = n.start.size
    names = tuple(dict.fromkeys(v for c, v in table.fields.items() if wanted is None or c in wanted)) + tuple(dict.fromkeys(v for v, _ in table.counts.values()))
    values: dict[str, list] = {v: [None] * size for v in names}
    m, owner = ix.members(n.level + 1, (n.start, n.end))
    which = ix.which(m, names)
    counted = {v for v, _ in table.counts.values()}
    for i in np.flatnonzero(which >= 0).tolist():  # in order of place: of repeated names the last counts
        name = names[which[i]]
        nested = m.first[i] == _OBJECT or m.first[i] == _ARRAY
        values[name][owner[i]] = (int(m.open[i]), int(m.end[i])) if name in counted else None if nested else ix.scalar(int(m.open[i]), int(m.end[i]))
    fields = [values[v] if wanted is None or c in wanted else [None] * size for c, v in table.fields.items()]
    counts = [_counts(ix, n.level + 1, values[v], objects) for v, objects in table.counts.values()]
    return [*n.keys, *fields, *counts]


def _counts(ix: StructuralIndex, level: int, spans: list, objects: bool) -> list[int]:
    out = [0] * len(spans)
    held = [i for i, s in enumerate(spans) if s is not None]
    for kind in (_OBJECT, _ARRAY):
        own = [i for i in held if ix.bytes[spans[i][0]] == kind]
        if not own:
            continue
        box = (np.array([spans[i][0] for i in own]), np.array([spans[i][1] for i in own]))
        if kind == _ARRAY:
            owner = ix.elements(level + 1, box)[2]
        else:
            m, owner = ix.members(level + 1, box)
            m, owner, _ = ix.last_of_name(m, owner)
            owner = owner[m.first == _OBJECT] if objects else owner
        for k, c in zip(*np.unique(owner, return_counts=True), strict=True):
            out[own[int(k)]] = int(c)
    return out


def _flatten(table: Table, keys: list[str], invalid: bool, wanted: tuple[str, ...] | None):
    names = [*keys, *(["is_valid"] if invalid else []), *[c for c, _ in table.columns()]]
    whole = [c for c, kind in table.columns() if kind == "int"]

    def frame(held: list[list]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series(h, dtype="Int64" if c in whole else object) for c, h in zip(names, held, strict=True)})

    def rows(texts: list[bytes], numbers: list[int], own: list[list], missing: set[int]) -> Iterator[list[list]]:
        for ix, roots in index_documents(texts, numbers):
            document, *columns = rows_of(ix, table, wanted, roots)
            valid = set(roots.keys[0]) - set(document) if invalid else ()
            missing.difference_update(roots.keys[0])
            yield [*[[k[i] for i in document] for k in own], *([[True] * len(document)] if invalid else []), *columns]
            for i in valid:  # a document without any object is a row of its own
                yield blank(own, i, True)

    def blank(own: list[list], i: int, valid: bool) -> list[list]:
        return [*[[k[i]] for k in own], [valid], *[[0 if c in whole else None] for c, _ in table.columns()]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list] = [[] for _ in names]
        for pdf in batches:
            own = [pdf[k].tolist() for k in keys]
            missing = set(range(len(pdf)))
            for texts, numbers in _groups(pdf[_TEXT]):
                for part in rows(texts, numbers, own, missing):
                    for have, more in zip(held, part, strict=True):
                        have.extend(more)
                    if len(held[0]) >= FRAME_ROWS:
                        yield frame(held)
                        held = [[] for _ in names]
            for i in sorted(missing) if invalid else ():
                for have, more in zip(held, blank(own, i, False), strict=True):
                    have.extend(more)
        yield frame(held)

    return run


def _groups(texts: pd.Series) -> Iterator[tuple[list[bytes], list[int]]]:
    """Documents to index together: up to GROUP_BYTES of those that end as they begin; all others by themselves."""
    group: list[bytes] = []
    numbers: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if not isinstance(text, str):
            continue
        data = text.encode("utf-8", "replace")
        if len(data) > GROUP_BYTES or (data.lstrip()[:1], data.rstrip()[-1:]) not in ((b"{", b"}"), (b"[", b"]")):
            yield [data], [i]
            continue
        if group and size + len(data) > GROUP_BYTES:
            yield group, numbers
            group, numbers, size = [], [], 0
        group.append(data)
        numbers.append(i)
        size += len(data)
    if group:
        yield group, numbers


def flatten_nested(df: DataFrame, table: Table, text: str, keys: list[str], invalid: bool = False, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """One flat table of nested documents, with the columns ``keys`` of each document's row.

    Only text that is one valid JSON value gives rows; with ``invalid`` every other document gives one
    row too, and ``is_valid`` tells which. Missing levels and levels of another type give no rows.
    Where an object repeats a name its last member counts. NULL and non-object elements take a place
    but give no row. Values are text as written; JSON null and absent fields are NULL. Of the
    table's fields only ``wanted`` are read, the others' columns are NULL.
    """
    kinds = dict(df.dtypes)
    schema = [f"`{k}` {kinds[k]}" for k in keys] + (["is_valid boolean"] if invalid else []) + [f"`{c}` {t}" for c, t in table.columns()]
    return df.select(*keys, F.col(text).alias(_TEXT)).mapInPandas(_flatten(table, keys, invalid, wanted), ", ".join(schema))


def flatten_documents(df: DataFrame, kind: str, text: str = "json_text", cik: Column | None = None, extract_date: Column | None = None, fields: tuple[str, ...] = ENTRY_FIELDS) -> DataFrame:
    """One of the flat tables of filing documents: ``documents``, ``tags`` or ``entries``.

    ``doc_key`` is a hash of company, date and text and links the three tables; a repeated
    delivery of the same text has the same key. NULL, empty, cut-off or otherwise broken text gives a
    document row with ``is_valid`` false and nothing else; see ``flatten_nested`` for the rest. Only
    ``fields`` of the entries are read, the others' columns are NULL.
    """
    one = df.select(
        (cik if cik is not None else F.col("cik")).alias("cik"),
        (extract_date if extract_date is not None else F.col("extract_date")).alias("extract_date"),
        F.col(text).alias("json_text"),
    ).select(F.sha2(F.concat_ws("|", "cik", "extract_date", "json_text"), 256).alias("doc_key"), "*")
    return flatten_nested(one, FILING_TABLES[kind], "json_text", ["doc_key", "cik", "extract_date"], kind == "documents", fields if kind == "entries" else None)


class DocumentRows:
    """Documents, tags and entries of one valid filing document, for use outside Spark."""

    def __init__(self, text: str, fields: tuple[str, ...] = ENTRY_FIELDS):
        ix = StructuralIndex(text.encode("utf-8", "replace"))
        cover = [c[0] if c else None for c in rows_of(ix, FILING_TABLES["documents"])]
        self.cover = {k: v for k, v in zip(("entityName", "cik"), cover, strict=False) if v is not None}
        self.n_taxonomies = cover[2] or 0
        self.tags = list(map(list, zip(*rows_of(ix, FILING_TABLES["tags"]), strict=True)))
        columns = rows_of(ix, FILING_TABLES["entries"], fields)
        self.entries = [[*r[:4], {f: v for f, v in zip(ENTRY_FIELDS, r[4:], strict=True) if v is not None}] for r in zip(*columns, strict=True)]

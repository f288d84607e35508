"""Structural index of a JSON document.

Quote, bracket and delimiter bitmaps are built over the bytes of the document; the running
parity of quotes masks text inside strings, and the prefix sum of opening minus closing
brackets is the nesting depth. Whether the text is JSON at all follows from the same marks: brackets
must pair within their depth, and every token must be one its neighbour and its container allow.
Spans of objects, members and array elements follow from the sorted positions of one depth, without
building a tree and without another parser.

Memory: about ten bytes a byte of the document while the index is built, then only the marks.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np

_QUOTE, _BACK, _COMMA, _COLON = 0x22, 0x5C, 0x2C, 0x3A
_KIND = np.zeros(256, dtype=np.int8)  # 1 opens, -1 closes, 2 comma, 3 colon
_KIND[[ord("{"), ord("[")]] = 1
_KIND[[ord("}"), ord("]")]] = -1
_KIND[_COMMA], _KIND[_COLON] = 2, 3
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True
_ESCAPE = np.zeros(256, dtype=bool)
_ESCAPE[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_PRIMITIVES = re.compile(rb"(?:(?:-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][-+]?[0-9]++)?|true|false|null) )*+")

#: Token classes of the grammar check.
_OPEN_OBJECT, _OPEN_ARRAY, _CLOSE, _COMMA_T, _COLON_T, _STRING, _PRIMITIVE = range(7)


def is_valid(text: str) -> bool:
    """Whether the text is one JSON value (NaN and Infinity are none), however long its numbers and deep its brackets."""
    return StructuralIndex(text.encode("utf-8", "replace")).valid


def clean(text: str) -> str:
    """Lone surrogates, which no UTF-8 column can hold, become replacement characters."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


@dataclass
class Members:
    """Members of objects at one depth: key, value span and what the value begins with."""

    at: np.ndarray  # position of the colon
    end: np.ndarray  # position of the comma or bracket after the value
    first: np.ndarray  # first byte of the value
    open: np.ndarray  # its position

    def pick(self, at: np.ndarray) -> Members:
        return Members(self.at[at], self.end[at], self.first[at], self.open[at])


class StructuralIndex:
    """The marks and depths of a document; ``valid`` tells whether it is one JSON value.

    Only a valid document's members and elements may be asked for.
    """

    def __init__(self, data: bytes):
        self.data = data
        self.bytes = b = np.frombuffer(data, dtype=np.uint8)
        quote = b == _QUOTE
        self.back = np.flatnonzero(b == _BACK)
        escapes = self.back
        if self.back.size:
            # Of a run of backslashes every other one, from the first on, escapes the byte behind it.
            run = np.flatnonzero(np.r_[True, np.diff(self.back) != 1])
            place = np.arange(self.back.size) - np.repeat(run, np.diff(np.r_[run, self.back.size]))
            escapes = self.back[place % 2 == 0]
            quote[escapes[escapes + 1 < b.size] + 1] = False
        inside = (np.cumsum(quote, dtype=np.uint8) & 1).astype(bool)  # from the opening quote up to the closing one
        kind = _KIND[b]
        kind[inside] = 0
        self.pos = np.flatnonzero(kind)
        self.kind = kind[self.pos]
        self.depth = np.cumsum(np.where(np.abs(self.kind) == 1, self.kind, 0), dtype=np.int32)
        self.level = self.depth + (self.kind == -1)  # depth of the container a mark belongs to
        self.quotes = np.flatnonzero(quote)
        solid = ~(_BLANK[b] | inside | quote | (kind != 0))
        starts = np.flatnonzero(solid & ~np.r_[False, solid[:-1]]) if b.size else np.empty(0, dtype=np.int64)
        self.tokens = np.sort(np.concatenate([self.pos, self.quotes[::2], starts]))
        self.valid = self._check(inside, quote, solid, starts, escapes)
        self._here: dict[int, np.ndarray] = {}

    def _check(self, inside: np.ndarray, quote: np.ndarray, solid: np.ndarray, starts: np.ndarray, escapes: np.ndarray) -> bool:
        b = self.bytes
        if not self.tokens.size or self.quotes.size % 2 or (self.depth.size and (self.depth[-1] != 0 or self.depth.min() < 0)):
            return False
        # Strings: no control characters, only known escapes, none outside.
        if (inside & (b < 0x20)).any() or (self.back.size and not inside[self.back].all()):
            return False
        if escapes.size:
            if escapes[-1] + 1 >= b.size or not _ESCAPE[b[escapes + 1]].all():
                return False
            u = escapes[b[escapes + 1] == ord("u")]
            if u.size and (u[-1] + 5 >= b.size or not _HEX[b[u[:, None] + np.arange(2, 6)]].all()):
                return False
        # Numbers and words, joined by blanks.
        if starts.size:
            ends = np.flatnonzero(solid & ~np.r_[solid[1:], False])
            kept = b[solid]
            joined = np.full(kept.size + starts.size, 0x20, dtype=np.uint8)
            joined[np.arange(kept.size) + np.repeat(np.arange(starts.size), ends - starts + 1)] = kept
            if not _PRIMITIVES.fullmatch(joined.tobytes()):
                return False
        # Brackets pair within their depth.
        is_bracket = np.abs(self.kind) == 1
        at, level = self.pos[is_bracket], self.level[is_bracket]
        order = np.argsort(level, kind="stable")
        opens, closes = at[order][::2], at[order][1::2]
        if at.size % 2 or (level[order][::2] != level[order][1::2]).any() or (_KIND[b[opens]] != 1).any() or (b[closes] != b[opens] + 2).any():
            return False
        return self._grammar(starts, at, order)

    def _grammar(self, starts: np.ndarray, brackets: np.ndarray, order: np.ndarray) -> bool:
        """Whether each token may follow the one before it."""
        b, t = self.bytes, self.tokens
        table = np.full(256, _PRIMITIVE, dtype=np.int8)
        for c, k in (("{", _OPEN_OBJECT), ("[", _OPEN_ARRAY), ("}", _CLOSE), ("]", _CLOSE), (",", _COMMA_T), (":", _COLON_T), ('"', _STRING)):
            table[ord(c)] = k
        kind = table[b[t]]
        step = np.zeros(t.size, dtype=np.int32)
        step[kind <= _OPEN_ARRAY], step[kind == _CLOSE] = 1, -1
        after = np.cumsum(step, dtype=np.int32)
        level = np.where(kind == _CLOSE, after + 1, after)  # of an opening bracket its own container, of others the one they stand in
        # The bracket that opened each token's container: the last opening one of that level before it.
        by = np.argsort(level, kind="stable")
        opened = np.where((kind[by] <= _OPEN_ARRAY), by, -1)
        holder = np.empty(t.size, dtype=np.int64)
        holder[by] = np.maximum.accumulate(np.where(opened >= 0, np.arange(by.size), -1))
        holder[by] = np.where(holder[by] >= 0, by[np.maximum(holder[by], 0)], -1)
        in_object = (level > 0) & (kind[np.maximum(holder, 0)] == _OPEN_OBJECT)
        # One value on top, and no commas or colons beside it.
        outside = after - np.where(step > 0, 1, 0) == 0
        outside &= kind != _CLOSE
        if int(outside.sum()) != 1 or kind[0] in (_CLOSE, _COMMA_T, _COLON_T):
            return False
        a, z, held = kind[:-1], kind[1:], in_object[:-1]
        begins = (z == _OPEN_OBJECT) | (z == _OPEN_ARRAY) | (z == _STRING) | (z == _PRIMITIVE)
        before = np.r_[np.int8(_CLOSE), a[:-1]] if a.size else a
        key = (a == _STRING) & ((before == _OPEN_OBJECT) | ((before == _COMMA_T) & held))
        if a.size:
            key[0] = False
        allowed = np.where(a == _OPEN_OBJECT, (z == _STRING) | (z == _CLOSE), False)
        allowed |= (a == _OPEN_ARRAY) & (begins | (z == _CLOSE))
        allowed |= (a == _COLON_T) & begins
        allowed |= (a == _COMMA_T) & np.where(held, z == _STRING, begins)
        allowed |= key & (z == _COLON_T)
        allowed |= ((a == _CLOSE) | (a == _PRIMITIVE) | ((a == _STRING) & ~key)) & ((z == _COMMA_T) | (z == _CLOSE))
        return bool(allowed.all())

    def next_token(self, at: np.ndarray) -> np.ndarray:
        """Position of the first token at or behind each position."""
        return self.tokens[np.minimum(np.searchsorted(self.tokens, at), self.tokens.size - 1)]

    def here(self, level: int) -> np.ndarray:
        if level not in self._here:
            self._here[level] = np.flatnonzero(self.level == level)
        return self._here[level]

    def members(self, level: int, spans: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[Members, np.ndarray]:
        """Members at ``level`` inside sorted, disjoint spans, and the number of each one's span."""
        here = self.here(level)
        p, k = self.pos[here], self.kind[here]
        c = np.flatnonzero(k == 3)
        at, end = p[c], p[c + 1] if c.size else p[:0]
        if spans is None:
            owner = np.zeros(at.size, dtype=np.int64)
        else:
            owner, keep = _within(at, *spans)
            at, end, owner = at[keep], end[keep], owner[keep]
        start = self.next_token(at + 1)
        return Members(at, end, self.bytes[start], start), owner

    def elements(self, level: int, spans: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Objects in the arrays at ``level`` inside sorted, disjoint spans: start, end, number of the span, place in it."""
        inner, own = self.here(level + 1), self.here(level)
        opens = self.pos[inner][self.kind[inner] == 1]
        opens = opens[self.bytes[opens] == ord("{")]
        owner, keep = _within(opens, *spans)
        opens, owner = opens[keep], owner[keep]
        commas = self.pos[own][self.kind[own] == 2]  # the place in the array is the number of its commas passed
        place = np.searchsorted(commas, opens) - np.searchsorted(commas, spans[0][owner])
        closes = self.pos[inner][self.kind[inner] == -1]
        end = closes[np.searchsorted(closes, opens)] + 1 if opens.size else opens
        return opens, end, owner, place

    def key_spans(self, m: Members) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each member's name, with its quotes."""
        q = np.searchsorted(self.quotes, m.at)
        return self.quotes[q - 2], self.quotes[q - 1] + 1

    def which(self, m: Members, wanted: tuple[str, ...]) -> np.ndarray:
        """Index into ``wanted`` of each member's name, -1 for others; compares bytes, decodes only escaped names."""
        start, end = self.key_spans(m)
        size = end - start - 2
        out = np.full(m.at.size, -1, dtype=np.int64)
        for i, name in enumerate(wanted):
            raw = np.frombuffer(name.encode(), dtype=np.uint8)
            at = np.flatnonzero(size == raw.size)
            if at.size:
                same = (self.bytes[start[at, None] + 1 + np.arange(raw.size)] == raw).all(axis=1)
                out[at[same]] = i
        if self.back.size:
            for k in np.flatnonzero(np.searchsorted(self.back, end) > np.searchsorted(self.back, start)):
                name = self.string(int(start[k]), int(end[k]))
                out[k] = wanted.index(name) if name in wanted else -1
        return out

    def string(self, start: int, end: int) -> str:
        raw = self.data[start:end]
        return clean(json.loads(raw)) if b"\\" in raw else raw[1:-1].decode("utf-8", "replace")

    def scalar(self, start: int, end: int) -> str | None:
        """A value as text: strings decoded, null as None, others as written."""
        raw = self.data[start:end].strip()
        if raw == b"null":
            return None
        return self.string(start, start + len(raw)) if raw[:1] == b'"' else raw.decode("utf-8", "replace")

    def names(self, m: Members) -> list[str]:
        start, end = self.key_spans(m)
        return [self.string(a, b) for a, b in zip(start.tolist(), end.tolist(), strict=True)]

    def last_of_name(self, m: Members, owner: np.ndarray) -> tuple[Members, np.ndarray, list[str]]:
        """Where an object repeats a name, its last member counts."""
        names = self.names(m)
        last = {(o, n): i for i, (o, n) in enumerate(zip(owner.tolist(), names, strict=True))}
        if len(last) == len(names):
            return m, owner, names
        keep = np.array(sorted(last.values()))
        return m.pick(keep), owner[keep], [names[i] for i in keep]


def _within(at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the span each position lies in, and whether it lies in one."""
    owner = np.searchsorted(starts, at, side="right") - 1
    keep = owner >= 0
    if starts.size:
        keep &= at < np.where(keep, ends[np.maximum(owner, 0)], 0)
    return owner, keep

"""Several values packed in one field, split by a parsing expression grammar.

    list      <- item (sep item)*
    item      <- blank* (quoted / bracketed / bare)
    quoted    <- mark (doubled / escape / other)* mark &stop
               / mark (doubled / other)* mark &stop
    bracketed <- '[' list ']' &stop
    bare      <- (fraction / !sep .)*
    stop      <- blank* (sep / end), inside brackets also blank* ']'

Alternatives are tried in order. A quote or bracket that isn't closed before a
separator or the end fails its rule; the parser backtracks and reads the text
as `bare`, with the error flag set for a stray quote.

Every rule is tried at most once at a position: results are kept in a table
(packrat) that is filled from the text's end to its start. What a rule needs
always lies to its right, so there is no recursion and no limit of depth, and
the work is linear in the text, however malformed it is.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from pricewright.runtime import arrow_map


class Grammar:
    """The grammar of a packed field. words: values hold no white space, so
    white space separates them too (option codes)."""

    def __init__(self, words: bool) -> None:
        sep = r"[^\S\n\r]*+(?:[,;|\n\r]|(?<!\d)/|/(?!\d))\s*+" + (r"|\s++(?=\S)" if words else "")
        apart = r",;|\n\r" + (r"\s" if words else "")
        self.sep = re.compile(sep).match
        # Terminals: a text in marks with its body, tried with escapes first.
        forms = [rf"({q})((?:{q}{q}|\\.|[^{q}\\])*+){q}" for q in "\"'"] + [rf"({q})((?:{q}{q}|[^{q}])*+){q}" for q in "\"'"]
        self.quoted = {inside: [re.compile(rf"\s*{f}(?={sep}|\s*\Z{r'|\s*\]' if inside else ''})", re.S).match for f in forms] for inside in (False, True)}
        self.blanks = re.compile(r"[ \t]*").match
        # Where a bare text ends at the latest: a slash between digits doesn't end it.
        self.edge = {inside: re.compile(rf"[{apart}{r'\]' if inside else ''}]|(?<!\d)/|/(?!\d)").search for inside in (False, True)}
        self.edges = re.compile(rf"[{apart}\]]|(?<!\d)/|/(?!\d)").finditer
        self.opening, self.closing, self.end = (re.compile(p).match for p in (r"\s*\[", r"\s*\]", r"\s*\Z"))
        # Where an item can start: after a bracket, or after a separator and all blanks behind it.
        self.starts = re.compile(rf"\A|(?<=\[)|(?<=[{apart}/\s])(?!\s)").finditer

    def _terminal(self, s: str, i: int, inside: bool) -> tuple[int, str] | None:
        """A quoted text at i: where it ends and its value."""
        for match in self.quoted[inside]:
            if m := match(s, i):
                q, body = m[1], m[2].replace(m[1] * 2, m[1])
                return m.end(), re.sub(r"\\([\"'\\/])", r"\1", body) if "\\" in body else body
        return None

    def _table(self, s: str) -> tuple[dict, dict, dict]:
        """Of every place inside brackets its item, (end, value or None, inner
        list or -1), where the list from it on ends and the item that follows;
        and the bracketed lists, as (end, place of the first item)."""
        item: dict[int, tuple[int, str | None, int]] = {}
        tail: dict[int, tuple[int, int]] = {}
        lists: dict[int, tuple[int, int]] = {}
        edges = [m.start() for m in self.edges(s)]
        marked = '"' in s or "'" in s
        ends: dict[int, int] = {}  # of a place behind an item, where the separator there ends
        for i in reversed(list(dict.fromkeys(m.start() for m in self.starts(s)))):
            o = self.opening(s, i)
            if o and o.end() in tail and (c := self.closing(s, tail[o.end()][0])):
                after = c.end()
                if self.sep(s, after) or self.end(s, after) or self.closing(s, after):
                    lists[i] = (after, o.end())
            if marked and (t := self._terminal(s, i, True)):
                item[i] = (*t, -1)
            elif i in lists:
                item[i] = (lists[i][0], None, lists[i][1])
            else:
                k = bisect_left(edges, self.blanks(s, i).end())
                item[i] = (edges[k] if k < len(edges) else len(s), None, -1)
            end = item[i][0]
            if end not in ends:
                m = self.sep(s, end)
                ends[end] = m.end() if m else -1
            following = ends[end] if ends[end] in tail else -1
            tail[i] = (tail[following][0] if following >= 0 else item[i][0], following)
        return item, tail, lists

    def split(self, s: str) -> list[tuple[str, bool]]:
        """The values of a text, as (text, malformed), blank ones left out."""
        out: list[tuple[str, bool]] = []

        def emit(text: str, stray: bool) -> None:
            if text := text.strip():
                out.append((text, stray and '"' in text))

        item, tail, lists = self._table(s) if "[" in s else ({}, {}, {})
        marked, edge, i = '"' in s or "'" in s, self.edge[False], 0
        while True:
            if marked and (t := self._terminal(s, i, False)):
                i, text = t
                emit(text, False)
            elif i in lists and (self.sep(s, lists[i][0]) or self.end(s, lists[i][0])):
                stack = [lists[i][1]]
                while stack:
                    at = stack.pop()
                    end, text, inner = item[at]
                    if tail[at][1] >= 0:
                        stack.append(tail[at][1])
                    if inner >= 0:
                        stack.append(inner)
                    else:
                        emit(s[at:end] if text is None else text, text is None)
                i = lists[i][0]
            else:
                m = edge(s, self.blanks(s, i).end())
                end = m.start() if m else len(s)
                emit(s[i:end], True)
                i = end
            m = self.sep(s, i)
            if not m:
                return out
            i = m.end()


_GRAMMARS: dict[bool, Grammar] = {}


def split_values(text: str, words: bool = False) -> tuple[tuple[str, bool], ...]:
    """The values of a packed text, trimmed and without their enclosing quotes;
    blank values are left out. The flag tells of a malformed quote."""
    g = _GRAMMARS.get(words) or _GRAMMARS.setdefault(words, Grammar(words))
    return tuple(g.split(text))


_TOKEN = re.compile(r"""\s*(?:([{}\[\]:,])|"((?:\\.|[^"\\])*)"|'((?:\\.|[^'\\]|'(?!\s*[,:}\]]))*)'|([^\s{}\[\]:,"']+))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _plain(s: str) -> str:
    return re.sub(r"\\(u([0-9a-fA-F]{4})|.)", lambda m: chr(int(m[2], 16)) if m[2] else _ESCAPES.get(m[1], m[1]), s, flags=re.S) if "\\" in s else s


def object_lists(text: str, keys: tuple[str, ...]) -> dict[str, list[str]]:
    """The strings under the keys of an object in JSON or literal notation,
    flat, in order. Text that breaks off gives what stood before the break."""
    out: dict[str, list[str]] = {k: [] for k in keys}
    depth, key, want = 0, None, True
    for m in _TOKEN.finditer(text):
        mark, value = m[1], next((g for g in m.groups()[1:] if g is not None), None)
        if mark in ("{", "["):
            depth += 1
            want = want and mark == "{" and depth == 1
        elif mark in ("}", "]"):
            depth -= 1
        elif mark == "," and depth == 1:
            key, want = None, True
        elif mark == ":" and depth == 1:
            want = False
        elif value is not None:
            if want and depth == 1:
                key = _plain(value).strip().lower()
            elif key in out and not (m[4] and value.lower() in ("null", "none")):
                out[key].append(_plain(value))
    return out


def _rows(kind: str) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text is None:
                    continue
                fields = {"options": [text]} if kind == "options" else object_lists(text, ("requires", "excludes"))
                for field, texts in fields.items():
                    n = 0
                    for t in texts:
                        for v, bad in split_values(t, kind != "options"):
                            n += 1
                            for c, x in zip(cols, (rid, field, n, v, bad)):
                                c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.bool_()))], names=["record_id", "field_name", "value_no", "value", "malformed"])

    return run


_SCHEMA = "record_id bigint, field_name string, value_no int, value string, malformed boolean"


def split_options(df: DataFrame, key: str, field: str) -> DataFrame:
    """(record_id, field_name, value_no, value, malformed): one row per value of
    a packed text column. Null, empty and blank fields give no rows; repeated
    values keep their own positions; one row in, its rows out, no shuffle."""
    return arrow_map(df.select(key, field), _rows("options"), _SCHEMA)


def split_constraints(df: DataFrame, key: str, field: str) -> DataFrame:
    """As split_options, for the requires and excludes entries of a text that
    holds an object. Entries may be lists, packed texts, or lists of those."""
    return arrow_map(df.select(key, field), _rows("constraints"), _SCHEMA)

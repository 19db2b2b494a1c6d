"""Evaluation texts that leak into a corpus, found by Wu-Manber search.

Texts are reduced to a stream of their letters and digits: invisible
characters go, compatibility forms and letter case are folded, punctuation and
spacing fall away; where words begin is kept aside. Every run of 12 words of
an item (24 characters, where an item is Chinese) is a pattern. The search
looks at the block that ends a window of the shortest pattern's length: a shift
table tells how far the window may jump, a hash of the suffix block selects the
patterns that may end there, and a direct comparison confirms them.

The items are the stated query set and go to the workers in blocks of bounded
size by broadcast, each against all documents, which are read once per block.
Documents that come in few splits are spread over the cores first.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, islice

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.runtime import arrow_map, spread

#: Items compiled at once, whatever there are.
ITEMS_PER_BLOCK = 20_000


@lru_cache(maxsize=1)
def _mark_ranges() -> tuple[tuple[int, int], ...]:
    """Runs of characters of the categories Mn, Mc and Me."""
    runs = [list(run) for mark, run in groupby(range(sys.maxunicode + 1), lambda c: unicodedata.category(chr(c))[0] == "M") if mark]
    return tuple((r[0], r[-1]) for r in runs)


_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff]")
# Combining marks belong to the word they stand in (vowel signs, harakat, tone
# marks); without them a Devanagari or Thai word would fall into syllables.
_MARKS = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _mark_ranges())
_HAS_NONE = frozenset(chr(c) for a, b in _mark_ranges() for c in range(a, b + 1)).isdisjoint
_MARKED = re.compile(rf"[㐀-䶿一-鿿豈-﫿]|(?:[^\W_㐀-䶿一-鿿豈-﫿]++|[{_MARKS}])+")
_WORDS = re.compile(r"[㐀-䶿一-鿿豈-﫿]|[^\W_㐀-䶿一-鿿豈-﫿]+")
_HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿]")


def words_of(text: str) -> list[str]:
    """The words of a text in comparison form; Chinese characters are words."""
    if text.isascii():
        return _WORDS.findall(text.casefold())
    text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).casefold()
    return (_WORDS if _HAS_NONE(text) else _MARKED).findall(text)


class WuManber:
    """Multi-pattern search over streams; patterns map to the items that have them."""

    def __init__(self, patterns: dict[str, set[int]], block: int) -> None:
        self.length = m = min(map(len, patterns), default=0)
        self.block = b = min(block, m)
        self.far = m - b + 1
        self.shift: dict[str, int] = {}
        self.bucket: dict[str, list[str]] = {}
        self.items = patterns
        for p in patterns:
            for end in range(b, m + 1):
                key = p[end - b : end]
                if self.shift.get(key, self.far) > m - end:
                    self.shift[key] = m - end
            self.bucket.setdefault(p[m - b : m], []).append(p)

    def search(self, stream: str) -> Iterator[tuple[str, int]]:
        """(pattern, start) of every occurrence."""
        m, b, far = self.length, self.block, self.far
        shift, bucket = self.shift.get, self.bucket
        at, n = m, len(stream)
        if not self.items:
            return
        while at <= n:
            key = stream[at - b : at]
            jump = shift(key, far)
            if jump:
                at += jump
                continue
            start = at - m
            for p in bucket[key]:
                if stream.startswith(p, start):
                    yield p, start
            at += 1


@lru_cache(maxsize=4)
def compile_items(items: tuple[tuple[int, str], ...], run: int = 12, han_run: int = 24) -> tuple[WuManber, WuManber]:
    """Searches for items in words and for items in Chinese."""
    spaced: dict[str, set[int]] = {}
    han: dict[str, set[int]] = {}
    for item, text in items:
        words = words_of(text)
        stream = "".join(words)
        if 2 * len(_HAN.findall(stream)) > len(stream):
            for i in range(len(stream) - han_run + 1):
                han.setdefault(stream[i : i + han_run], set()).add(item)
        else:
            for i in range(len(words) - run + 1):
                spaced.setdefault("".join(words[i : i + run]), set()).add(item)
    return WuManber(spaced, 10), WuManber(han, 4)


def leaks_of(text: str, searches: tuple[WuManber, WuManber]) -> set[int]:
    """Items a text shares a run with. Runs of words begin and end with words."""
    words = words_of(text)
    stream = "".join(words)
    found: set[int] = set()
    spaced, han = searches
    edges: set[int] | None = None
    for p, start in spaced.search(stream):
        if not spaced.items[p] <= found:
            if edges is None:
                at, edges = 0, {0}
                for w in words:
                    at += len(w)
                    edges.add(at)
            if start in edges and start + len(p) in edges:
                found |= spaced.items[p]
    for p, _ in han.search(stream):
        found |= han.items[p]
    return found


def _scan(items: Broadcast, run: int, han_run: int):
    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        searches = compile_items(items.value, run, han_run)
        for b in batches:
            docs, hits = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for item in sorted(leaks_of(text, searches)) if text else ():
                    docs.append(doc)
                    hits.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hits, pa.int64())], names=["doc_id", "item_id"])

    return scan


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", run: int = 12, han_run: int = 24) -> DataFrame:
    """(doc_id, item_id): every document with the items it leaks.

    Null and empty texts share nothing, nor do items shorter than a run; rows
    that repeat count once; no items give no rows."""
    rows = ((int(i), t) for i, t in items.where(F.col(item_text).isNotNull() & F.col(item_key).isNotNull()).select(item_key, item_text).toLocalIterator())
    out: DataFrame | None = None
    docs = spread(documents.where(F.length(text) >= min(run, han_run)).select(F.col(key).cast("bigint"), text))
    context = documents.sparkSession.sparkContext
    while (block := tuple(islice(rows, ITEMS_PER_BLOCK))) or out is None:
        part = arrow_map(docs, _scan(context.broadcast(block), run, han_run), "doc_id bigint, item_id bigint")
        out = part if out is None else out.unionByName(part)
        if not block:
            break
    return out.distinct()

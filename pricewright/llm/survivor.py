"""The best representative of each group of duplicates, field by field.

Groups are equal scan keys of the sku. One surviving record comes out of a
group, whose fields, the sku among them, are the group's consensus, and with it
which row is kept (most trusted, most complete, first) and how many of its
fields every row has right. The consensus of a field is made by progressive
alignment of the distinct values' tokens (a sku's are its characters), heaviest
value first; tokens vote with their values' weight in every column of the
alignment, and the existing value closest to the winning tokens is emitted.

Values are counted per group and field before anything is gathered, so exact
copies cost nothing. A field with more than CHUNK distinct values in a group
is aligned in chunks of about that many; the chunks' alignments, with all votes
of their columns, are aligned again, twice, and only then do columns name their
winners. Every value, not only those of one chunk, then competes for being the
closest. The last task of a hot group holds the distinct tokens of its columns.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.functions.keys import plain_sku, scan_key
from pricewright.runtime import arrow_map, cut

#: Distinct values aligned at once.
CHUNK = 64

#: What counts as a filled value of a row; the sku, which every row of a group has, is a field besides.
FIELDS = ["description", "base_price", "finish", "finish_description", "options"]
ALL = ["sku", *FIELDS]
_TOKEN = re.compile(r"\w+|[^\w\s]")


def confidence(c: Column) -> Column:
    """Confidence from 0 to 1: above 1 it is a percentage, null counts as 0."""
    c = F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    return F.when(c > 1, c / 100).otherwise(c)


def _filled(name: str) -> Column:
    c = F.col(name).cast("string")
    return F.coalesce((F.length(F.regexp_replace(c, r"[\s\p{Z}]+", "")) > 0) & (F.lower(c) != "nan"), F.lit(False))


def ranked(df: DataFrame) -> DataFrame:
    """Rows with their group, the rank that decides who is kept, and their fields."""
    full = sum((_filled(c).cast("int") for c in FIELDS), F.lit(0))
    return df.where(F.col("export_id").isNotNull()).select(
        F.col("export_id").cast("bigint").alias("export_id"), scan_key(F.col("sku")).alias("grp"),
        F.struct(F.round(confidence(F.col("confidence")), 9).alias("conf"), full.alias("full"), (-F.col("export_id")).alias("neg_id")).alias("rank"),
        plain_sku(F.col("sku")).alias("sku"), *(F.when(_filled(c), F.col(c).cast("string")).alias(c) for c in FIELDS),
    ).where(F.col("grp").isNotNull())


def tokens_of(value: str, field: str = "") -> tuple[str, ...]:
    """Tokens of a value in comparison form."""
    return tuple(value) if field == "sku" else tuple(_TOKEN.findall(value.casefold()))


#: Scores are whole numbers of a unit, so sums of them are exact in any order.
_ONE = 10**9
_GAP, _MISS = -0.4, -0.6
#: Alignments of more cells than this run on arrays, row by row.
_CELLS = 4096
#: Rows kept at once on the way back through a long alignment.
_ROWS = 32
#: Tokens of one block of the edit distance.
_BLOCK = 8192


def _filled_shares(columns: list[dict[str, float]]) -> list[float]:
    """Of each column, the share of votes that are for a token, not for a gap."""
    return [1.0 - c.get("", 0) / (sum(c.values()) or 1.0) for c in columns]


def _similar(share, a: float, b, pooled: bool):  # noqa: ANN001, ANN202
    """Score of a pair of columns, of numbers or arrays: the share of votes that
    agree; if pooled, less what the votes that don't agree cost."""
    return share + _MISS * (a * b - share) + _GAP * (a + b - 2 * a * b) if pooled else share


def _align(columns: list[dict[str, float]], seq: list[dict[str, float]], pooled: bool = False) -> list[tuple[int, int]]:
    """Needleman-Wunsch of an alignment's columns with a sequence of votes:
    pairs of positions, -1 for a gap. Matching a column scores the share of its
    votes for the tokens; a gap or a mismatch costs. Pooled is for two
    alignments: all pairs of votes count, so that skipping a column which is
    mostly gaps costs little."""
    n, m = len(columns), len(seq)
    totals = [sum(c.values()) or 1.0 for c in columns]
    places: dict[str, tuple[list[int], list[float]]] = defaultdict(lambda: ([], []))
    for j, votes in enumerate(seq):
        total = sum(votes.values()) or 1.0
        for t, w in votes.items():
            if t:
                places[t][0].append(j)
                places[t][1].append(w / total)
    pa, pb = _filled_shares(columns), _filled_shares(seq)
    down, along = ([round(_GAP * (x if pooled else 1) * _ONE) for x in p] for p in (pa, pb))
    if n * m > _CELLS:
        return _align_long(columns, totals, seq, dict(places), pa, pb, down, along, pooled)
    score, sims = [list(accumulate(along, initial=0))], []
    for col, total, a, gap in zip(columns, totals, pa, down):
        share = [0.0] * m
        for t, w in col.items():
            if t in places:
                for j, q in zip(*places[t]):
                    share[j] += w / total * q
        sim, up = [round((_similar(s, a, b, pooled) if pooled or s > 0 else _MISS) * _ONE) for s, b in zip(share, pb)], score[-1]
        row = [left := up[0] + gap]
        for j in range(m):
            row.append(left := max(up[j] + sim[j], up[j + 1] + gap, left + along[j]))
        score.append(row)
        sims.append(sim)
    pairs, i, j = [], n, m
    while i or j:
        if i and j and score[i][j] == score[i - 1][j - 1] + sims[i - 1][j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif i and score[i][j] == score[i - 1][j] + down[i - 1]:
            i -= 1
            pairs.append((i, -1))
        else:
            j -= 1
            pairs.append((-1, j))
    return pairs[::-1]


def _align_long(
    columns: list[dict[str, float]], totals: list[float], seq: list[dict[str, float]], places: dict[str, tuple[list[int], list[float]]],
    pa: list[float], pb: list[float], down: list[int], along: list[int], pooled: bool,
) -> list[tuple[int, int]]:
    """The same alignment as _align's in a band around the diagonals, doubled
    until no path that leaves it can score as much. Few rows are kept; those
    between are worked out again on the way back."""
    import numpy as np

    n, m = len(columns), len(seq)
    spots = {t: (np.array(js), np.array(qs)) for t, (js, qs) in places.items()}
    # The most that so many matches can score, by columns and by the sequence.
    tops = []
    for votes in (columns, seq):
        best = sorted((int(max((w for t, w in v.items() if t), default=0.0) / (sum(v.values()) or 1.0) * _ONE) + 2 for v in votes), reverse=True)
        tops.append(np.concatenate([[0], np.cumsum(np.array(best, "int64"))]))
    # The least that so many gaps cost.
    least = [np.concatenate([[0], np.cumsum(np.array(sorted(g, reverse=True), "int64"))]) for g in (down, along)]
    reach = np.concatenate([[0], np.cumsum(np.array(along, "int64"))])
    k = 32
    while True:
        lo, hi = min(0, m - n) - k, max(0, m - n) + k
        width = hi - lo + 1
        j = np.arange(lo, n + hi + 1)
        ramps, filled = reach[j.clip(0, m)], np.array(pb)[(j - 1).clip(0, m - 1)]

        def step(i: int, up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Row i, whose places are j = i + lo on, from the row before it."""
            share, at = np.zeros(width), i - 1 + lo  # noqa: B023
            for t, w in columns[i - 1].items():
                if t in spots:
                    js, qs = spots[t]
                    a, b = np.searchsorted(js, (at, at + width))  # noqa: B023
                    if a < b:
                        share[js[a:b] - at] += w / totals[i - 1] * qs[a:b]
            sim = _similar(share, pa[i - 1], filled[i : i + width], pooled)  # noqa: B023
            sim = np.rint((sim if pooled else np.where(share > 0, sim, _MISS)) * _ONE).astype("int64")
            row, ramp = up + sim, ramps[i : i + width]  # noqa: B023
            np.maximum(row[:-1], up[1:] + down[i - 1], out=row[:-1])
            return np.maximum.accumulate(row - ramp) + ramp, sim

        top = np.where(j >= 0, ramps, -(1 << 60))[:width].astype("int64")
        row = top
        for i in range(1, n + 1):
            row = step(i, row)[0]
        left = min(n, m) - k - 1  # matches of a path that leaves the band
        if left < 0 or row[m - n - lo] > min(int(t[left]) for t in tops) + int(least[0][n - left] + least[1][m - left]):
            break
        k *= 2
    pairs: list[tuple[int, int]] = []

    def back(top: np.ndarray, i0: int, i: int, j: int) -> int:
        """From (i, j) back to row i0, which is top; the j reached there."""
        if i - i0 > _ROWS:
            part = -(-(i - i0) // _ROWS)
            starts, kept, row = range(i0, i, part), [top], top
            for r in range(i0 + 1, starts[-1] + 1):
                row = step(r, row)[0]
                if (r - i0) % part == 0:
                    kept.append(row)
            for start in reversed(starts):
                j = back(kept.pop(), start, min(start + part, i), j)
            return j
        rows, sims = [top], [top]
        for r in range(i0 + 1, i + 1):
            row, sim = step(r, rows[-1])
            rows.append(row)
            sims.append(sim)
        while i > i0:
            x, up = j - i - lo, rows[i - i0 - 1]
            here = rows[i - i0][x]
            if j and here == up[x] + sims[i - i0][x]:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif x + 1 < width and here == up[x + 1] + down[i - 1]:
                i -= 1
                pairs.append((i, -1))
            else:
                j -= 1
                pairs.append((-1, j))
        return j

    j = back(top, 0, n, m)
    pairs.extend((-1, x) for x in range(j - 1, -1, -1))
    return pairs[::-1]


def merged(profiles: list[tuple[list[dict[str, float]], float]], pooled: bool = True) -> tuple[list[dict[str, float]], float]:
    """One alignment of several, each its columns' votes and the weight it stands
    for, joined in the given order. No vote is lost: every column holds the votes
    of all, a gap's as those for the empty token."""
    columns, done = profiles[0] if profiles else ([], 0)
    for other, weight in profiles[1:]:
        joined: list[dict[str, float]] = []
        for i, j in _align(columns, other, pooled):
            col = dict(columns[i]) if i >= 0 else {"": done}
            for t, w in (other[j] if j >= 0 else {"": weight}).items():
                col[t] = col.get(t, 0) + w
            joined.append(col)
        columns, done = joined, done + weight
    return columns, done


def aligned(sequences: list[tuple[tuple[str, ...], float]]) -> tuple[list[dict[str, float]], float]:
    """The alignment of weighted token sequences and their total weight.
    Sequences join by weight, then length, then text."""
    order = sorted(sequences, key=lambda s: (-s[1], -len(s[0]), s[0]))
    return merged([([{t: weight} for t in seq], weight) for seq, weight in order], pooled=False)


def winners(columns: list[dict[str, float]]) -> list[str]:
    """The tokens with most votes in their columns; ties go to a token before a gap, then to text."""
    best = (max(sorted(c), key=lambda t: (c[t], t != "")) for c in columns)
    return [t for t in best if t]


def majority(weights: dict[tuple[str, ...], int]) -> tuple[str, ...] | None:
    """The sequence that weighs more than all others together, if there is one.
    It wins every column it has a token in, and every other as a gap, however the
    rest is aligned, so it is the consensus and no alignment is needed."""
    best = max(weights, key=weights.__getitem__)
    return best if 2 * weights[best] > sum(weights.values()) else None


def profile(sequences: list[tuple[tuple[str, ...], float]]) -> tuple[list[str], float]:
    """Consensus tokens of weighted token sequences, and their total weight."""
    columns, done = aligned(sequences)
    return winners(columns), done


def distance(a: tuple[str, ...] | list[str], b: tuple[str, ...] | list[str]) -> int:
    """Edit distance of token sequences: Myers' bit vectors over blocks of a,
    after the common start and end."""
    start, end, least = 0, 0, min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    steps = [1] * len(b)  # from a column to the next, along the block's upper edge
    for at in range(0, len(a), _BLOCK):
        block = a[at : at + _BLOCK]
        places: dict[str, int] = defaultdict(int)
        for k, t in enumerate(block):
            places[t] |= 1 << k
        last = len(block) - 1
        full = (1 << len(block)) - 1
        plus, minus = full, 0
        for j, t in enumerate(b):
            eq, into = places.get(t, 0), steps[j]
            xv = eq | minus
            if into < 0:
                eq |= 1
            xh = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | ~(xh | plus) & full, plus & xh & full
            steps[j] = (up >> last & 1) - (down >> last & 1)
            up, down = (up << 1 | (into > 0)) & full, (down << 1 | (into < 0)) & full
            plus, minus = down | ~(xv | up) & full, up & xv
    return len(a) + sum(steps)


_SEP = "\x1f"


def _consensus(batches: Iterator) -> Iterator:
    """One alignment per (group, field, chunk) row with arrays of values and
    weights: texts at the first level, alignments as JSON at the next two; the
    last gives the winning tokens. Votes are whole millionths, so that their
    sums don't depend on the chunks."""
    import pyarrow as pa

    for b in batches:
        texts, weights = [], []
        for field, values, ws, level in zip(*(b.column(c).to_pylist() for c in ("field", "vals", "ws", "level"))):
            if level == 1:
                seqs: dict[tuple[str, ...], int] = defaultdict(int)
                for v, w in zip(values, ws):
                    seqs[tokens_of(v, field)] += round(w * 1e6)
                columns, weight = aligned(list(seqs.items()))
                text = json.dumps(columns, ensure_ascii=False)
            elif len(values) == 1 and level == 2:
                text, weight = values[0], ws[0]
            else:
                parts = sorted(((json.loads(v), round(w), v) for v, w in zip(values, ws)), key=lambda x: (-x[1], -len(x[0]), x[2]))
                columns, weight = merged([(c, w) for c, w, _ in parts])
                text = _SEP.join(winners(columns)) if level == 3 else json.dumps(columns, ensure_ascii=False)
            texts.append(text)
            weights.append(weight)
        yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("field"), b.column("up"), pa.array(texts, pa.string()), pa.array(weights, pa.float64())], names=["grp", "field", "up", "val", "w"])


def _distances(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        far = [distance(tokens_of(v, f), c.split(_SEP) if c else []) for f, v, c in zip(*(b.column(c).to_pylist() for c in ("field", "val", "consensus")))]
        yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("field"), b.column("val"), b.column("w"), pa.array(far, pa.int32())], names=["grp", "field", "val", "w", "far"])


def _choose(batches: Iterator) -> Iterator:
    """The whole of it for a group's field with few distinct values: alignment,
    winning tokens, distances, and the closest value."""
    import pyarrow as pa

    for b in batches:
        chosen = []
        for field, values, ws in zip(*(b.column(c).to_pylist() for c in ("field", "vals", "ws"))):
            tokens = [tokens_of(v, field) for v in values]
            seqs: dict[tuple[str, ...], int] = defaultdict(int)
            for t, w in zip(tokens, ws):
                seqs[t] += round(w * 1e6)
            agreed = majority(seqs)
            if agreed is None:
                agreed = winners(aligned(list(seqs.items()))[0])
            chosen.append(min((distance(t, agreed), -w, v) for t, w, v in zip(tokens, ws, values))[2])
        yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("field"), pa.array(chosen, pa.string())], names=["grp", "field", "value"])


def consensus_values(values: DataFrame) -> DataFrame:
    """(grp, field, value) for (grp, field, val, w) with distinct values: the
    existing value closest to the consensus; ties go to weight, then text.

    A group's field with at most CHUNK distinct values is one row of one pass;
    others, if there are any, go through the levels."""
    hot = values.groupBy("grp", "field").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    votes = F.array_sort(F.collect_list(F.struct("val", "w")))
    few = values.join(hot.select("grp", "field"), ["grp", "field"], "left_anti").groupBy("grp", "field").agg(votes.alias("v"))
    one = few.where(F.size("v") == 1).select("grp", "field", F.get("v", F.lit(0))["val"].alias("value"))
    several = few.where(F.size("v") > 1).select("grp", "field", F.col("v.val").alias("vals"), F.col("v.w").alias("ws"))
    several = arrow_map(several, _choose, "grp string, field string, value string")
    return one.unionByName(several).unionByName(_by_levels(values.join(hot, ["grp", "field"])))


def _by_levels(many: DataFrame) -> DataFrame:
    """The same for (grp, field, val, w, n) with more than CHUNK distinct values."""
    # Three levels of about CHUNK each hold CHUNK ** 3 distinct values.
    chunks = lambda size: F.greatest(F.lit(1), F.ceil(F.col("n") / size)).cast("int")
    first, second = chunks(CHUNK), chunks(CHUNK * CHUNK)
    h = F.pmod(F.xxhash64("val"), first)
    level = many.select("grp", "field", "val", "w", h.alias("at"), F.pmod(h, second).alias("up"), F.lit(1).alias("level"))
    kind = "grp string, field string, up bigint, val string, w double"

    def gather(d: DataFrame, key: list[str]) -> DataFrame:
        votes = F.array_sort(F.collect_list(F.struct("val", "w")))
        g = d.groupBy("grp", "field", *key, "level").agg(votes.alias("v"))
        return g.select("grp", "field", (F.col("up") if "up" in key else F.lit(0)).cast("bigint").alias("up"), F.col("v.val").alias("vals"), F.col("v.w").alias("ws"), "level")

    l1 = arrow_map(gather(level, ["at", "up"]), _consensus, kind)
    l2 = arrow_map(gather(l1.withColumn("level", F.lit(2)), ["up"]), _consensus, kind)
    l3 = arrow_map(gather(l2.withColumn("level", F.lit(3)), []), _consensus, kind)
    agreed = l3.select("grp", "field", F.col("val").alias("consensus"))
    near = arrow_map(many.select("grp", "field", "val", "w").join(agreed, ["grp", "field"]), _distances, "grp string, field string, val string, w double, far int")
    best = near.groupBy("grp", "field").agg(F.min(F.struct("far", (-F.col("w")).alias("neg"), "val")).alias("best"))
    return best.select("grp", "field", F.col("best.val").alias("value"))


def _survivors(rows: DataFrame) -> DataFrame:
    best = rows.groupBy("grp").agg(F.max("rank").alias("best"), F.min("export_id").alias("lo"), F.max("export_id").alias("hi"), F.count("*").alias("records"))
    best = best.where("lo < hi").select("grp", (-F.col("best.neg_id")).alias("export_id"), "records")
    stacked = rows.select("grp", F.col("rank.conf").alias("conf"), F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("val")) for c in ALL))).alias("f"))
    values = stacked.where(F.col("f.val").isNotNull()).groupBy("grp", F.col("f.field").alias("field"), F.col("f.val").alias("val")).agg(F.round(F.sum(F.col("conf") + 0.05), 6).alias("w"))
    # Read twice below; of a row per distinct value of a group, it is kept.
    values = cut(values.join(best.select("grp"), "grp", "left_semi"))
    chosen = consensus_values(values).groupBy("grp").agg(*(F.max(F.when(F.col("field") == c, F.col("value"))).alias(c) for c in ALL))
    # Every row of a group has a sku, so every group has a consensus.
    return best.join(chosen, "grp")


def survivors(df: DataFrame) -> DataFrame:
    """(grp, export_id, records, sku, *fields): one surviving record per group of
    two or more rows. export_id is the kept row's; each field is the consensus
    of the group's values, weighted by confidence, so that gaps are filled and
    misread characters outvoted. Fields without a value in the whole group stay
    null. Values are texts; the sku is its letters and digits."""
    return _survivors(ranked(df))


def verdicts(df: DataFrame) -> DataFrame:
    """(export_id, verdict, agrees) of every row in a group of two or more: how
    many fields it has as the surviving record has them, and keep for the best
    rank, drop for the others. The rank is checked exactly, as the verdict is
    defined by it. Rows without a sku belong to no group; copies with the same
    export_id are one row and form no group by themselves."""
    rows = ranked(df)
    kept = _survivors(rows).select("grp", F.col("export_id").alias("keeper"), F.struct(*ALL).alias("s"))
    agrees = sum((F.col(c).eqNullSafe(F.col(f"s.{c}")).cast("int") for c in ALL), F.lit(0))
    verdict = F.when(F.col("export_id") == F.col("keeper"), "keep").otherwise("drop")
    return rows.join(kept, "grp").groupBy("export_id", verdict.alias("verdict")).agg(F.max(agrees).alias("agrees"))

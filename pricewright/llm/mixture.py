"""Mixing sources to target weights.

Shares are tilted from what the sources have to what they should have: a
source's weight is its token share times (target / token share) to the power
of an exponent, normalised. Exponent 1 gives the targets, 0 the corpus as it
is. It is bisected: downwards to the largest exponent at which no source
has to be repeated more often than it may, or to the one whose weights have a
target entropy. Without a stated size the mixture is as large as its weights can be
met exactly under the repetition limits; without an entropy either, these are
the targets themselves.

The weights are realised as budgeted block permutations: documents fall into
blocks by hash, each block is permuted by hash and takes its part of the
source's budget, whole rounds first, then the head of one more permutation. A
source of any size is spread over its blocks; no document is used more than
one time more often than another of its block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.runtime import arrow_map, cut, spread

#: Documents per block, about.
BLOCK = 2048


def source_name(source: Column) -> Column:
    """A source's name regardless of case, blanks and kind of hyphen."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s\p{Z}_-]+", "_"), F.lit(""))


def _counter(vocabulary: str):
    def count(batches: Iterator) -> Iterator:
        import base64

        import pyarrow as pa
        import tiktoken

        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return count


def token_counts(documents: DataFrame, vocabulary: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """(doc_id, source, n_tokens) of whole texts by a public tokenizer, whose
    rank file must be on every worker. A null text has no tokens."""
    named = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source")).alias("source"), "text")
    return arrow_map(spread(named), _counter(vocabulary), "doc_id bigint, source string, n_tokens bigint")


@dataclass(frozen=True)
class Source:
    """What a source has and should give."""

    name: str
    tokens: int
    target: float
    max_repeats: int

    @property
    def live(self) -> bool:
        """Whether it can give anything: a limit of no repeats allows no use."""
        return self.tokens > 0 and self.target > 0 and self.max_repeats > 0


def tilted(sources: list[Source], exponent: float) -> list[float]:
    """Weights at an exponent; sources without tokens, target or allowed uses get none."""
    total = sum(s.tokens for s in sources) or 1
    live = sum(s.target for s in sources if s.live) or 1.0
    raw = [(s.tokens / total) * ((s.target / live) / (s.tokens / total)) ** exponent if s.live else 0.0 for s in sources]
    norm = sum(raw) or 1.0
    return [x / norm for x in raw]


def entropy(weights: list[float]) -> float:
    """Shannon entropy in nats."""
    return -sum(w * math.log(w) for w in weights if w > 0)


def _bisect(holds, lo: float, hi: float) -> float:
    """The largest exponent between lo, where it holds, and hi."""
    if holds(hi):
        return hi
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if holds(mid) else (lo, mid)
    return lo


def plan(sources: list[Source], size: int | None = None, target_entropy: float | None = None) -> tuple[float, float, list[float]]:
    """Exponent, size and token budgets of a mixture.

    A target entropy: the exponent, from 0 on, whose weights reach it. A size
    without one: the exponent is bisected to the repetition limits; if even the
    corpus' own shares break them, budgets are cut to what the limits allow. No
    size: the largest at which the weights hold exactly under the limits."""
    if not any(s.live for s in sources):
        return 1.0, 0.0, [0.0] * len(sources)
    limit = [s.tokens * s.max_repeats for s in sources]
    most = lambda e: min(c / x for c, x in zip(limit, tilted(sources, e)) if x > 0)
    if target_entropy is not None:
        sign = 1 if entropy(tilted(sources, 1.0)) >= entropy(tilted(sources, 0.0)) else -1
        e = _bisect(lambda x: sign * entropy(tilted(sources, x)) <= sign * target_entropy, 0.0, 1.0)
    else:
        e = 1.0 if size is None else _bisect(lambda x: most(x) >= size * (1 - 1e-12), 0.0, 1.0)
    total = most(e) if size is None else size
    return e, float(total), [float(min(x * total, c)) for x, c in zip(tilted(sources, e), limit)]


def mix(documents: DataFrame, targets: DataFrame, size: int | str | None = None, target_entropy: float | None = None, seed: int = 7, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture and the shares it reaches. size: tokens, or "corpus" for as
    many as the sources that can be used have.

    mixture: (source, doc_id, use_no, place, n_tokens), one row per use of a
    document; place orders the mixture and is a hash of the use. shares:
    (source, target_share, max_repeats, available_tokens, budget_tokens,
    mixed_tokens, share_reached, documents_used, most_uses, exponent), one row per
    target and per source that has none, which is not used. A target without
    documents reaches 0 and its share goes to the others in proportion. Empty
    texts have no size and are not used; repeated doc_ids count once."""
    counts = token_counts(documents, vocabulary) if vocabulary else token_counts(documents)
    counts = cut(counts.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("d")).select("doc_id", "d.source", "d.n_tokens"))
    have = counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    want = targets.where(source_name(F.col("source")).isNotNull()).groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target"), F.max("max_repeats").alias("max_repeats"))
    # One row per source of the target list, which is stated by hand.
    rows = want.join(have, "source", "left").orderBy("source").collect()
    sources = [Source(r.source, int(r.tokens or 0), float(r.target or 0), int(r.max_repeats or 0)) for r in rows]
    tokens = sum(s.tokens for s in sources if s.live) if size == "corpus" else size
    exponent, _, budgets = plan(sources, tokens, target_entropy)
    spark = documents.sparkSession
    schema = "source string, target_share double, max_repeats int, available bigint, docs bigint, budget double"
    table = F.broadcast(spark.createDataFrame([(s.name, s.target, s.max_repeats, s.tokens, int(r.docs or 0), b) for s, r, b in zip(sources, rows, budgets)], schema))

    used = counts.where("n_tokens > 0").join(table.where("budget > 0"), "source")
    place = lambda *x: F.xxhash64(F.lit(seed), *x)
    used = used.withColumn("block", F.pmod(place("doc_id"), F.ceil(F.col("docs") / BLOCK)))
    in_block = Window.partitionBy("source", "block")
    used = used.withColumn("here", F.sum("n_tokens").over(in_block))
    used = used.withColumn("budget_here", F.col("budget") * F.col("here") / F.col("available"))
    used = used.withColumn("rounds", F.floor(F.col("budget_here") / F.col("here") + 1e-9))
    order = in_block.orderBy(place("doc_id", "rounds"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = used.withColumn("upto", F.sum("n_tokens").over(order))
    rest = F.col("budget_here") - F.col("rounds") * F.col("here")
    # The document that crosses the budget is in if most of it fits.
    more = (F.col("upto") - F.col("n_tokens") / 2 <= rest) & (F.col("rounds") < F.col("max_repeats"))
    used = used.withColumn("uses", (F.col("rounds") + more.cast("int")).cast("int")).where("uses > 0")
    mixture = used.select("source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("use_no"), "n_tokens")
    mixture = mixture.select("source", "doc_id", "use_no", place("doc_id", "use_no").alias("place"), "n_tokens")
    got = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("mixed"), F.count("*").alias("documents_used"), F.max("uses").alias("most_uses"))
    # Sources without a target are named by the documents, in any number; the sum over all is a subquery.
    total = got.agg(F.sum("mixed")).scalar()
    everything = have.join(table.drop("available", "docs"), "source", "full").join(got, "source", "left")
    shares = everything.select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("available_tokens"), F.round(F.coalesce("budget", F.lit(0.0)), 3).alias("budget_tokens"), F.coalesce("mixed", F.lit(0)).alias("mixed_tokens"),
        (F.coalesce("mixed", F.lit(0)) / total).alias("share_reached"), F.coalesce("documents_used", F.lit(0)).alias("documents_used"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        F.lit(exponent).alias("exponent"),
    )
    return mixture, shares

"""Mixing sources to target shares (problem 8) by Sainte-Laguë apportionment of equal-token blocks.

The mixture is as large as all target shares allow: the source with the least tokens, copies
included, per share sets its size (or a size is given). It is cut into blocks of equal tokens, and
seat after seat goes to the source with the highest quotient share / (2 * seats + 1), so every shard,
a run of consecutive seats, gets an integer quota of blocks of each source. Each source's documents
stand in a seeded order; its blocks are consecutive stretches of that order, gone through at most
max_repeat times. Positions are prefix sums in two steps (fixed hash ranges, then inside a range),
so no source, however large, is sorted in one task.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklode.llm.tokens import VOCAB_DIR, with_token_counts
from tracklode.runtime import Scratch

#: Blocks of the whole mixture, shards they are dealt to, hash ranges of a source.
BLOCKS, SHARDS, RANGES = 10_000, 100, 8_192


def apportion(shares: dict[str, float], seats: int, most: dict[str, int] | None = None) -> list[str]:
    """Sainte-Laguë: the source of each seat in turn; a source that holds `most` seats drops out.

    Equal quotients go to the smaller name. Sources without a positive share get none; fewer seats
    are given out when all sources have dropped out.
    """
    queue = [(-p, s, 0) for s, p in shares.items() if p > 0 and (most is None or most.get(s, 0) > 0)]
    heapq.heapify(queue)
    out = []
    while queue and len(out) < seats:
        _, s, n = heapq.heappop(queue)
        out.append(s)
        n += 1
        if most is None or n < most[s]:
            heapq.heappush(queue, (-shares[s] / (2 * n + 1), s, n))
    return out


def _plan(scratch: Scratch, docs: DataFrame, targets: DataFrame, total_tokens: int | None, seed: int, vocab_dir: str, blocks: int, shards: int):
    goal = {r[0]: (float(r[1]), int(r[2])) for r in targets.select("source", "target_share", "max_repeat").dropna().collect()}  # one row per source
    sized = scratch.table(with_token_counts(docs.where(F.col("source").isin(list(goal))), ["doc_id", "source"], vocab_dir=vocab_dir).where("n_tokens > 0"))
    held = {r[0]: int(r[1]) for r in sized.groupBy("source").agg(F.sum("n_tokens")).collect()}
    shares = {s: p for s, (p, _) in goal.items() if held.get(s)}
    room = {s: held[s] * goal[s][1] for s in shares}
    total = total_tokens or int(min((room[s] / p for s, p in shares.items() if p > 0), default=0))
    block = max(1, total // blocks)
    seats = apportion(shares, max(1, round(total / block)) if total else 0, {s: -(-room[s] // block) for s in shares})
    quota: dict[str, int] = {}
    rows = []
    per = -(-len(seats) // shards) if seats else 1
    for at, s in enumerate(seats):
        rows.append((s, quota.get(s, 0), at // per))
        quota[s] = quota.get(s, 0) + 1
    return goal, sized, held, block, quota, rows


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 11, vocab_dir: str = VOCAB_DIR, blocks: int = BLOCKS, shards: int = SHARDS) -> DataFrame:
    """(doc_id, source, n_tokens, copy, block, shard): the documents of the mixture, one row per use.

    targets: source, target_share, max_repeat, one row per source. Each source contributes its share
    of the blocks, so the tokens of a source differ from its target by one block and one document at
    most, unless `total_tokens` asks for more than its copies hold. copy counts from 1 to max_repeat.
    Documents of other or null sources and null or empty texts are not used; empty tables give no
    rows. Sizes are tokens of byte_bpe_50k.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mixture")
    goal, sized, held, block, quota, seats = _plan(scratch, docs, targets, total_tokens, seed, vocab_dir, blocks, shards)
    per_source = spark.createDataFrame([(s, held[s], goal[s][1], quota[s] * block) for s in quota], "source string, _held bigint, _most int, _quota bigint")
    h = F.xxhash64("doc_id", F.lit(seed))
    keyed = sized.withColumn("_h", h).withColumn("_range", F.pmod(h, F.lit(RANGES)))
    sums = keyed.groupBy("source", "_range").agg(F.sum("n_tokens").alias("_n"))  # RANGES rows a source
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_range")) - F.col("_n")
    sums = sums.select("source", "_range", before.alias("_base"))
    within = F.sum("n_tokens").over(Window.partitionBy("source", "_range").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    # one row a source and range: joined on the partitioning the window needs anyway
    placed = keyed.withColumn("_in", within).join(sums.hint("merge"), ["source", "_range"]).join(F.broadcast(per_source), "source")  # one row a source
    # a use of a document starts at (copy - 1) * tokens of its source + its own position
    start = F.col("_held") * (F.col("copy") - 1) + F.col("_base") + F.col("_in")
    uses = placed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_most")))).withColumn("_at", start).where(F.col("_at") < F.col("_quota"))
    uses = uses.select("doc_id", "source", "n_tokens", "copy", F.floor(F.col("_at") / block).cast("int").alias("block"))
    dealt = spark.createDataFrame(seats, "source string, block int, shard int")  # at most `blocks` rows
    return uses.join(F.broadcast(dealt), ["source", "block"]).select("doc_id", "source", "n_tokens", "copy", "block", "shard")


def shares(docs: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_documents, n_uses, most_copies) of the mixture;
    a source that adds nothing has zeros."""
    used = mixture(docs, targets, **options)
    per = used.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("_t"), F.count("*").alias("_c"))
    got = per.groupBy("source").agg(F.sum("_t").alias("n_tokens"), F.count("*").alias("n_documents"), F.sum("_c").alias("n_uses"), F.max("_c").alias("most_copies"))
    whole = F.sum("n_tokens").over(Window.partitionBy())  # one row per source
    rows = targets.select("source", "target_share").join(got, "source", "left").na.fill(0, ["n_tokens", "n_documents", "n_uses", "most_copies"])
    return rows.select("source", "target_share", F.coalesce(F.col("n_tokens") / F.nullif(whole, F.lit(0)), F.lit(0.0)).alias("actual_share"), "n_tokens", "n_documents", "n_uses", "most_copies")

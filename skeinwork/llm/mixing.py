"""A mixture of sources in target shares of all tokens.

The size of the mixture is counted in equal blocks of tokens. Blocks are apportioned to
the sources by highest quotients (Sainte-Laguë), and those of a source again to its
shards. Within a shard the documents, in an order given by the seed, are cut into blocks of
equal tokens, a document belonging to the block that its middle lies in. A shard's quota
is filled by whole passes over its blocks and by a run of consecutive blocks that starts at a
block drawn by the seed: only the two ends of a run can miss the quota, by half a document each.
"""

from __future__ import annotations

import heapq

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm.tokenize import FOLDER, token_counts
from skeinwork.runtime import hinted, stored

#: Documents of a shard, about; the table of targets times the shards is what the driver sees.
SHARD_DOCUMENTS = 500_000


def plain_source(source: Column) -> Column:
    return F.lower(F.trim(source))


def sainte_lague(weights: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats to parties by the highest quotients weight / (2 held + 1), none above its ``most``.

    Starts from whole shares, which highest quotients exceed or miss by few, so the
    work does not grow with the number of seats."""
    n, total = len(weights), sum(weights)
    most = most if most is not None else [seats] * n
    if total <= 0 or seats <= 0:
        return [0] * n
    held = [min(m, max(0, int(w / total * seats) - 2)) for w, m in zip(weights, most)]
    queue = [(-w / (2 * h + 1), i) for i, (w, h, m) in enumerate(zip(weights, held, most)) if h < m and w > 0]
    heapq.heapify(queue)
    left = seats - sum(held)
    while left > 0 and queue:
        i = heapq.heappop(queue)[1]
        # what capped parties cannot take is dealt in large steps first
        step = max(1, min(most[i] - held[i], int(left * weights[i] / total) - 2))
        held[i] += step
        left -= step
        if held[i] < most[i]:
            heapq.heappush(queue, (-weights[i] / (2 * held[i] + 1), i))
    return held


class Mixture:
    """``rows``: doc_id, source, tokens, times_used of the documents used; ``shares``: per target
    source its target share and what is really reached.

    Sources are compared by lower-case name without blanks around it; documents of
    other sources, or null, are not used, nor those without tokens (null and empty texts). A target
    without documents gets nothing, and the others keep their proportions. Without
    ``total_tokens`` the mixture is as large as the scarcest source allows in its
    ``max_repeats`` uses; with it, a source that cannot reach its share gives all it has and
    falls short in the report. Repeated rows of a document count once; duplicate texts under
    other ids are other documents. ``shards`` follows from the number of documents unless it is given.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block: int = 256, shards: int | None = None, seed: int = 7, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = FOLDER):
        named = targets.select(plain_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
        named = named.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        goals = {r.source: r for r in named.collect()}
        docs = documents.select("doc_id", plain_source(F.col("source")).alias("source"), "text").where(F.col("source").isin(list(goals)) & F.col("doc_id").isNotNull())
        sizes = token_counts(docs, vocabulary=vocabulary, folder=folder).where("tokens > 0").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
        sources = docs.groupBy("doc_id").agg(F.min("source").alias("source"))
        sized = stored(sizes.join(sources, "doc_id").select("doc_id", "source", "tokens"), "sized")
        if shards is None:
            shards = max(16, -(-sized.count() // SHARD_DOCUMENTS))
        sized = sized.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(shards)).cast("int"))
        per = {(r.source, r.shard): r.tokens for r in sized.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens")).collect()}
        have = {s: sum(t for (x, _), t in per.items() if x == s) for s in goals}
        fed = [s for s in sorted(goals) if have[s] > 0 and goals[s].target_share and goals[s].target_share > 0]
        share = {s: goals[s].target_share / sum(goals[x].target_share for x in fed) for s in fed}
        supply = {s: have[s] * goals[s].max_repeats for s in fed}
        reach = min((supply[s] / share[s] for s in fed), default=0.0)
        blocks = int((reach if total_tokens is None else total_tokens) / block)
        blocks_of = dict(zip(fed, sainte_lague([share[s] for s in fed], blocks, [supply[s] // block for s in fed])))
        quotas = []
        for s in fed:
            mine = sorted(k for x, k in per if x == s)
            held = sainte_lague([per[s, k] for k in mine], blocks_of[s], [-(-per[s, k] * goals[s].max_repeats // block) for k in mine])
            for k, h in zip(mine, held):
                blocks_in = max(1, round(per[s, k] / block))
                first = xxhash.xxh3_64_intdigest(f"{seed}/{s}/{k}") % blocks_in
                quotas.append((s, k, per[s, k] / blocks_in, blocks_in, h // blocks_in, h % blocks_in, first, goals[s].max_repeats))
        spark = documents.sparkSession
        plan = hinted(spark.createDataFrame(quotas, "source string, shard int, size double, blocks long, passes long, rest long, first long, max_repeats int"))
        order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        placed = sized.withColumn("upto", F.sum("tokens").over(order)).join(plan, ["source", "shard"])
        at = F.least(F.floor((F.col("upto") - F.col("tokens") / 2) / F.col("size")), F.col("blocks") - 1)
        chosen = F.pmod(at - F.col("first"), F.col("blocks")) < F.col("rest")
        times = F.least(F.col("passes") + chosen.cast("int"), F.col("max_repeats")).cast("int")
        self.rows = stored(placed.select("doc_id", "source", "tokens", times.alias("times_used")).where("times_used > 0"), "mixture")
        used = self.rows.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times_used")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("times_used").alias("most_used"))
        whole = F.sum("tokens").over(Window.partitionBy())
        self.shares = named.join(used, "source", "left").select(
            "source", "target_share", (F.coalesce(F.col("tokens") / whole, F.lit(0.0))).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_used", F.lit(0)).alias("most_used"), "max_repeats"
        )

"""Mixing sources to target shares by weighted fair queueing.

Each source's documents come in a shuffled order, pass after pass up to its
repeat cap. The virtual finish time of a document is the number of tokens its
source has delivered up to and including it, divided by the source's weight;
ordered by it all sources progress in proportion to their weights. The mix is
that order, cut at the total budget; what a source is then still short of its
share, by less than its next document, is filled with its next documents that fit.

Without a budget the total is the largest at which all shares can be met, so one
scarce source bounds it; ``shares`` says which, and what each source would allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.plans.lineage import cut
from talkmill.plans.prefix import running_total

SHUFFLE_SEED = 20240101


def attainable_budget(supply: DataFrame) -> float:
    """Largest total at which every source with documents can give its share, from (tokens, target_share, max_repeats) per source."""
    best = supply.where("tokens > 0 AND weight > 0 AND max_repeats > 0").agg(F.min(F.col("tokens") * F.col("max_repeats") / F.col("weight"))).first()[0]
    return float(best or 0)


def horizon(sources: list[tuple[int, float, int]], tokens: float) -> float:
    """The virtual time by which sources of (tokens, weight, max_repeats) can deliver ``tokens``, or the time all of them are used up."""
    done, at, rate = 0.0, 0.0, sum(weight for _, weight, _ in sources)
    for end, weight in sorted((size * repeats / weight, weight) for size, weight, repeats in sources):
        if done + rate * (end - at) >= tokens:
            return at + (tokens - done) / rate
        done, at, rate = done + rate * (end - at), end, rate - weight
    return at


def mix(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = SHUFFLE_SEED) -> DataFrame:
    """``source, doc_id, tokens, repeats``: the documents of the mix and how often each is used.

    ``documents``: source, doc_id, tokens; ``targets``: source, target_share,
    max_repeats (one row per source; of repeated ones the largest counts).
    Without ``budget`` the total is the largest at which all shares can be
    met. Sources without tokens take no part and the weights of the others are
    scaled to 1. Documents without tokens, of other or null sources, or with
    null ids aren't used; a repeated id of a source counts once, with its largest size.
    """
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("max_repeats")).where("share > 0 AND max_repeats > 0 AND source IS NOT NULL")
    docs = documents.where("tokens > 0 AND doc_id IS NOT NULL").join(wanted.select("source"), "source", "left_semi")
    docs = cut(docs.groupBy("source", "doc_id").agg(F.max("tokens").cast("bigint").alias("tokens")))
    supply = docs.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.max("tokens").alias("largest")).join(wanted, "source")
    # mix_targets has one row per source: few by definition, like a configuration.
    total_share = supply.agg(F.sum("share")).first()[0] or 1.0
    supply = cut(supply.select("source", F.col("source_tokens").alias("tokens"), (F.col("share") / F.lit(total_share)).alias("weight"), "max_repeats", "largest"))
    limit = float(budget) if budget is not None else attainable_budget(supply)
    placed = running_total(docs.withColumn("lot", F.xxhash64("source", "doc_id", F.lit(seed))), ["source"], ["lot", "doc_id"], F.col("tokens"), "delivered")
    # At a virtual time a source lags by less than its largest document, so within the budget no time
    # passes the one by which all can deliver the budget and their largest documents; one pass more for rounding.
    known = supply.collect()
    last = horizon([(x["tokens"], x["weight"], x["max_repeats"]) for x in known], limit + sum(x["largest"] for x in known))
    passes = F.least(F.col("max_repeats").cast("bigint"), F.floor(F.lit(last) * F.col("weight") / F.col("s.tokens")) + 2)
    rows = placed.alias("d").join(supply.alias("s"), "source").select(
        "source", "doc_id", F.col("d.tokens").alias("tokens"), "weight", F.col("s.tokens").alias("source_tokens"), "delivered", "lot",
        F.explode(F.sequence(F.lit(0).cast("bigint"), passes - 1)).alias("turn"),
    )
    timed = rows.select("source", "doc_id", "tokens", "turn", "lot", ((F.col("delivered") + F.col("turn") * F.col("source_tokens")) / F.col("weight")).alias("finish"))
    queued = running_total(timed, [], ["finish", "source", "doc_id", "turn"], F.col("tokens"), "so_far")
    queued = cut(queued)
    used = queued.where(F.col("so_far") <= F.lit(limit)).select("source", "doc_id", "tokens")
    got = used.groupBy("source").agg(F.sum("tokens").alias("got"))
    short = supply.join(got, "source", "left").select("source", F.floor(F.lit(limit) * F.col("weight") - F.coalesce("got", F.lit(0))).alias("short"))
    after = queued.where(F.col("so_far") > F.lit(limit)).join(short, "source").where("tokens <= short")
    filled = running_total(after, ["source"], ["finish", "doc_id", "turn"], F.col("tokens"), "more").where("more <= short")
    room = limit - (used.agg(F.sum("tokens")).first()[0] or 0)  # a source may have passed its share by a document
    filled = running_total(filled.drop("so_far"), [], ["finish", "source", "doc_id", "turn"], F.col("tokens"), "so_far").where(F.col("so_far") <= F.lit(room))
    used = used.unionByName(filled.select("source", "doc_id", "tokens"))
    return used.groupBy("source", "doc_id").agg(F.max("tokens").alias("tokens"), F.count("*").alias("repeats"))


def shares(mixed: DataFrame, targets: DataFrame, documents: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, tokens, documents, uses, allows, binds``: what each source of the targets contributes; 0 for one that gives nothing.

    ``allows``: the largest total at which the source can give its share within
    its repeat cap (null for one without tokens, whose share goes to the others);
    ``binds``: whether it is the source that allows least.
    """
    wanted = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    stock = documents.where("tokens > 0 AND doc_id IS NOT NULL").groupBy("source", "doc_id").agg(F.max("tokens").alias("tokens")).groupBy("source").agg(F.sum("tokens").alias("stock"))
    part = cut(wanted.join(stock, "source", "left"))
    live = (F.col("stock") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    scale = part.where(live).agg(F.sum("target_share")).first()[0] or 1.0
    allows = F.when(live, F.round(F.col("stock") * F.col("max_repeats") / (F.col("target_share") / F.lit(scale))))
    part = part.select("source", "target_share", allows.cast("bigint").alias("allows"))
    least = part.agg(F.min("allows")).first()[0]
    per = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.sum("repeats").alias("uses"))
    total = per.agg(F.sum("tokens")).first()[0] or 1
    found = part.join(per, "source", "left").select("source", "target_share", "allows", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documents", "uses")])
    return found.withColumns({"actual_share": F.round(F.col("tokens") / F.lit(total), 9), "binds": F.coalesce(F.col("allows") == F.lit(least), F.lit(False))})

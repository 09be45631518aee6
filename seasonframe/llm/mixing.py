"""Mixing sources to target weights by temperature, as permutations of blocks.

A source's share of all tokens, raised to an exponent and normalised, is its weight. The
exponent is the least that keeps the mixture's entropy at or below a target, and the most
repeated source at or below a limit; it is bracketed by evaluating a grid on all sources at
once, then a finer one between two of its points. Weights become token budgets. A source's
documents are hashed into blocks; every epoch goes through the blocks in a permutation of
its own, and the last one ends when the budget is used up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seasonframe.llm.common import stored

BLOCK_TOKENS = 1 << 16
LEAST_BLOCKS = 32
"""Blocks of a small source, so that its last epoch ends near its budget."""

MAX_EXPONENT = 8.0
GRID = 32
ROUNDS = 7

#: Primes beyond any number of blocks; block * prime + shift (mod blocks) is a permutation.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)

BLANK = "[ \\\\x09-\\\\x0D]"


@dataclass(frozen=True)
class Target:
    """``repeats`` bounds the passes over a source, ``entropy`` (nats) that of the weights."""

    repeats: float | None = 4.0
    entropy: float | None = None


def source_tokens(docs: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens``: words and one end each; NULL source counts as ''."""
    words = F.expr(
        f"size(split(text, '{BLANK}+')) - int(text rlike '^{BLANK}') - int(text rlike '{BLANK}$')"
    )
    n = F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(words) + 1
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), n.cast("long").alias("n_tokens"))


def exponent(sizes: DataFrame, target: Target) -> float:
    """The least exponent that meets the target, of ``source, tokens``.

    Every round brings one row per point of the grid to the driver, however many sources.
    """
    total = sizes.agg(F.sum("tokens").alias("total")).first()["total"] or 1
    share = F.col("tokens") / F.lit(float(total))
    low, high = 0.0, MAX_EXPONENT
    for _ in range(ROUNDS):
        points = [low + (high - low) * k / GRID for k in range(GRID + 1)]
        grid = sizes.select(F.log(share).alias("x"), F.explode(F.array(*[F.lit(p) for p in points])).alias("a"))
        power = F.exp(F.col("a") * F.col("x"))
        found = grid.groupBy("a").agg(
            F.sum(power).alias("z"), F.sum(power * F.col("x")).alias("zx"),
            F.max((1 - F.col("a")) * F.col("x")).alias("up"), F.max((F.col("a") - 1) * F.col("x")).alias("down"),
        )
        entropy = F.log("z") - F.col("a") * F.col("zx") / F.col("z")
        fits = F.lit(True)
        if target.entropy is not None:
            fits = fits & (entropy <= target.entropy + 1e-12)
        if target.repeats is not None:
            fits = fits & ((F.exp(F.col("up") + F.col("down")) <= target.repeats * (1 + 1e-12)) | (F.col("a") > 1))
        good = [r["a"] for r in found.filter(fits).select("a").collect()]
        best = min(good, default=high)
        low, high = max([p for p in points if p < best], default=low), best
    return high


def mixture(docs: DataFrame, target: Target = Target(), budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """One row per use of a document: ``doc_id, source, epoch, block, n_tokens, weight, position``.

    Sorted by ``position`` (0 to 1) any prefix has the sources at their weights. Without a
    ``budget`` of tokens the mixture is just long enough to use every document at least
    once. The last, partial epoch of a source takes blocks until the one that passes its
    budget. NULL and empty texts count one token; an empty table gives no rows.
    """
    tokens = stored(source_tokens(docs), "tokens")
    sizes = stored(tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sizes")
    a = exponent(sizes, target)
    total = sizes.agg(F.sum("tokens").alias("total"), F.sum(F.pow("tokens", F.lit(a))).alias("z")).first()
    weight = F.pow("tokens", F.lit(a)) / F.lit(total["z"] or 1.0)
    weighed = sizes.withColumn("weight", weight)
    if budget is None:
        budget = weighed.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0
    # Rounding must not cut the last block of a source that is used exactly once.
    repeats = F.round(F.lit(float(budget)) * F.col("weight") / F.col("tokens"), 9)
    plan = weighed.withColumn("repeats", repeats).withColumn("blocks", F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("tokens") / block_tokens)))
    plan = stored(plan, "plan")

    placed = tokens.join(plan.select("source", "blocks"), "source")
    placed = placed.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), "blocks")).drop("blocks")
    blocks = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens")).join(plan, "source")

    def turn(epoch):
        prime = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod(epoch, F.lit(len(PRIMES))) + 1).cast("int"))
        return F.pmod(F.col("block") * F.pmod(prime, F.col("blocks")) + F.pmod(F.xxhash64(F.lit(seed), "source", epoch), F.col("blocks")), F.col("blocks"))

    # Tokens before a block in the last epoch: those of lower thousands, then those in its own.
    blocks = blocks.withColumn("full", F.floor("repeats").cast("long")).withColumn("turn", turn(F.col("full")))
    blocks = blocks.withColumn("thousand", F.floor(F.col("turn") / 1024))
    before = Window.partitionBy("source").orderBy("thousand").rowsBetween(Window.unboundedPreceding, -1)
    thousands = blocks.groupBy("source", "thousand").agg(F.sum("block_tokens").alias("t"))
    thousands = thousands.select("source", "thousand", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("lower"))
    inside = Window.partitionBy("source", "thousand").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("within", F.coalesce(F.sum("block_tokens").over(inside), F.lit(0))).join(thousands, ["source", "thousand"])
    left = (F.col("repeats") - F.col("full")) * F.col("tokens")
    passes = F.col("full") + F.when(F.col("lower") + F.col("within") < left, 1).otherwise(0)
    uses = blocks.withColumn("passes", passes).filter("passes > 0")
    uses = uses.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)))
    place = (F.col("epoch") + (turn(F.col("epoch")) + 0.5) / F.col("blocks")) / F.greatest("repeats", F.col("epoch") + 1)
    uses = uses.select("source", "block", "epoch", "weight", place.alias("position"))
    return placed.join(uses, ["source", "block"]).select("doc_id", "source", "epoch", "block", "n_tokens", "weight", "position")

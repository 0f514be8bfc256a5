"""From token log-probabilities to statistics of sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.config import DEFAULT


def min_k(sorted_logp: Column, percent: int = DEFAULT.min_k_percent) -> Column:
    """T4: mean of the max(1, percent %) least log-probabilities of an ascending array; T5 is its negative."""
    k = F.greatest(F.lit(1), F.floor(F.size(sorted_logp) * percent / 100).cast("int"))
    return F.aggregate(F.slice(sorted_logp, 1, k), F.lit(0.0), lambda s, x: s + x) / k


def sequence_stats(scored: DataFrame, keys: list[str], logp: str, percent: int = DEFAULT.min_k_percent) -> DataFrame:
    """T1-T9 of each sequence: loss, perplexity (plain and clamped), min_k_prob, max and spread of the token losses, num_tokens.

    An array holds at most the scorer's bound of tokens, so the one group-by needs no second sort or window.
    """
    loss = F.avg(-F.col(logp))
    out = scored.groupBy(*keys).agg(
        loss.alias("loss"),
        F.max(-F.col(logp)).alias("max_token_loss"),
        F.coalesce(F.stddev_samp(logp), F.lit(0.0)).alias("std_token_loss"),
        F.stddev_pop(logp).alias("std_token_loss_pop"),
        F.count("*").alias("num_tokens"),
        F.sort_array(F.collect_list(logp)).alias("__a"),
    )
    return out.select(*keys, "loss", F.exp("loss").alias("perplexity"), F.exp(F.least("loss", F.lit(100.0))).alias("perplexity_clamped"), min_k(F.col("__a"), percent).alias("min_k_prob"), (-min_k(F.col("__a"), percent)).alias("min_k_loss"), "max_token_loss", "std_token_loss", "std_token_loss_pop", "num_tokens")


def losses(scored: DataFrame, keys: list[str], models: tuple[str, ...]) -> DataFrame:
    """L1/L2: (keys, loss_<model> ...), one pass for all models."""
    return scored.groupBy(*keys).agg(*[F.avg(-F.col(f"logp_{m}")).alias(f"loss_{m}") for m in models])


def answer_loss(scored: DataFrame, keys: list[str], logp: str, start: str) -> DataFrame:
    """Mean loss from column ``start`` on; of all tokens if there are none from there."""
    own = F.avg(F.when(F.col("pos") >= F.col(start), -F.col(logp)))
    return scored.groupBy(*keys).agg(F.coalesce(own, F.avg(-F.col(logp))).alias("answer_loss"))


def zlib_ratios(loss: Column, length: Column) -> tuple[Column, Column]:
    """Loss over the compressed length, guarded by 1e-8 or 0 for length 0."""
    return loss / (length + F.lit(DEFAULT.epsilon)), F.when(length > 0, loss / length).otherwise(F.lit(0.0))

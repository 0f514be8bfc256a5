"""Features across models and variants, as projections over wide rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import guarded_ratio


def pivot_models(df: DataFrame, key: str, model: str, values: list[str], models: tuple[str, ...]) -> DataFrame:
    """(key, <value>_<model> ...): one shuffle, partly aggregated before; a model missing for a key gives null."""
    return df.groupBy(key).agg(*[F.max(F.when(F.col(model) == m, F.col(v))).alias(f"{v}_{m}") for v in values for m in models])


def neighbour_stats(df: DataFrame, key: str, kind: str, loss: str, variant: str) -> list[Column]:
    """Aggregates of F5, F6, F9: mean and population spread of the losses of a kind of variants."""
    own = F.when(F.col(kind) == variant, F.col(loss))
    return [F.avg(own).alias(f"nb_mean_{loss}"), F.stddev_pop(own).alias(f"nb_std_{loss}")]


def reference(base: str, ft: str) -> tuple[Column, Column]:
    """(ref_diff, ref_ratio) = (base - ft, ft / base)."""
    return F.col(base) - F.col(ft), guarded_ratio(F.col(ft), F.col(base))


def cross_modal(text_gap: str, image_gap: str) -> list[Column]:
    """F11."""
    t, i = F.col(text_gap), F.col(image_gap)
    return [(t - i).alias("cross_modal_gap"), (t * i).alias("binding_score"), (t + i).alias("total_nb_gap")]


def lira(ft: dict[str, str], base: dict[str, str]) -> list[Column]:
    """eight ratios and differences; ft and base map loss, min_k, perplexity, max, std and zlib to columns."""
    f, b = {k: F.col(v) for k, v in ft.items()}, {k: F.col(v) for k, v in base.items()}
    return [
        guarded_ratio(b["loss"], f["loss"]).alias("loss_ratio"),
        (b["loss"] - f["loss"]).alias("loss_diff"),
        (f["min_k"] - b["min_k"]).alias("min_k_diff"),
        guarded_ratio(b["perplexity"], f["perplexity"]).alias("perplexity_ratio"),
        (b["max"] - f["max"]).alias("max_loss_diff"),
        (b["std"] - f["std"]).alias("std_loss_diff"),
        (b["zlib"] - f["zlib"]).alias("zlib_ratio_diff"),
        guarded_ratio(b["loss"] - f["loss"], b["loss"]).alias("norm_loss_improvement"),
    ]


def three_layer_ratio(base: str, ft: str) -> Column:
    """base / ft; -ft without a base model."""
    return F.when(F.col(base).isNull(), -F.col(ft)).otherwise(guarded_ratio(F.col(base), F.col(ft)))


def contrast(mean_other: Column, own: Column) -> Column:
    """mean loss of shuffled captions less the own one; 0 without any. F15 is its negative with corrupted pictures."""
    return F.coalesce(mean_other - own, F.lit(0.0))

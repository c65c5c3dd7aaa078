"""Indicators, labels, keys and deterministic masks as column expressions."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def unemployed(state: str = "trabajo") -> Column:
    return F.when(F.col(state) == "Desocupado", 1).when(F.col(state).isNotNull(), 0)


def in_labour_force(state: str = "trabajo") -> Column:
    return F.when(F.col(state) != "Inactivo", 1).when(F.col(state).isNotNull(), 0)


def label(col: Column | str, names: dict, otherwise: str | None = None) -> Column:
    """Code to label; unknown and missing codes give ``otherwise``."""
    col = F.col(col) if isinstance(col, str) else col
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    found = F.try_element_at(lookup, col)
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


def level_order(col: Column | str, levels: list) -> Column:
    """Position of a value in an ordered list of levels (1-based), else NULL."""
    col = F.col(col) if isinstance(col, str) else col
    at = F.array_position(F.array(*[F.lit(x) for x in levels]), col)
    return F.when(at > 0, at)


def joined(*cols: str, sep: str = "_") -> Column:
    """Key made of several columns; the separator keeps (1, 11) and (11, 1) apart."""
    return F.concat_ws(sep, *[F.col(c).cast("string") for c in cols])


def hash_number(keys: list[str], seed: int) -> Column:
    """32-bit number that depends on the row's key and the seed alone."""
    digest = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def hash_draw(keys: list[str], seed: int) -> Column:
    """Whole number from 0 to 999, a function of the row's key and the seed."""
    return hash_number(keys, seed) % 1000


def masked(value: str, keys: list[str], rate: Column | float, seed: int) -> Column:
    """Blank out a share of the values, chosen by a hash of the row's key.

    The choice depends on key and seed only, not on partitioning or row order.
    """
    rate = F.lit(rate) if isinstance(rate, float) else rate
    return F.when(hash_draw(keys, seed) >= rate * 1000, F.col(value))


def inverse_logit(eta: Column) -> Column:
    return F.exp(eta) / (F.lit(1.0) + F.exp(eta))


def cv(se: str, estimate: str) -> Column:
    return F.try_divide(F.col(se), F.col(estimate))

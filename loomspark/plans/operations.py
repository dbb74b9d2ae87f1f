"""The operators by name: what they are, what they need, and which one made a column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..operators import binning, categorical, domain, polynomial, ranking, statistical, temporal, text


@dataclass(frozen=True)
class Operation:
    name: str
    category: str
    description: str
    run: Callable
    patterns: tuple[str, ...]  # parts of the names of its columns
    categorical: bool = False
    numeric: bool = False


OPERATIONS = {
    o.name: o
    for o in (
        Operation("statistical", "aggregation", "statistics of a row's group", statistical.statistical_features, ("_mean_by_", "_std_by_", "_count_by_", "_min_by_", "_max_by_", "_dev_from_", "_norm_by_"), True, True),
        Operation("binning", "discretization", "quantile and equal-width bins", binning.binning_features, ("_qbin_", "_ubin_", "_bin_"), False, True),
        Operation("ranking", "ranking", "ranks, percentiles and quantile numbers", ranking.ranking_features, ("_rank", "_percentile", "_quartile", "_decile", "pct", "_above_median"), False, True),
        Operation("polynomial", "transformation", "powers, logarithms, roots and products", polynomial.polynomial_features, ("_squared", "_cubed", "_log", "_sqrt", "_reciprocal", "_x_"), False, True),
        Operation("temporal", "time", "calendar parts, lags and windows", temporal.calendar_features, ("_sin", "_cos", "_lag_", "_rolling_", "_expanding_", "_cumsum", "_dayof", "_weekofyear"), False, False),
        Operation("text", "text", "lengths, kinds of characters and vocabulary", text.text_features, ("_word_count", "_length", "_entropy", "_ratio", "_vocabulary_"), False, False),
        Operation("categorical", "encoding", "frequencies, labels, target means and indicators", categorical.categorical_features, ("_frequency", "_target_", "_label_encoded", "_binary_bit_", "_combination", "_is_"), True, False),
    )
}


def metadata(name: str) -> Operation:
    if name not in OPERATIONS:
        raise KeyError(f"unknown operation: {name}")
    return OPERATIONS[name]


def by_category(category: str) -> list[str]:
    return [n for n, o in OPERATIONS.items() if o.category == category]


def operation_of(column: str) -> str | None:
    """The operation that made a column, by the first pattern in its name; domain columns by theirs."""
    return next((n for n, o in OPERATIONS.items() if any(p in column for p in o.patterns)), None)


def applicable(has_categorical: bool, has_numeric: bool) -> list[str]:
    return [n for n, o in OPERATIONS.items() if (has_categorical or not o.categorical) and (has_numeric or not o.numeric)]


def check() -> list[str]:
    """What is wrong with the registry; nothing should be."""
    return [n for n, o in OPERATIONS.items() if n != o.name or not callable(o.run) or not o.patterns] + [n for n, o in domain.OPERATIONS.items() if not callable(o[3])]

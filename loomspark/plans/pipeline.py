"""Feature tables: original columns, domain operators, generic operators on both; then signal, alignment, lineage."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.numeric import usable_columns
from ..operators import binning, categorical, domain, polynomial, quality, ranking, statistical, text
from ..storage import materialize
from .operations import operation_of

@dataclass
class FeatureTable:
    data: DataFrame
    lineage: dict[str, str] = field(default_factory=dict)  # column -> stage that made it
    made_of: dict[str, list[str]] = field(default_factory=dict)  # column -> columns it is directly made of

    def dependencies(self, column: str) -> list[str]:
        """The columns that a column is made of, directly or through others, in alphabetical order."""
        seen, todo = set(), [column]
        while todo:
            for c in self.made_of.get(todo.pop(), ()):
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        return sorted(seen)


def parts_of(column: str, others: list[str]) -> list[str]:
    """The columns whose names a made column's name is put together from: the longest that begins it, and those that stand in the rest."""
    found, rest = [], column
    for c in sorted(others, key=lambda c: (-len(c), c)):
        if c != column and re.search(rf"(^|_){re.escape(c)}(_|$)", rest):
            found.append(c)
            rest = re.sub(rf"(^|_){re.escape(c)}(_|$)", "__", rest, count=1)
    return sorted(found)


def build(df: DataFrame, groups=(), values=None, texts=(), target: str | None = None, ranks=(), signal: bool = True, on_custom: int = 0, most_groups: int = 3, most_values: int = 5, unequal: bool = True) -> FeatureTable:
    """All operators' columns, lower-case, each name once; columns that never vary, and made columns that equal one before them, are left out.

    on_custom: so many of the domain operators' numbers go through the generic ones too; most_groups, most_values: so many columns of either kind have group statistics.
    """
    lineage = {c.lower(): "original" for c in df.columns}
    values = usable_columns(df, list(values) if values is not None else None)
    df = out = materialize(df, "original-columns")  # it is profiled several times

    def note(stage: str) -> None:
        lineage.update({c.lower(): stage for c in out.columns if c.lower() not in lineage})

    out = domain.domain_features(out)
    note("custom")
    custom = [f.name for f in out.schema.fields if lineage[f.name.lower()] == "custom" and f.dataType.typeName() == "double"][:on_custom]
    values = [*values, *custom]
    if values:
        if groups:
            out = statistical.statistical_features(out, list(groups)[:most_groups], values[:most_values])
        out = polynomial.polynomial_features(out, values)
        out = binning.binning_features(out, values)
        note("generic")
    if ranks:
        out = ranking.ranking_features(out, list(ranks))
    if groups:
        out = categorical.categorical_features(out, list(groups), target)
    for t in texts:
        out = text.text_features(out, t)
    note("generic")
    if signal:
        made = [c for c in out.columns if lineage[c.lower()] != "original"]
        keep = set(quality.signal_columns(out, made)) if made else set()
        out = out.select(*[c for c in out.columns if lineage[c.lower()] == "original" or c in keep])
    if unequal:
        rows = [c for c in out.columns if lineage[c.lower()] == "original"]
        keep = set(quality.drop_equal(out, [c for c in out.columns if c not in rows], rows))
        out = out.select(*[c for c in out.columns if c in rows or c in keep])
    out = out.toDF(*[c.lower() for c in out.columns])
    names = [c for c in out.columns if lineage[c] != "generic"]
    return FeatureTable(out, {c: lineage[c] for c in out.columns}, {c: parts_of(c, names) for c in out.columns if lineage[c] == "generic"})


def register(table: FeatureTable, split: str, names: list[str] | None = None) -> list[dict]:
    """Catalog rows of a table's made columns; only training tables define features."""
    if split != "train":
        return []
    made = [c for c, stage in table.lineage.items() if stage != "original" and (names is None or c in names)]
    return [{"feature_name": c, "origin": table.lineage[c], "operation_name": operation_of(c), "dependencies": table.dependencies(c)} for c in made]


def align(train: DataFrame, test: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables with the columns they share, in the training table's order; the target stays in training."""
    shared = [c for c in train.columns if c in set(test.columns) and c != target]
    return train.select(*shared, *([target] if target in train.columns else [])), test.select(*shared)

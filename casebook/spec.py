"""Column roles of a case-by-feature table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MatrixSpec:
    """Names the key, the outcome and the features of a matrix DataFrame.

    ``label`` is the class for classification and the event flag for survival
    data; ``duration`` is set for survival data only. Feature order is
    alphabetical by contract, because redundancy filtering depends on it.
    """

    features: tuple[str, ...]
    case_id: str = "case_id"
    label: str = "label"
    duration: str | None = None

    @classmethod
    def infer(cls, df: DataFrame, case_id="case_id", label="label", duration=None) -> "MatrixSpec":
        roles = {case_id, label, duration}
        feats = tuple(sorted(c for c in df.columns if c not in roles))
        return cls(feats, case_id, label, duration)

    def only(self, features) -> "MatrixSpec":
        return replace(self, features=tuple(features))

    @property
    def keys(self) -> list[str]:
        return [c for c in (self.case_id, self.label, self.duration) if c]

    @property
    def columns(self) -> list[str]:
        return [*self.keys, *self.features]

    def project(self, df: DataFrame) -> DataFrame:
        return df.select(*self.columns)

    def long(self, df: DataFrame, value="value") -> DataFrame:
        """One row per (case, feature); rows whose value is NULL are kept."""
        return df.unpivot(
            self.keys, [F.col(f"`{f}`").cast("double").alias(f) for f in self.features], "feature", value
        )

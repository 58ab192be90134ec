"""What a plan returns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Checked:
    """Publishable rows and rejected rows of one plan; neither is computed when a plan returns."""

    accepted: DataFrame
    rejected: DataFrame

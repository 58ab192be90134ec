"""Summaries of vehicle recordings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tsukiori.functions.metadata import expand_metadata
from tsukiori.operators.aggregate import count_by, sum_by


@dataclass(frozen=True)
class RecordingSummary:
    """Recordings with their parsed metadata, and two summaries of them."""

    expanded: DataFrame
    duration_by_scenario: DataFrame
    count_by_model: DataFrame


def recording_summary(recordings: DataFrame) -> RecordingSummary:
    """Parse the metadata; total duration per scenario and recordings per model."""
    expanded = expand_metadata(recordings)
    return RecordingSummary(
        expanded,
        sum_by(expanded, "scenario", "recording_duration", "total_duration"),
        count_by(expanded, "model"),
    )

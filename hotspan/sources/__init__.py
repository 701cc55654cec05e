"""Readers and writers."""

from hotspan.sources.readers import (
    read_bins_features,
    read_points,
    read_predictions,
    read_typed_points,
)
from hotspan.sources.writers import empty_result, write_predictions, write_stage

__all__ = [
    "empty_result", "read_bins_features", "read_points", "read_predictions",
    "read_typed_points", "write_predictions", "write_stage",
]

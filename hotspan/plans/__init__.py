"""Compositions of the operators."""

from hotspan.plans.hotspots import HotspotConfig, run_hotspots
from hotspan.plans.labels import build_labels
from hotspan.plans.training import TrainingConfig, fit_and_predict

__all__ = ["HotspotConfig", "TrainingConfig", "build_labels", "fit_and_predict", "run_hotspots"]

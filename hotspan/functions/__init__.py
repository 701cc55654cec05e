"""Column expressions: no shuffle, no Python worker."""

from hotspan.functions.names import (
    CANONICAL,
    chrom_id,
    chrom_sort_key,
    norm_chrom,
)
from hotspan.functions.numeric import (
    interval_length,
    length_kb,
    point_position,
    sanitize,
    sanitize_count,
    sanitize_rate,
    to_int_strict,
)
from hotspan.functions.scores import (
    bin_loglike,
    huber_weight,
    interval_weight,
    llr_norm,
    llr_poisson,
)
from hotspan.functions.tail import Mixture, mixture_tail
from hotspan.functions.text import EVENT_TYPE_ALIASES, norm_event_type, pass_filter
from hotspan.functions.vectors import fuse_vectors

__all__ = [
    "CANONICAL", "EVENT_TYPE_ALIASES", "Mixture", "bin_loglike", "chrom_id",
    "chrom_sort_key", "fuse_vectors", "huber_weight", "interval_length",
    "interval_weight", "length_kb", "llr_norm", "llr_poisson", "mixture_tail",
    "norm_chrom", "norm_event_type", "pass_filter", "point_position",
    "sanitize", "sanitize_count", "sanitize_rate", "to_int_strict",
]

"""Parameters, as frozen values that plans take by argument."""

from __future__ import annotations

from dataclasses import dataclass


# The defaults of Decay, Binning, Clustering and Scoring, which results depend on.


@dataclass(frozen=True)
class Decay:
    """Forgetting by counts of events."""

    tau: float = 200.0
    removal_gap: int = 400
    floor: float = 1e-4
    budget: int = 500


@dataclass(frozen=True)
class Binning:
    initial_bins: int = 20
    density_threshold: int = 5
    drift_delta: float = 0.02
    digest_decay: float = 0.85
    digest_interval: int = 1000
    min_width: float = 0.001
    quantiles: tuple[float, ...] = (0.05, 0.2, 0.4, 0.6, 0.8, 0.95)
    window: int = 1000
    grid: int = 100
    split_cooldown: int = 500


@dataclass(frozen=True)
class Clustering:
    """Fit and analysis thresholds; normaliser is reference, pairs or diagonal."""

    merge: float = 0.6
    split: float = 0.15
    alpha: float = 0.15
    normaliser: str = "diagonal"
    analysis_merge: float = 0.80
    analysis_split: float = 0.15
    analysis_alpha: float = 0.05
    active_weight: float = 0.01


@dataclass(frozen=True)
class Scoring:
    context: int = 3
    unknown: str = "UNKNOWN"
    max_top: int = 7
    data_weight: float = 0.6
    numeric_boost: float = 1.2
    category_boost: float = 1.15
    variance_threshold: float = 0.05
    seconds_decay: float = 0.05
    threshold_divisor: float = 10.0
    threshold_bounds: tuple[float, float] = (0.1, 1.5)


#: Fitted on the generated log with its true labels: numeric features scaled by feature.
CALIBRATED = Clustering(merge=0.85, split=0.82)


@dataclass(frozen=True)
class Params:
    """mode: intended, or literal, in which every micro-cluster is forgotten at once.

    vector_features: all, or numeric for the log's numeric columns alone; scaling: within_vector or per_feature.
    """

    mode: str = "intended"
    vector_features: str = "all"
    scaling: str = "within_vector"
    decay: Decay = Decay()
    binning: Binning = Binning()
    clustering: Clustering = Clustering()
    scoring: Scoring = Scoring()

"""The choices of one modelling run. Immutable: a what-if makes a new one."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from nichegrid.functions.geo import RESOLUTIONS_M

DATA_MODES = ("explore", "deepdive", "own")
MODEL_TYPES = ("rf", "maxent", "embedding")
MAX_TREE_DEPTH = 30


def check_mode(mode: str, dataset_key: str = "") -> None:
    """A ``ValueError`` unless presences can come from this mode."""
    if mode not in DATA_MODES:
        raise ValueError(f"unknown data mode {mode!r}: choose from {', '.join(DATA_MODES)}")
    if mode == "own" and not dataset_key:
        raise ValueError("data mode 'own' needs the key of a dataset (dataset_key)")


@dataclass(frozen=True)
class RunConfig:
    # The defaults of a new run.
    species: str = ""
    country_code: str = ""
    county_name: str = ""
    year_start: int = 2018
    year_end: int = 2025
    data_mode: str = "explore"
    dataset_key: str = ""
    selected_layers: tuple[str, ...] = ()
    model_type: str = "rf"
    n_trees: int = 100
    max_depth: int = 3
    train_size: float = 0.75
    resolution: int = 100
    seed: int = 42
    whatif_offsets: Mapping[str, float] = field(default_factory=dict)

    def checked(self) -> RunConfig:
        """Itself, or a ``ValueError`` before any job starts."""
        check_mode(self.data_mode, self.dataset_key)
        if self.model_type not in MODEL_TYPES:
            raise ValueError(f"unsupported model_type {self.model_type!r}; use one of {MODEL_TYPES}")
        if self.resolution not in RESOLUTIONS_M:
            raise ValueError(f"resolution must be one of {RESOLUTIONS_M}")
        if not 0 < self.train_size < 1:
            raise ValueError("train_size must lie between 0 and 1")
        if not 1 <= self.max_depth <= MAX_TREE_DEPTH:
            raise ValueError(f"max_depth must lie between 1 and {MAX_TREE_DEPTH}")
        return self

    def with_offsets(self, offsets: Mapping[str, float]) -> RunConfig:
        return replace(self, whatif_offsets=dict(offsets))

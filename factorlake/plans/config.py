"""Settings: defaults, overridden by YAML files and dicts, merged by key."""

from __future__ import annotations

import copy
from pathlib import Path

#: Default settings. Fixed values.
SELECTION = {
    "data": {"start": "2024-01-01", "end": "2026-01-01", "max_stocks": 300},
    "evaluation": {"forward_periods": [1, 5, 10, 20], "ic_method": "rank", "n_groups": 5, "ic_decay_max_lag": 20, "plot_period": 5},
    "factors": {"extra_paths": []},
    "model": {"cv_splits": 5, "seed": 42},
}
TIMING = {"evaluation": {"price_col": "close", "trading_days": 252, "risk_free": 0.0}, "factors": {"extra_paths": []}}


def merge(base: dict, over: dict) -> dict:
    """base with over's values; dicts in both are merged in turn."""
    out = copy.deepcopy(base)
    for k, v in (over or {}).items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load_config(path: str | None = None, base: dict = SELECTION) -> dict:
    if path is None or not Path(path).exists():
        return copy.deepcopy(base)
    import yaml

    return merge(base, yaml.safe_load(Path(path).read_text()) or {})


def load_timing_config(path: str | None = None) -> dict:
    return load_config(path, TIMING)

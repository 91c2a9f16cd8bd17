"""Project configuration: a flat dataclass read from nested YAML, and presets."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml

FILE_NAMES = ("grove.yaml", "grove.yml", ".grove.yaml")
#: Glob patterns of files that are left out, and size bounds in bytes (inclusive).
EXCLUDED = ("**/test_*.py", "**/*_test.py", "**/tests/**", "**/test/**", "**/__pycache__/**", "**/setup.py", "**/conftest.py", "**/.git/**")
MIN_BYTES, MAX_BYTES = 50, 100_000


#: Shares of the parts of a risk score.
WEIGHTS = {"structural": 0.4, "anomaly": 0.3, "rule_based": 0.3}


@dataclass(frozen=True)
class ProjectConfig:
    """What the batch entries read; the file has a section for each part."""

    clean_code: bool = True
    embeddings: bool = True
    use_cache: bool = True
    algorithm: str = "kmeans"
    n_clusters: int | None = None
    anomaly_algorithm: str = "ensemble"
    contamination: float = 0.1
    risk_weights: dict[str, float] = field(default_factory=WEIGHTS.copy)
    output_dir: str = "outputs"
    html_report: bool = True
    plots: bool = True
    excluded_patterns: list[str] = field(default_factory=lambda: list(EXCLUDED))


#: field -> (section, key); section "" is the top level.
_PLACES = {
    **{k: ("extraction", k) for k in ("clean_code", "embeddings", "use_cache")}, **{k: ("analysis", k) for k in ("algorithm", "n_clusters", "anomaly_algorithm", "contamination", "risk_weights")},
    "output_dir": ("output", "directory"), "html_report": ("output", "html_report"), "plots": ("output", "plots"), "excluded_patterns": ("", "excluded_patterns"),
}


def find_config(start: str | Path = ".") -> Path | None:
    here = Path(start).resolve()
    return next((d / n for d in (here, *here.parents) for n in FILE_NAMES if (d / n).is_file()), None)


def load_config(path: str | Path | None = None) -> ProjectConfig:
    """The configuration of ``path`` or the nearest file upwards; defaults where it is missing, broken or no mapping."""
    path = Path(path) if path else find_config()
    try:
        data = yaml.safe_load(path.read_text()) if path else {}
    except (OSError, ValueError, yaml.YAMLError):
        return ProjectConfig()
    if not isinstance(data, dict):
        return ProjectConfig()
    given = {}
    for name, (section, key) in _PLACES.items():
        part = data.get(section) or {} if section else data
        if isinstance(part, dict) and key in part:
            given[name] = part[key]
    return ProjectConfig(**given)


def save_config(path: str | Path, config: ProjectConfig | None = None) -> Path:
    config, out = config or ProjectConfig(), {}
    for name, (section, key) in _PLACES.items():
        (out.setdefault(section, {}) if section else out)[key] = getattr(config, name)
    Path(path).write_text(yaml.safe_dump(out, sort_keys=False))
    return Path(path)


#: Anomaly algorithm, contamination and weights (structural, anomaly, rules) of the presets.
_PRESETS = {"strict": ("ensemble", 0.15, (0.3, 0.4, 0.3)), "balanced": ("isolation_forest", 0.1, (0.4, 0.3, 0.3)), "permissive": ("isolation_forest", 0.05, (0.5, 0.2, 0.3))}
PRESETS = {k: ProjectConfig(anomaly_algorithm=a, contamination=c, risk_weights=dict(zip(WEIGHTS, w, strict=True))) for k, (a, c, w) in _PRESETS.items()}


def get_preset(name: str) -> ProjectConfig:
    if name not in PRESETS:
        raise ValueError(f"Unknown preset {name!r}; there are {', '.join(PRESETS)}")
    return PRESETS[name]

"""Settings with their defaults; a file of "name = value" lines overrides them."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    speedup: float = 10_000.0
    random_delay: str = "30 minutes"
    max_out_of_orderness: str = "30 minutes"
    watermark_interval_ms: int = 10_000
    topic_partitions: int = 3
    checkpoint_seconds: int = 10
    mapping_ttl_hours: int = 3
    frequency_window: str = "12 hours"
    frequency_slide: str = "1 hour"
    frequency_limit: str = "6 hours"
    clusters: int = 4
    decay: float = 0.2
    cluster_window: str = "24 hours"
    cluster_min: int = 50
    cluster_max: int = 20_000
    recommendation_window: str = "4 hours"
    recommendation_slide: str = "1 hour"
    active_days: int = 14
    recommendations: int = 5
    min_similarity: float = 0.1
    hashes: int = 100
    lsh_threshold: float = 0.1
    statistics_window: str = "12 hours"
    statistics_slide: str = "30 minutes"
    count_author: bool = False

    @staticmethod
    def load(path: str | None = None) -> "Settings":
        """Defaults, overridden by the file's lines; # begins a comment. An unknown name or a value of another kind is an error."""
        if path is None:
            return Settings()
        kinds = {f.name: type(getattr(Settings(), f.name)) for f in fields(Settings)}
        found = {}
        with open(path, encoding="utf-8") as f:
            for line in f:
                line = line.partition("#")[0].strip()
                if line:
                    name, eq, value = (x.strip() for x in line.partition("="))
                    if not eq or name not in kinds:
                        raise ValueError(f"unknown setting: {line}")
                    found[name] = value.lower() in ("true", "yes", "1") if kinds[name] is bool else kinds[name](value)
        return replace(Settings(), **found)


def state_ttl_ms(event_time_ms: int, speedup: float, least_ms: int = 60_000) -> int:
    """How long state lives in processing time if events are replayed speedup times as fast; 0 is no replay."""
    return least_ms if speedup == 0 else max(least_ms, int(event_time_ms / speedup))

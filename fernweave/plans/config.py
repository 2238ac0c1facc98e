"""Settings with their bounds; what is out of bounds raises when the setting is made."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import ConfigurationError, InputError

# The bounds of settings and inputs.
TOP_K = (1, 200)
HISTORY = (1, 20)
ROUTING = (1_000, 2_000_000)
QUERY_CHARS, INGEST_CHARS = 32_000, 5_000_000
METADATA_KEYS, METADATA_CHARS = 50, 8_000


def _within(name: str, value: float, bounds: tuple[float, float]) -> None:
    if not bounds[0] <= value <= bounds[1]:
        raise ConfigurationError(f"{name} must be from {bounds[0]} to {bounds[1]}, not {value}")


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 8
    history_window: int = 3
    dense_weight: float = 1.0
    keyword_weight: float = 0.8
    entity_weight: float = 0.7
    expand_parents: bool = False
    entity_hops: int = 2
    source_weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        _within("top_k", self.top_k, TOP_K)
        _within("history_window", self.history_window, HISTORY)
        _within("entity_hops", self.entity_hops, (1, 5))
        for name, w in self.source_weights.items():
            if not 0 < w <= 10:
                raise ConfigurationError(f"the weight of {name} must be above 0 and at most 10, not {w}")


@dataclass(frozen=True)
class RoutingConfig:
    mode: str = "retrieval"
    direct_threshold: int = 150_000

    def __post_init__(self):
        if self.mode not in ("retrieval", "direct", "auto"):
            raise ConfigurationError(f"unknown mode {self.mode!r}")
        _within("direct_threshold", self.direct_threshold, ROUTING)


@dataclass(frozen=True)
class ChunkingConfig:
    size: int = 375
    overlap: int = 40
    parent_size: int = 0

    def __post_init__(self):
        if self.size <= 0 or not 0 <= self.overlap < self.size:
            raise ConfigurationError("need 0 <= overlap < size")
        if self.parent_size not in (-1, 0) and self.parent_size <= self.size:
            raise ConfigurationError("parents must be larger than chunks")


def checked_query(text: str) -> str:
    if len(text) > QUERY_CHARS:
        raise InputError(f"a query has at most {QUERY_CHARS} characters")
    return text


def checked_metadata(metadata: dict[str, str]) -> dict[str, str]:
    if len(metadata) > METADATA_KEYS or any(len(str(v)) > METADATA_CHARS for v in metadata.values()):
        raise InputError(f"at most {METADATA_KEYS} keys and {METADATA_CHARS} characters a value")
    return metadata


@dataclass(frozen=True)
class MemoryConfig:
    """Weights of the three searches over memories; 0 turns one off. How many turns before are looked at."""

    semantic_weight: float = 0.5
    keyword_weight: float = 0.3
    entity_weight: float = 0.2
    top_k: int = 8

    def __post_init__(self):
        _within("top_k", self.top_k, TOP_K)
        for name in ("semantic_weight", "keyword_weight", "entity_weight"):
            _within(name, getattr(self, name), (0, 10))
        if not self.semantic_weight + self.keyword_weight + self.entity_weight:
            raise ConfigurationError("at least one search must be on")


@dataclass(frozen=True)
class GenerationConfig:
    grounding: bool = False
    threshold: float = 0.5
    relevance_gate: bool = False

    def __post_init__(self):
        _within("threshold", self.threshold, (0, 1))
        if self.relevance_gate and not self.grounding:
            raise ConfigurationError("the relevance gate needs grounding")


@dataclass(frozen=True)
class BatchConfig:
    size: int = 100
    concurrent: int = 5

    def __post_init__(self):
        _within("size", self.size, (1, 10_000))
        _within("concurrent", self.concurrent, (1, 100))

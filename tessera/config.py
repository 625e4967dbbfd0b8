"""Settings of the pipelines, with their bounds checked."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

METRICS = ("Cosine", "Dot", "Euclid", "Manhattan")


@dataclass(frozen=True)
class Chunking:
    max_tokens: int = 512
    overlap_tokens: int = 50
    include_section_path: bool = True

    def __post_init__(self) -> None:
        if self.max_tokens <= 0 or not 0 <= self.overlap_tokens < self.max_tokens:
            raise ValueError("overlap_tokens must be at least 0 and less than max_tokens")


@dataclass(frozen=True)
class Embedding:
    dims: int = 64
    token_limit: int = 512

    def __post_init__(self) -> None:
        if self.dims <= 0 or self.token_limit <= 0:
            raise ValueError("dims and token_limit must be positive")


@dataclass(frozen=True)
class Store:
    metric: str = "Cosine"

    def __post_init__(self) -> None:
        if self.metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")


@dataclass(frozen=True)
class Retrieval:
    pool: int = 10
    limit: int = 10
    rrf_k: int = 60
    rerank: bool = True

    def __post_init__(self) -> None:
        if min(self.pool, self.limit, self.rrf_k) <= 0:
            raise ValueError("pool, limit and rrf_k must be positive")


@dataclass(frozen=True)
class Compression:
    ratio: float | None = 0.5
    token_limit: int | None = None
    max_tokens: int = 512

    def __post_init__(self) -> None:
        if self.ratio is not None and not 0 < self.ratio < 1:
            raise ValueError("ratio must be between 0 and 1")


@dataclass(frozen=True)
class Fetching:
    max_retries: int = 3
    retry_delay: float = 1.0
    backoff: float = 2.0
    request_delay: float = 1.0

    def __post_init__(self) -> None:
        if self.max_retries < 0 or self.retry_delay < 0 or self.backoff < 1 or self.request_delay < 0:
            raise ValueError("retries and delays can't be negative, backoff is at least 1")


@dataclass(frozen=True)
class Config:
    chunking: Chunking = field(default_factory=Chunking)
    embedding: Embedding = field(default_factory=Embedding)
    store: Store = field(default_factory=Store)
    retrieval: Retrieval = field(default_factory=Retrieval)
    compression: Compression = field(default_factory=Compression)
    fetching: Fetching = field(default_factory=Fetching)

    def __post_init__(self) -> None:
        if self.chunking.max_tokens > self.embedding.token_limit:
            raise ValueError("a chunk must fit the embedding's token_limit")


SECTIONS = {"chunking": Chunking, "embedding": Embedding, "store": Store, "retrieval": Retrieval, "compression": Compression, "fetching": Fetching}
#: Other names under which settings may be given.
ALIASES = {"chunk_size": "max_tokens", "max_chunk_size": "max_tokens"}


def load(settings: dict[str, dict]) -> Config:
    """A configuration from nested dictionaries, as a YAML or JSON file gives them; unknown names are errors."""
    parts = {name: SECTIONS[name](**{ALIASES.get(k, k): v for k, v in values.items()}) for name, values in settings.items()}
    return Config(**parts)


def _read(path: str) -> dict[str, Any]:
    """A JSON or, where PyYAML is installed, YAML file of nested settings; an empty file has none."""
    text = Path(path).read_text("utf-8")
    if path.endswith(".json"):
        return json.loads(text) if text.strip() else {}
    import yaml

    return yaml.safe_load(text) or {}


#: What a settings file that leaves them out stands for.
FILE_CHUNKING = {"chunk_size": 256, "overlap_tokens": 30, "include_header_path": True}
FILE_TOKEN_LIMIT, FILE_METRIC = 512, "Cosine"


def load_file(path: str) -> Config:
    """A configuration from a settings file; sections and names that concern servers and models are passed over."""
    given = _read(path)
    part = lambda name: given.get(name) or {}
    chunking = FILE_CHUNKING | part("chunking")
    embedding = {"token_limit": part("embedding").get("token_limit", FILE_TOKEN_LIMIT)}
    if "model_dim" in part("embedding"):
        embedding["dims"] = part("embedding")["model_dim"]
    return Config(
        chunking=Chunking(chunking["chunk_size"], chunking["overlap_tokens"], chunking["include_header_path"]),
        embedding=Embedding(**embedding),
        store=Store(part("qdrant").get("distance_metric", FILE_METRIC)),
        compression=Compression(part("compression").get("compression_ratio"), part("compression").get("token_limit")),
        fetching=load_fetching(path),
    )


def load_fetching(path: str) -> Fetching:
    """The settings of fetching in a file; any fault of the file or of its values gives the defaults."""
    try:
        given = _read(path).get("url_fetching") or {}
        return Fetching(given.get("max_retries", 3), given.get("retry_delay", 1.0), given.get("retry_backoff", 2.0), given.get("request_delay", 1.0))
    except Exception:
        return Fetching()


def sequence_limit(known: int | None, least: int = 512, most: int = 100_000) -> int:
    """Tokens that a model takes at once: what its tokenizer says, or ``least`` where it says nothing or a number beyond ``most``."""
    return least if known is None or known > most else known

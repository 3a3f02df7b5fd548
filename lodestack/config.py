"""Settings of the retrieval and ingest operators, as one immutable value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Defaults of the engine; pass ``replace(DEFAULTS, ...)`` to change some."""

    max_tokens: int = 768
    dense_k: int = 50
    sparse_k: int = 50
    rrf_k: int = 60
    rerank_top_n: int = 5
    rerank_input_k: int = 50
    context_max_tokens: int = 4096
    snippet_chars: int = 300
    rerank_chars: int = 4000
    embed_batch: int = 32


DEFAULTS = Settings()

"""One settings object for every stage."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class Settings:
    # The defaults a run starts from.
    chunk_size: int = 512
    chunk_overlap: int = 50
    chunking_strategy: str = "recursive"
    embedding_dimension: int = 1024
    batch_size: int = 32
    max_retries: int = 3
    retry_delay: float = 1.0
    top_k: int = 10
    similarity_threshold: float = 0.7
    use_hybrid_search: bool = True
    keyword_weight: float = 0.3
    semantic_weight: float = 0.7
    max_context_tokens: int = 4096
    max_answer_tokens: int = 1024
    temperature: float = 0.7
    min_chunk_length: int = 10
    max_chunk_length: int = 10000
    min_embedding_norm: float = 0.1
    max_embedding_norm: float = 100.0
    min_text_length: int = 10
    max_duration_seconds: float = 36000.0
    min_coverage: float = 0.9

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> Settings:
        known = {f.name for f in fields(cls)}
        unknown = sorted(set(values) - known)
        if unknown:
            raise ValueError(f"unknown settings: {unknown}")
        return cls(**values)

"""Defaults of the engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass

TOP_K_CHOICES = (1, 3, 5, 10)
SUPPORTED = (".docx", ".pdf")


@dataclass(frozen=True)
class Config:
    chunk_size: int = 500
    chunk_overlap: int = 50
    page_target: int = 1500
    top_k: int = 3
    confidence_threshold: float = 0.35
    embedding_dimension: int = 256
    embedding_model: str = "all-MiniLM-L6-v2"
    llm_provider: str = "gemini"
    llm_model: str = "gemini-2.5-flash"
    temperature: float = 0.2
    #: Questions are scored against the index in blocks of about so many bytes of vectors.
    question_block_bytes: int = 16 << 20

    def __post_init__(self):
        check_threshold(self.confidence_threshold)
        check_top_k(self.top_k)


def check_threshold(threshold: float) -> float:
    if not 0 <= threshold <= 1:
        raise ValueError(f"the confidence threshold lies between 0 and 1, not at {threshold}")
    return threshold


def check_top_k(k: int) -> int:
    if k < 1:
        raise ValueError(f"top_k must be at least 1, not {k}")
    return k

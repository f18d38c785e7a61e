"""Every setting of the embedding pipeline in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Corpus and vocabulary.
    period_is_whitespace: bool = False
    minfreq: int = 100
    maxvocab: int = 0
    subsample: float = 1e-5
    # Windows.
    window: int = 2
    weight_window: bool = False
    positional: bool = True
    max_sentence: int = 1000
    # Association.
    matrix: str = "cpmi"
    clip: float = 0.0
    cds: float = 0.75
    process: str = "all"
    process_threshold: float = 0.0
    # Noise.
    negative: int = 5
    unigram_power: float = 0.75
    exclude_target: bool = False
    sampler: str = "noise"
    # Subwords.
    minn: int = 3
    maxn: int = 6
    buckets: int = 2_000_000
    ngram_unit: str = "byte"
    # Training.
    dim: int = 300
    alpha: float = 0.025
    iterations: int = 5
    model: int = 1
    batch: int = 500
    #: Blocks of words and of contexts that are trained side by side, and the
    #: examples that two blocks have at least in common (else fewer blocks).
    workers: int = 8
    block_examples: int = 200_000
    seed: int = 1

    def __post_init__(self) -> None:
        if self.minn >= 1 and self.buckets < 1:
            raise ValueError("hashed subwords need at least one bucket")
        if self.model not in (0, 1, 2):
            raise ValueError("model is 0 (W and C), 1 (W) or 2 (W + C)")
        if self.window < 1 or self.max_sentence < 1:
            raise ValueError("window and max_sentence are at least 1")
        if self.ngram_unit not in ("byte", "char"):
            raise ValueError("ngram_unit is byte or char")
        if self.workers < 1 or self.block_examples < 1 or self.batch < 1:
            raise ValueError("workers, block_examples and batch are at least 1")

"""Tunable sizes, honoured by every operator that takes an ``Options``."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    min_chunk_chars: int = 100      # a semantic chunk must be longer than this
    overlap_chars: int = 100        # text borrowed from each neighbour
    split_chars: int = 800          # fallback splitter: largest piece
    split_overlap: int = 100        # fallback splitter: text shared by two pieces
    top_k: int = 15                 # hits per question after a build or load
    rerank_keep: int = 5
    context_words: int = 4000
    context_fill: float = 0.8
    build_timeout_minutes: int = 15
    full_import_name: bool = False  # keep the dotted name of an import, not its first segment

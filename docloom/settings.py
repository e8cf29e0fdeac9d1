"""Options that are checked when they are made, and names that stand for others."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import chunking

#: Short names of models and what they stand for. Our own table.
ALIASES = {"small": "gpt-small", "large": "gpt-large", "fast": "haiku-like", "smart": "sonnet-like"}


def model_name(name: str) -> str:
    """The full name of a model; a name that is no alias stands for itself."""
    return ALIASES.get(name.strip().lower(), name)


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class Chunking:
    strategy: str = "recursive"
    most: int = 256
    least: int = 100
    overlap: int = 30
    size: int = 1000

    def __post_init__(self):
        _check(self.most > self.least >= 0, "most must be larger than least")
        _check(0 <= self.overlap < self.most, "overlap must be smaller than most")
        _check(self.size > 0, "size must be positive")


@dataclass(frozen=True)
class Dedup:
    threshold: float = 0.95
    most: int = 8
    preserve: int = 3

    def __post_init__(self):
        _check(0 <= self.threshold <= 1, "threshold must be between 0 and 1")
        _check(self.most >= 1, "most must be 1 or more")
        _check(0 <= self.preserve <= self.most, "preserve must be between 0 and most")


@dataclass(frozen=True)
class Embedding:
    model: str = "letters"
    batch: int = 64

    def __post_init__(self):
        _check(bool(self.model), "model is missing")
        _check(self.batch > 0, "batch must be positive")


def chunker(options: Chunking) -> Callable[[DataFrame], DataFrame]:
    """A function from documents (doc_id, text) to chunks (doc_id, chunk_index, content); an unknown strategy is the recursive one."""
    body = F.coalesce("text", F.lit(""))
    if options.strategy == "sentence":
        cut = text.sentence_chunks(body, options.most, options.least, options.overlap)
    elif options.strategy == "fixed":
        cut = text.fixed_chunks(body, options.size, min(options.overlap, options.size - 1), min(options.least, options.size))
    else:
        return lambda docs: chunking.recursive_chunks(docs, characters=options.size, most=options.most, least=options.least, overlap=options.overlap).select("doc_id", "chunk_index", "content")
    return lambda docs: docs.select("doc_id", F.explode(cut).alias("x")).select("doc_id", "x.chunk_index", "x.content")

"""Settings of a token data set, strict about unknown names."""

from __future__ import annotations

from dataclasses import dataclass, fields

from captionloom.functions.tokens import CONTEXT_LENGTH


@dataclass(frozen=True)
class DataSettings:
    """What turns shards into batches.

    ``num_workers``, ``shuffle_buffer``, ``pin_memory`` and ``persistent_workers`` are taken from settings files as
    they stand and have no effect: workers and memory are Spark's business, and shuffles are complete. ``image_size``
    is for the caller's decoder.
    """

    shards_path: str
    tokenizer_path: str
    image_size: int = 256
    num_workers: int = 4
    batch_size: int = 8
    shuffle_buffer: int = 2048
    pin_memory: bool = True
    persistent_workers: bool = True
    latent_mode: bool = False
    caption_dropout: float = 0.1
    max_length: int = CONTEXT_LENGTH

    @classmethod
    def from_dict(cls, values: dict) -> DataSettings:
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**values)

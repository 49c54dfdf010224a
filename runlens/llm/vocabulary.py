"""A public byte-level vocabulary, read once by the driver and sent to the tasks.

The files are small and of fixed size (1.5 MB), so the broadcast is bounded.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

DEFAULT = "byte_bpe_50k.json"
#: How vocabularies of this kind cut a text (fixed value, as published with the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read(path: str | None = None) -> str:
    return Path(path or public_tokenizers.path(DEFAULT)).read_text(encoding="utf-8")


@lru_cache(maxsize=2)
def tokenizer(content: str) -> Tokenizer:
    """One per worker process."""
    return Tokenizer.from_str(content)


RANKS = "byte_bpe_50k.tiktoken"
#: The one added token of this vocabulary (fixed value).
END_OF_TEXT = "<|endoftext|>"


def read_ranks(path: str | None = None) -> str:
    return Path(path or public_tokenizers.path(RANKS)).read_text(encoding="ascii")


@lru_cache(maxsize=2)
def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    """The same vocabulary for the faster library: the same ids (tests compare them), END_OF_TEXT included."""
    table = {base64.b64decode(token): int(rank) for token, rank in map(str.split, ranks.splitlines())}
    return tiktoken.Encoding(
        "ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={END_OF_TEXT: len(table)}
    )

"""Encoders built from vocabulary files; the files stay where they are, their content is read once on the driver.

A rank file has fixed size (50,256 entries here), so its bytes travel with the task closure.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from functools import cache, partial

import public_tokenizers

MULTI = "byte_bpe_multi_50k.tiktoken"
PLAIN = "byte_bpe_50k.tiktoken"
#: the tokenizers library's file of the same vocabulary; it alone names the added tokens
PLAIN_JSON = "byte_bpe_50k.json"


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def rank_file(name: str) -> bytes:
    return read_ranks(public_tokenizers.path(name))


@cache
def ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """Added tokens of a tokenizers file, which are found in a text before anything else."""
    with open(path, encoding="utf-8") as f:
        return tuple((t["content"], t["id"]) for t in json.load(f)["added_tokens"])


def plain_added() -> tuple[tuple[str, int], ...]:
    return added_tokens(public_tokenizers.path(PLAIN_JSON))


@cache
def encoder(raw: bytes, added: tuple[tuple[str, int], ...] = ()):
    """One encoder per Python worker."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(raw), special_tokens=dict(added))


def encode_all(raw: bytes, added: tuple[tuple[str, int], ...]) -> Callable[[str], list[int]]:
    """Ids of a text, added tokens in it as their own ids."""
    return partial(encoder(raw, added).encode, allowed_special="all")


@cache
def pieces():
    """The splitter of a text into pre-tokens."""
    import regex

    return regex.compile(public_tokenizers.PATTERN).findall

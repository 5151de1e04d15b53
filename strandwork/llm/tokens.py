"""Token ids of a public byte-level vocabulary, inside Spark tasks."""

from __future__ import annotations

import base64
import functools
import json
from pathlib import Path

import numpy as np


@functools.lru_cache(maxsize=2)
def encoder(path: str, ranks: str | None = None):
    """text -> uint32 ids, as ``tokenizers`` gives them with add_special_tokens=False.

    ``path`` names a byte-level BPE file of the ``tokenizers`` library. If ``ranks`` names the same vocabulary as ranks
    (a .tiktoken file), ids come from there, five times as fast and the same (the tests compare the two); texts with a
    special token's string in them still go through ``tokenizers``.
    """
    held: list = []

    def slow(text: str) -> np.ndarray:
        if not held:  # large, and seldom needed where there are ranks
            from tokenizers import Tokenizer

            held.append(Tokenizer.from_file(path))
        return np.asarray(held[0].encode(text, add_special_tokens=False).ids, np.uint32)

    if ranks is None:
        return slow
    import public_tokenizers
    import tiktoken

    special = [t["content"] for t in json.loads(Path(path).read_bytes()).get("added_tokens", [])]
    pieces = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(ranks).read_bytes().splitlines())}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pieces, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return slow(text)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode


def default_paths() -> tuple[str, str]:
    """The tokenizer's file, and the file of the same vocabulary as ranks."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def paths(tokenizer: str | None, ranks: str | None) -> tuple[str, str | None]:
    """What was asked for; both defaults if no tokenizer was."""
    return default_paths() if tokenizer is None else (tokenizer, ranks)


def small_ids(ids: np.ndarray) -> np.ndarray:
    """ids as unsigned 16-bit numbers; raises if one doesn't fit."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("token ids of 65,536 and more don't fit 16 bits")
    return ids.astype("<u2")

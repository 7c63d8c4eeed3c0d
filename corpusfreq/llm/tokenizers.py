"""Where the public tokenizer files are."""

from __future__ import annotations

import os


def model_file(name: str = "piece_bpe_32k.model") -> str:
    """The public BPE model; the environment's ``PIECE_MODEL`` names another file."""
    named = os.environ.get("PIECE_MODEL")
    if named:
        return named
    return public_file(name)


def public_file(name: str) -> str:
    """A file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)

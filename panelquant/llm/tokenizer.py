"""Where the public tokenizer files lie."""

from __future__ import annotations

import os


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer's file; the folder in ``PUBLIC_TOKENIZERS`` comes before the installed package."""
    folder = os.environ.get("PUBLIC_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)

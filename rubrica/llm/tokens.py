"""Token ids of whole texts with a public byte-level vocabulary.

Texts of plain characters take the faster of the two libraries that read the vocabulary; texts with other
characters, or with the vocabulary's own control string, take the tokenizer file itself.
"""

from __future__ import annotations

import base64
import re

import numpy as np

CONTROL = "<|endoftext|>"
_PLAIN = re.compile(r"[\n\t\x20-\x7e\u00a1-\u00ac\u00ae-\u024f]*")


def vocabulary_files() -> tuple[str, str]:
    """Default places of the byte-level vocabulary, as tokenizer file and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of texts, equal to those of the tokenizer file."""

    def __init__(self, tokenizer_file: str, ranks_file: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_file)
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        #: Bytes of each id, to place tokens in the text.
        self.widths = np.zeros(max(ranks.values()) + 2, np.int64)
        for piece, rank in ranks.items():
            self.widths[rank] = len(piece)
        self.widths[-1] = len(CONTROL)

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a text; null is empty."""
        if not text:
            return np.zeros(0, np.uint32)
        if CONTROL in text or not _PLAIN.fullmatch(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.coder.encode_to_numpy(text, disallowed_special=())


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(files: tuple[str, str]) -> Encoder:
    """One encoder per Python worker."""
    if files not in _ENCODERS:
        _ENCODERS[files] = Encoder(*files)
    return _ENCODERS[files]

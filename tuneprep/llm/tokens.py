"""Byte-level BPE ids of whole texts.

The ids are those of the tokenizer file. Where the file comes with the rank file of the same
vocabulary, texts go through the rank library, which gives the same ids in a fifth of the time;
texts that hold a special token's string go through the tokenizer itself.
"""

from __future__ import annotations

from array import array


class TextEncoder:
    """Encodes whole texts without adding special tokens."""

    def __init__(self, path: str | None = None, ranks: str | None = None):
        from tokenizers import Tokenizer
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path("byte_bpe_50k.json")
            ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = self._ranked(ranks) if ranks else None

    @staticmethod
    def _ranked(path: str):
        import base64

        import public_tokenizers
        import tiktoken
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                 special_tokens={}).encode_ordinary

    def ids(self, text: str) -> list[int]:
        if self.ranked is None or any(s in text for s in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.ranked(text)

    def encode(self, text: str) -> bytes:
        """Ids as 4 bytes each."""
        return array("I", self.ids(text)).tobytes() if text else b""


_ENCODERS: dict[str | None, TextEncoder] = {}


def encoder(path: str | None = None) -> TextEncoder:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]

"""Token ids of a byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
import sys
from array import array
from functools import lru_cache

#: A space that starts a token for certain: the pre-tokeniser takes it with what follows.
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")


def default_paths() -> tuple[str, str]:
    """The vocabulary, and the same as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class TextTokenizer:
    """``ids(text)``: the ids as little-endian unsigned 32-bit bytes, as the vocabulary's own tokenizer gives them.

    Text of Latin script goes through the ranks, which give the vocabulary's ids some times faster; chunks with other
    characters, whose classes the two libraries may see differently, go through the vocabulary itself, as do whole texts that hold
    an added token's string.
    """

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(vocabulary)
        added = [re.escape(a.content) for a in self.full.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)")
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        try:
            if self.added.search(text):
                return self._bytes(array("I", self.full.encode(text, add_special_tokens=False).ids))
            text.encode("latin-1")
            out = array("I", self.fast(text))
        except UnicodeEncodeError:
            out, start = array("I"), 0
            for end in [*(m.start() for m in _BOUNDARY.finditer(text)), len(text)]:
                chunk, start = text[start:end], end
                latin = chunk.isascii() or max(chunk) < "ɐ"
                out.extend(self.fast(chunk) if latin else self.full.encode(chunk, add_special_tokens=False).ids)
        return self._bytes(out)

    @staticmethod
    def _bytes(out: array) -> bytes:
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str, ranks: str) -> TextTokenizer:
    """One for each worker process."""
    return TextTokenizer(vocabulary, ranks)

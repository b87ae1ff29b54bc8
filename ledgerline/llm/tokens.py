"""Token ids of whole texts under the public 50k byte-level BPE.

The ids are those of the ``tokenizers`` library for byte_bpe_50k.json (tests hold them against it);
they come from tiktoken's ranks of the same vocabulary, which needs a quarter of the time, and for
texts with its special token from ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
from array import array

SPECIAL = "<|endoftext|>"
# Fixed value: the vocabulary's public pattern, possessive where that changes nothing.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class Tokens:
    def __init__(self, json_path: str, ranks_path: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._json, self._whole = json_path, None

    def ids(self, text: str) -> list[int]:
        if SPECIAL not in text:
            return self._encode(text)
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self._json)
        return self._whole.encode(text, add_special_tokens=False).ids

    def packed(self, text: str, end: int | None = None) -> bytes:
        """The ids as little-endian 32-bit numbers, then ``end`` if given."""
        out = array("I", self.ids(text))
        if end is not None:
            out.append(end)
        return out.tobytes()


_made: dict[tuple[str, str], Tokens] = {}


def tokens(json_path: str | None = None, ranks_path: str | None = None) -> Tokens:
    """The worker's encoder for the vocabulary files given, or the installed ones."""
    import public_tokenizers

    key = (json_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    if key not in _made:
        _made[key] = Tokens(*key)
    return _made[key]

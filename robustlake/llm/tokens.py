"""Token ids of texts by a public byte-level BPE file, fast enough for whole corpora.

``Encoder`` gives exactly the ids that the tokenizers library gives for the
file (tests hold it against that library). The file's vocabulary is handed to
tiktoken, which encodes the same merges several times as fast. The look-ahead
of the pre-tokenizer only matters where two white-space characters meet; texts
without such a place are cut by the pattern without it, at twice the speed.
Texts that hold a special token's text go to the tokenizers library itself.
"""

from __future__ import annotations

import json
import sys
from array import array

#: Fixed value: how byte-level BPE of this family cuts texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts without two white-space characters in a row.
EVEN_PATTERN = PATTERN.replace(r"|\s+(?!\S)", "")
_SPACES = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE files write printable bytes as themselves and the others as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import numpy as np
        import tiktoken

        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        self._path, self._np = path, np
        self._special = [t["content"] for t in stored.get("added_tokens", [])]
        of = _byte_of_char()
        ranks = {bytes(of[c] for c in t): i for t, i in stored["model"]["vocab"].items() if t not in self._special}
        encoding = tiktoken.Encoding("own", pat_str=EVEN_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._even, self._whole, self._own = encoding, None, None

    @property
    def _any(self):
        """The encoding that also looks ahead; made when a text needs it."""
        if self._whole is None:
            import tiktoken

            self._whole = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self._even._mergeable_ranks, special_tokens={})
        return self._whole

    def _with_special(self, text: str) -> bytes:
        if self._own is None:
            from tokenizers import Tokenizer

            self._own = Tokenizer.from_file(self._path)
        return self._np.array(self._own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids as unsigned 32-bit numbers in this machine's order (little-endian)."""
        if not text:
            return b""
        if any(s in text for s in self._special):
            return self._with_special(text)
        met = [w for w in _SPACES if w in text]
        cut = self._any if any(a + b in text for a in met for b in met) else self._even
        return array("I", cut.encode_ordinary(text)).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

"""Encoding with the tokenizers library, a chunk of text at a time, so that repeated words are encoded once.

A byte-level pre-tokenizer never lets a token cross from a non-blank to a following space,
so `text` may be cut before each space that stands between non-blanks, and each chunk may be
encoded by itself. Texts with a space beside another blank are encoded whole, and so are
texts that hold an added token's literal, which is that token as the library has it.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

#: Chunks kept by a Python worker; beyond that the store is emptied.
KEPT = 1_000_000
_RARE_BLANK = re.compile("[\\t\\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: What is one pre-token each: Latin letters, digits, a run of these marks, a lone line feed.
_PRE_TOKEN = "[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[.,;:!?()*#%-]+|\\n(?!\\n)"
_PIECES = re.compile(_PRE_TOKEN)
_encoders: dict[tuple[str, int], ChunkEncoder] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class ChunkEncoder:
    def __init__(self, path: str, most: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.model = self.whole.model
        # cutting at spaces is right for this kind of vocabulary only; any other is encoded whole
        pre = json.loads(self.whole.pre_tokenizer.__getstate__()) if self.whole.pre_tokenizer is not None else {}
        self.cuts = type(self.model).__name__ == "BPE" and self.whole.normalizer is None and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) == ("ByteLevel", False, True)
        self.letters = _byte_letters()
        self.kept: dict[str, bytes] = {}
        self.most = most

    def _pack(self, ids: list[int]) -> bytes:
        packed = array("I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _chunk(self, word: str) -> bytes:
        pieces = [word] if word.isascii() and word.isalpha() else _PIECES.findall(word)
        if "".join(pieces) == word:  # the pre-tokens are plain: the model alone will do
            letters, out = self.letters, []
            for k, piece in enumerate(pieces):
                mapped = piece if piece.isascii() and piece != "\n" else "".join([letters[b] for b in piece.encode()])
                out += [t.id for t in self.model.tokenize(mapped if k else letters[32] + mapped)]
            return self._pack(out)
        return self._pack(self.whole.encode(" " + word, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null is empty."""
        if not text:
            return b""
        if not self.cuts or "  " in text or "\n " in text or " \n" in text or text[0] == " " or text[-1] == " " or _RARE_BLANK.search(text) or any([x in text for x in self.added]):
            return self._pack(self.whole.encode(text, add_special_tokens=False).ids)
        first, *rest = text.split(" ")
        kept = self.kept
        out = [self._pack(self.whole.encode(first, add_special_tokens=False).ids)]
        for word in rest:
            ids = kept.get(word)
            if ids is None:
                if len(kept) >= self.most:
                    kept.clear()
                ids = kept[word] = self._chunk(word)
            out.append(ids)
        return b"".join(out)


def encoder(path: str, most: int = KEPT) -> ChunkEncoder:
    """One encoder for each vocabulary and Python worker, that keeps up to `most` chunks (200 bytes or so each)."""
    if (path, most) not in _encoders:
        _encoders[path, most] = ChunkEncoder(path, most)
    return _encoders[path, most]

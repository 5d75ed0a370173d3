"""Exact encoder around the tokenizers library with a bounded word memo.

The library's BPE with word ends treats every white-space-delimited word on its own, so the ids of
a text are the joined ids of its words.  That holds for texts of plain Latin characters; any other
text (combining marks, special-token strings, rare separators) goes to the library whole.
"""

from __future__ import annotations

import json
import re

import numpy as np

_UNSAFE = re.compile("[\x1c-\x1fİ̀-\U0010ffff]|<\\|")


class _Memo(dict):
    """word -> ids packed as little-endian uint32; two generations of at most MAX words each."""

    MAX, LONGEST = 200_000, 48

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old, self.most = encode, {}, self.MAX

    def __missing__(self, word):
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


_PUNCT = ".,;:!?)\"'-"


class Encoder:
    """encode(text) equals Tokenizer.encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm, pre = json.dumps(spec.get("normalizer")), json.dumps(spec.get("pre_tokenizer"))
        self.by_word = "Lowercase" in norm and '"invert": true' in pre and "Metaspace" not in pre
        # one pre-token per run of letters: such a word can go to the model at once
        self.letters = _byte_letters() if self.by_word and '"ByteLevel"' in pre and "[\\\\p{L}]+" in pre else None
        self.model = self.tok.model
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size(True))]
        self.memo = _Memo(self._word)
        self.decoder = spec.get("decoder")
        self._tokens = None

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if self.letters is None:
            return self._whole(word)
        if word.isalpha():
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            return b"".join([self.id_bytes[t.id] for t in self.model.tokenize(shown)])
        core = word.rstrip(_PUNCT)
        if core != word and core.isalpha():
            return self.memo[core] + self.memo[word[len(core) :]]
        return self._whole(word)

    def packed(self, text: str | None) -> bytes:
        """The ids as little-endian uint32; null is the empty text."""
        if not text:
            return b""
        if not self.by_word or _UNSAFE.search(text):
            return self._whole(text)
        return b"".join(map(self.memo.__getitem__, text.lower().split()))

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")

    def decode(self, ids) -> str:
        """Equals Tokenizer.decode(ids, skip_special_tokens=False)."""
        ids = ids.tolist() if hasattr(ids, "tolist") else list(ids)
        if self.decoder is not None:
            return self.tok.decode(ids, skip_special_tokens=False)
        if self._tokens is None:
            self._tokens = [self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size(True))]
        return " ".join(map(self._tokens.__getitem__, ids))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, words: int = _Memo.MAX) -> Encoder:
    """One encoder per worker process and file; words: the size of a generation of its memo."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].memo.most = words
    return _ENCODERS[path]

"""Encoders inside tasks. Each Python worker loads a vocabulary once; ids of words are kept by each task, within a bound."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

from turnledger.llm.text import Learned


#: White space as the encoders' patterns know it, in runs that their splitters cannot take whole.
LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")


class ByteEncoder:
    """``encode_ordinary`` and ``decode_bytes`` of a byte-level encoding, for texts of any kind.

    The splitter walks back through a run of white space and fails on very long ones. Of a run, all but the last character are one
    piece (all of it at the end of the text) and the last goes on with what follows, so long runs are cut out and encoded as that piece.
    """

    def __init__(self, encoding):
        self.encoding, self.decode_bytes = encoding, encoding.decode_bytes

    def encode_ordinary(self, text: str) -> list[int]:
        plain, out, at = self.encoding.encode_ordinary, [], 0
        if len(text) >= 10_000:
            for run in LONG_SPACE.finditer(text):
                end = run.end() - (run.end() < len(text))
                out += plain(text[at : run.start()])
                out += self.encoding._encode_single_piece(text[run.start() : end])
                at = end
        return out + plain(text[at:]) if at else plain(text)


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    """A byte-level encoding; its ids end at 50,255."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return ByteEncoder(tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))


class WordEncoder:
    """The ids that the tokenizer file gives, as little-endian 32-bit bytes.

    The vocabulary's splitter works on each text alone, so texts in Latin letters are cut into its parts here and each part's
    ids come from a cache, or from the library's model on first sight. Words with their punctuation are not kept beside their
    parts: they would fill the cache, and parts would be asked again. All other texts (other scripts, control characters, special
    tokens) are encoded whole by the library.
    """

    OTHER = re.compile(r"[^\t-\r -~¡-įı-ſ]")
    PARTS = re.compile(r"[a-zªµºß-öø-ſ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9²³¹¼-¾]|[^\t-\r a-zªµºß-öø-ſ0-9²³¹¼-¾]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.forget()

    def forget(self) -> None:
        """Drops the kept ids; tasks call it when they end."""
        self.parts = Learned(self._part, 64 << 20)

    def _part(self, part: str) -> bytes:
        letters = part if part.isalpha() and part.isascii() else self.letters.pre_tokenize_str(part)[0][0]
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        get, cut = self.parts.__getitem__, self.PARTS.findall
        return [self._whole(t) if "<|" in t or self.OTHER.search(t) else b"".join(map(get, cut(t.lower()))) for t in texts]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)

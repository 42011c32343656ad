"""Token ids of whole texts with a public tokenizer, a vocabulary file given by path.

Added tokens of the file are cut out of the raw text first, as the tokenizer does. The rest of
such a vocabulary's pipeline (``PIPELINE``) maps characters and never joins across white space, so
a text's ids are its blank-delimited chunks' ids in a row. Each worker keeps a cache from chunk to
ids, bounded in bytes; only chunks that it has not met go to the tokenizer's model, and long ones
are never kept. A file with any other pipeline is encoded by the tokenizer itself. A test holds
this against the tokenizer's own ``encode``.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: About so many bytes of chunks and ids are kept by one worker; the cache starts anew when it is
#: full. What an entry takes besides its texts, and the longest chunk (characters) that is kept.
CACHE_BYTES, ENTRY_BYTES, KEPT_CHUNK = 192 << 20, 190, 64
#: The splitter of the vocabulary file, with its \s spelled out for this one's engine.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pipeline that encoding by chunks is right for.
PIPELINE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLITTER}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None,
}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Chunks(dict):
    """Chunk of text without blanks -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.size = max(self.whole.get_vocab(with_added_tokens=True).values()) + 1
        added = config["added_tokens"]
        plain = not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.by_chunk = plain and all(config[k] == v for k, v in PIPELINE.items())
        self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in added}
        longest_first = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.cut = re.compile("({})".format("|".join(longest_first))).split
        self.find = regex.compile(SPLITTER.replace(r"\s", WHITE)).findall
        self.letters = byte_letters()
        self.held = 0

    def __missing__(self, chunk: str) -> bytes:
        words = self.find(chunk)
        if words == [chunk]:
            plain = chunk.isascii() and chunk.isprintable()
            letters = chunk if plain else chunk.encode().decode("latin-1").translate(self.letters)
            out = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
        else:
            out = b"".join([self[w] for w in words])
        if len(chunk) <= KEPT_CHUNK:
            self.held += ENTRY_BYTES + 4 * len(chunk) + len(out)
            if self.held > CACHE_BYTES:
                self.clear()
                self.held = 0
            self[chunk] = out
        return out

    def run(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return b"".join(map(self.__getitem__, text.replace("\n", " ").lower().split(" ")))


@lru_cache(2)
def chunks(path: str) -> Chunks:
    return Chunks(path)


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a vocabulary file, added tokens included."""
    return chunks(path).size


def encode(text: str | None, path: str, end_id: int | None = END_ID) -> bytes:
    """The ids of a whole text (null: empty) and the end id, as little-endian unsigned 32-bit
    integers. Strings of added tokens give those tokens' ids, as the tokenizer does by default."""
    known = chunks(path)
    text = text or ""
    if not known.by_chunk:
        body = np.array(known.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    elif any(content in text for content in known.added):
        body = b"".join([known.added[part] if i % 2 else known.run(part) for i, part in enumerate(known.cut(text))])
    else:
        body = known.run(text)
    return body if end_id is None else body + int(end_id).to_bytes(4, "little")

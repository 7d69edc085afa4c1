"""Fast whole-text encoding with a `tokenizers` file: chunks that cannot interact are remembered."""

from __future__ import annotations

import json
import os
import re
from array import array

from .common import worker_state

#: White space other than blank and line feed; a chunk that holds some sends its text the long way.
_OTHER_SPACE = re.compile(r"[^\S \n]")
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: A run of Latin letters before an ASCII character that isn't one is a pre-token by itself; else all up to white space.
_RUN = f"[{_LATIN}]++(?![^\\x00-@\\[-`{{-\\x7f])"
_LEADING = re.compile(f" ?{_RUN}| ?[^ \\n]+|[ \\n]+(?![^ \\n])|[ \\n]+")
_DROPPED = re.compile(f"{_RUN}|[^ \\n]+")
_WORD = re.compile(f" ?[{_LATIN}]+")
#: Bytes that a kept chunk of a dozen characters and its ids take.
_ENTRY = 215


def _byte_characters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


def _mode(spec: dict) -> str:
    """How texts may be cut: "dropped" (white space vanishes), "leading" (a blank leads its word), "whole"."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if any(t["lstrip"] or t["rstrip"] or t["normalized"] or " " in t["content"] or "\n" in t["content"] for t in spec["added_tokens"]):
        return "whole"
    if pre.get("type") == "ByteLevel" and norm is None and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "leading"
    steps = pre.get("pretokenizers") or [{}]
    kinds = {n["type"] for n in (norm or {}).get("normalizers", [])}
    if (
        steps[0].get("type") == "Split"
        and steps[0].get("behavior") == "Removed"
        and steps[0].get("invert")
        and "\\s" in str(steps[0]["pattern"])
        and kinds <= {"NFC", "Replace", "Lowercase"}
        and all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in steps[1:])
    ):
        return "dropped"
    return "whole"


class _Known(dict):
    """Ids of chunks; those it lacks are learned when they are asked for."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, chunk: str) -> bytes | None:
        value = self[chunk] = self.learn(chunk)
        return value


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, without special tokens added.

    The result is that of the library on the whole text. Where the tokenizer's own splitting
    never joins characters across a chunk's border, each distinct chunk goes through the
    library once and is kept; a chunk that is one word goes to the library's model straight.
    Chunks are kept up to about `limit` bytes, and as many from before in case they come again.
    """

    def __init__(self, path: str, limit: int = 96 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.mode = _mode(json.load(f))
        self.chunks = max(1, limit // _ENTRY)
        self.model, self.stand_ins = self.tokenizer.model, _byte_characters()
        self.blank = self.stand_ins[32]
        self.known = _Known(self._learn)
        self.before: dict[str, bytes | None] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        if self.mode == "dropped":
            word = word.lower()
        if word.isascii():  # letters stand for themselves
            word = word.replace(" ", self.blank)
        else:
            word = word.encode().decode("latin-1").translate(self.stand_ins)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _learn(self, chunk: str) -> bytes | None:
        """Ids of a chunk; None where its white space sends the whole text the long way."""
        found = self.before.get(chunk)
        if found is not None:
            return found
        letters = chunk[1:] if chunk[0] == " " else chunk
        if letters.isascii() and letters.isalpha() or _WORD.fullmatch(chunk):
            return self._word(chunk)
        if self.mode == "leading" and _OTHER_SPACE.search(chunk):
            return None
        return self._library([chunk])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.mode == "whole":
            return self._library(texts)
        find = (_DROPPED if self.mode == "dropped" else _LEADING).findall
        if len(self.known) > self.chunks:
            self.before, self.known = self.known, _Known(self._learn)
        get, out = self.known.__getitem__, []
        for text in texts:
            try:
                out.append(b"".join(map(get, find(text))))
            except TypeError:
                out.append(self._library([text])[0])
        return out


def encoder(path: str, limit: int = 96 << 20) -> Encoder:
    """The worker's encoder of this file, which keeps up to twice `limit` bytes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return worker_state(f"encoder {limit} {path}", lambda: Encoder(path, limit))

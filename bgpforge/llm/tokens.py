"""Batch encoding with public tokenizers inside Arrow functions.

A text is cut at blanks that stand alone between two characters which are no white space. No token of the byte-level
vocabulary spans such a blank (white space only begins a token), and special strings hold none, so the parts can be
encoded apart. A part that a worker has seen before is remembered in a bounded table.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

from . import common

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Pieces of parts that can be encoded apart as well, as letters never share a token with what follows them, and a lone line feed none with anything.
_PIECE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[.,;:!?|*&%$#()\"-]+\n?|\n")
_ODD = re.compile(r"\s |  | \s")
#: Entries that a worker remembers; beyond it the table starts anew. Parts of more than LONGEST characters are not remembered.
REMEMBERED, LONGEST = 400_000, 256
#: Slots, a power of two, that tell by a part's hash whether it was seen: most parts come once and need no entry.
SLOTS = 1 << 21
#: Characters of one step: longer texts go through in several steps.
STEP = 1 << 20


def parts(text: str) -> list[str]:
    """The parts of a text that can be encoded apart, in order; joined they are the text."""
    if not text:
        return []
    cut = _CUT.split(text) if _ODD.search(text) or text[0].isspace() or text[-1].isspace() else text.split(" ")
    return [cut[0], *(" " + x for x in cut[1:])]


class _Known(dict):
    """Ids of parts seen before; a new one is put together from its pieces, or encoded."""

    def __init__(self, model):
        super().__init__()
        self.model, self.words = model, model.model
        self.byte = byte_signs()
        self.seen = bytearray(SLOTS)

    def clear(self) -> None:
        super().clear()
        self.seen = bytearray(SLOTS)

    def __missing__(self, part: str) -> bytes:
        word = part[1:] if part[0] == " " else part
        pieces = [part] if word.isascii() and word.isalpha() else _PIECE.findall(part)
        if len(pieces) == 1 and len(pieces[0]) == len(part):
            # One run of letters, or of signs: a single word of the vocabulary's model.
            out = array("I", [x.id for x in self.words.tokenize(self._signs(part))]).tobytes() if part[-1:] != "\n" else self._encode(part)
        elif len(pieces) > 1 and sum(map(len, pieces)) == len(part) and "\n\n" not in part:
            out = b"".join([self[x] for x in pieces])
        else:
            out = self._encode(part)
        slot = hash(part) & (SLOTS - 1)
        if not self.seen[slot]:
            self.seen[slot] = 1
        elif len(part) <= LONGEST:
            self[part] = out
        return out

    def _signs(self, part: str) -> str:
        """The signs of the bytes of a run of letters or signs, without line feeds."""
        return part.replace(" ", self.byte[0x20]) if part.isascii() else "".join([self.byte[b] for b in part.encode()])

    def _encode(self, part: str) -> bytes:
        return array("I", self.model.encode_batch_fast([part], add_special_tokens=False)[0].ids).tobytes()


def byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself where it prints, else the next sign from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in prints}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(0x100 + n)
    return [out[b] for b in range(256)]


class Encoder:
    """Encodes whole texts; `counts` gives lengths only, `ids` little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = path
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            import json

            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            pre = json.loads(self.model.to_str()).get("pre_tokenizer") or {}
            self.apart = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and self.model.normalizer is None
            self.known = _Known(self.model)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        if self.path.endswith(".model"):
            return self.model.encode(texts, num_threads=1)
        return [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """For texts of bounded size together (see `by_bytes`)."""
        if not self.can_cut():
            return [array("I", x).tobytes() for x in self._encode(texts)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        get = self.known.__getitem__
        return [b"".join(map(get, parts(x))) for x in texts]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) >> 2 for x in self.ids(texts)]

    def can_cut(self) -> bool:
        return not self.path.endswith(".model") and self.apart

    def pieces(self, text: str) -> list[str]:
        """A long text cut at safe boundaries into steps of about STEP characters; whole where none is safe."""
        if len(text) <= STEP or not self.can_cut():
            return [text]
        out, at = [], 0
        while len(text) - at > STEP:
            hit = _CUT.search(text, at + STEP)
            if not hit:
                break
            out.append(text[at : hit.start()])
            at = hit.start()
        return [*out, text[at:]]


def by_bytes(texts, encoder: Encoder):
    """Yield (index, ids as bytes) for every text, in order, encoding batches of about STEP characters."""
    held, size = [], 0
    for i, text in enumerate(texts):
        text = text or ""
        steps = encoder.pieces(text)
        if len(steps) > 1:
            yield from _flush(held, encoder)
            held, size = [], 0
            yield i, b"".join(encoder.ids([x])[0] for x in steps)
            continue
        held.append((i, text))
        size += len(text)
        if size >= STEP:
            yield from _flush(held, encoder)
            held, size = [], 0
    yield from _flush(held, encoder)


def _flush(held, encoder: Encoder):
    if held:
        yield from zip([i for i, _ in held], encoder.ids([x for _, x in held]), strict=True)


def encoder(path: str) -> Encoder:
    """One for each worker and file, until the worker turns to another operator."""
    encoders = common.remembered("tokens")
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

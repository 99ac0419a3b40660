"""A cached front end to the public word-level BPE vocabulary.

The vocabulary's own pre-tokeniser never lets a token cross white space or
a change between letters, digits and other signs, so the ids of a word do
not depend on its neighbours.  Encoding a corpus therefore comes down to
encoding each distinct word once.  Texts are split and their repeats found
by Arrow, some megabytes at a time; only what is distinct there is looked up
among the words that are kept.  Texts with characters outside the ranges
checked below, with letters whose lower case lies outside them, or with one of
the vocabulary's control strings go to the library whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._common import give_back

#: Characters that are encoded together, more where one text has more.
PART = 2 << 20
#: Characters for which lower-casing, composition and the letter/digit split are done here.
PLAIN = "\x09-\x0d\x20-\x7e\xa1-ɏ‐-‧‰-⁞€"
_OUTSIDE = f"[^{PLAIN}]"
#: Characters of those ranges whose lower case is not one character of them.
_LEAVING = frozenset(c for c in map(chr, range(0xA1, 0x250)) if len(c.lower()) != 1 or re.search(_OUTSIDE, c.lower()))
_OTHER = re.compile("[^\x09-\x0d\x20-\x7e‐-‧‰-⁞€" + "".join(c for c in map(chr, range(0xA1, 0x250)) if c not in _LEAVING) + "]")
_LETTER, _DIGIT = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The vocabulary's split rule for lower-cased text in those ranges.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\\s{_LETTER}{_DIGIT}]+")
_PIECE_OR_END = re.compile(f"{_PIECE.pattern}|\n")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a visible character: itself where printable, else the next free one from 256."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _spread(flat: np.ndarray, stops: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` between neighbouring ``stops``, in the order of ``which``, and where each begins; the last number is where all end."""
    n = np.diff(stops)[which]
    ends = np.cumsum(np.append(0, n))
    return flat[np.repeat(stops[:-1][which] - ends[:-1], n) + np.arange(ends[-1])], ends


class WordEncoder:
    """Ids, and where asked for character spans, of whole texts.

    ``cache_size`` bounds the pieces of words kept at a time (under 200 bytes each); it costs
    time when too small, but never changes a result.
    """

    def __init__(self, path: str, cache_size: int = 250_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.control = [t["content"] for t in spec["added_tokens"]]  # found as they are written, before any normalising
        spec |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.words = Tokenizer.from_str(json.dumps(spec))
        self.cache_size = cache_size
        self.pieces: dict[str, bytes] = {}
        self.letters = _byte_letters() | {32: " "}
        ends = np.zeros(max(vocab.values()) + 1, bool)
        self.n_bytes = np.zeros(len(ends), np.int64)
        for token, i in vocab.items():
            ends[i] = token.endswith("</w>")
            self.n_bytes[i] = len(token.removesuffix("</w>"))
        self.ends = ends

    def _encode_words(self, words: list[str]) -> list[bytes]:
        text = " ".join(words).encode().decode("latin1").translate(self.letters)
        ids = np.asarray(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        flat, stops = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *stops], stops)]

    def _ids_of_pieces(self, pieces: list[str]) -> list[bytes]:
        if len(self.pieces) > self.cache_size:
            self.pieces.clear()
        got = [*map(self.pieces.get, pieces)]
        missing = [i for i, g in enumerate(got) if g is None]
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            new = [pieces[i] for i in part]
            for i, piece, ids in zip(part, new, self._encode_words(new), strict=True):
                got[i] = self.pieces[piece] = ids
        return got

    def _ids_of_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct chunks one after another, and where each chunk's begin; the last number is where all end."""
        split = pa.array(_PIECE_OR_END.findall("\n".join([*chunks, ""])), pa.large_string()).dictionary_encode()
        pieces = split.dictionary.to_numpy(zero_copy_only=False).tolist()
        end = pieces.index("\n") if chunks else -1
        known = self._ids_of_pieces([p for p in pieces if p != "\n"])
        if chunks:
            known.insert(end, b"")
        flat, stops = np.frombuffer(b"".join(known), "<u4"), np.cumsum([0, *map(len, known)]) >> 2
        which = split.indices.to_numpy(zero_copy_only=False)
        ids, ends = _spread(flat, stops, which)
        return ids, np.append(0, ends[1:][which == end])

    def _lowered(self, text: str) -> str | None:
        """The text in lower case, or None where the library has to take it whole."""
        if _OTHER.search(text) or any(c in text for c in self.control) or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return None
        return text.lower()

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers.

        A chunk is looked up once for all of its places in the given texts; better some
        megabytes of them at a time (``in_parts``) than few.
        """
        low = [self._lowered(t) for t in texts]
        split = pc.ascii_split_whitespace(pa.array([t for t in low if t is not None], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        ids, stops = _spread(*self._ids_of_chunks(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy(zero_copy_only=False))
        ids = ids.tobytes()
        ends = iter((4 * stops[split.offsets.to_numpy(zero_copy_only=False)]).tolist())
        out, at = [], next(ends)
        for text, plain in zip(texts, low):
            if plain is None:
                out.append(np.asarray(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes())
            else:
                frm, at = at, next(ends)
                out.append(ids[frm:at])
        return out

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and end character of every token of ``ids``, in the text as given.

        The tokens of a plain text tile its bytes other than white space, so their
        byte lengths place them.
        """
        if (low := self._lowered(text)) is None or len(low) != len(text):
            spans = np.asarray(self.whole.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
            return spans[:, 0], spans[:, 1]
        code = np.frombuffer(low.encode("utf-32-le"), "<u4")
        seen = np.flatnonzero((code != 32) & ((code < 9) | (code > 13)))
        code = code[seen]
        of_byte = np.repeat(seen, 1 + (code > 0x7F) + (code > 0x7FF))
        to = np.cumsum(self.n_bytes[np.frombuffer(ids, "<u4")])
        frm = to - self.n_bytes[np.frombuffer(ids, "<u4")]
        return of_byte[frm], of_byte[to - 1] + 1


def in_parts(texts: list[str | None], most: int = PART) -> Iterator[tuple[int, list[str]]]:
    """Parts of the texts, null ones empty, each with the place it begins at; a part has ``most`` characters, or one text."""
    part: list[str] = []
    held = 0
    for i, text in enumerate(texts):
        text = text or ""
        if part and held + len(text) > most:
            yield i - len(part), part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield len(texts) - len(part), part


_KEPT: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, so that its cache outlives a task."""
    if path not in _KEPT:
        give_back()
        _KEPT[path] = WordEncoder(path)
    return _KEPT[path]

"""A table of words seen before, in front of an encoder that is slow on running text."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than blanks and line ends. Unicode's White_Space and the four separators.
ODD_SPACE = "[\t\x0b\x0c\r\x1c\x1d\x1e\x1f\u0085   -     　]"
CUT = re.compile(r"(?<=\S) ")
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Stands before the first word of a text, which has no blank before it.
FIRST = "\r"


class WordTable:
    """Encodes texts word by word, for encoders that cut a text where a blank follows something visible.

    ``encode_words(words)`` encodes strings without white space but for a leading blank, and
    ``encode_text(text)`` any string; both give bytes that may be joined. Texts whose words stand
    apart by single blanks and line ends are put together from words; all others are cut after
    visible characters only, and encoded in those stretches. The table keeps ``limit`` words; when
    full, it keeps those of the texts at hand.
    """

    def __init__(self, encode_words: Callable[[list[str]], list[bytes]], encode_text: Callable[[str], bytes], limit: int, longest: int = 64):
        self.encode_words, self.encode_text, self.limit, self.longest = encode_words, encode_text, limit, longest
        self.line_end = encode_text("\n")
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts, "")
        plain = pc.invert(pc.match_substring_regex(texts, r"^[ \n]|[ \n][ \n]|[ \n]\z|^\z|" + ODD_SPACE))
        at = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        out: list[bytes] = [b""] * len(texts)
        if len(at):
            marked = pc.binary_join_element_wise(FIRST, pc.replace_substring(texts.take(pa.array(at)), "\n", " \n"), "")
            words = pc.split_pattern(marked, " ")
            coded = words.flatten().dictionary_encode()
            table = pa.array(self._looked_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
            joined = table.take(coded.indices)
            ends = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, 8 * joined.offset)
            cuts = ends[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
            raw = memoryview(joined.buffers()[2] or b"")
            for i, a, b in zip(at.tolist(), cuts, cuts[1:]):
                out[i] = raw[a:b].tobytes()
        for i in np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist():
            if text := texts[i].as_py():
                pieces = CUT.split(text)
                out[i] = self.encode_text(pieces[0]) + b"".join([self.encode_text(" " + p) for p in pieces[1:]])
        return out

    def _looked_up(self, words: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known = {w: self.known[w] for w in words if w in self.known}
        known = self.known
        found = list(map(known.get, words))
        gone = [i for i, b in enumerate(found) if b is None]
        stems = [self._stem(words[i]) for i in gone]
        new = [w for w in dict.fromkeys(stems) if w not in known]
        got = self.encode_words([w[1:] if w[0] in "\n\r" else " " + w for w in new])
        got = [self.line_end + b if w[0] == "\n" else b for w, b in zip(new, got)]
        fresh = dict(zip(new, got))
        for i, stem in zip(gone, stems):
            word = words[i]
            if len(stem) == len(word):
                found[i] = fresh[word]
            elif stem in fresh:
                found[i] = fresh[stem] + self._tail(word[len(stem) :])
            else:  # seen before with other marks: likely to come again
                found[i] = known[word] = known[stem] + self._tail(word[len(stem) :])
        if any(len(w) > self.longest for w in new):
            fresh = {w: b for w, b in fresh.items() if len(w) <= self.longest}
        known.update(fresh)
        return found

    @staticmethod
    def _stem(word: str) -> str:
        """The word without the marks at its end, which are a piece of their own after a letter or digit."""
        stem = word.rstrip(MARKS)
        return stem if len(stem) < len(word) and stem and stem[-1].isalnum() and stem[-1] < "\u2000" else word

    def _tail(self, marks: str) -> bytes:
        if (known := self.tails.get(marks)) is None:
            known = self.encode_text(marks)
            if len(marks) <= 8:
                self.tails[marks] = known
        return known

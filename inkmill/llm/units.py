"""A memo in front of the tokenizers library.

A text is cut only where the tokenizer provably cuts as well, so the encoding of the whole is the concatenation of the
encodings of its units:

* "word" tokenizers (white space collapsed by the normalizer, then dropped by the pre-tokenizer): no pre-token holds
  white space, no canonical composition has white space as a part, and no added token contains it. Any run of ASCII
  white space is a cut.
* "byte" tokenizers (byte-level pre-tokenizer): a pre-token that holds a non-space character ends before the next white
  space, and its pattern looks back at nothing. The place before a white-space run that follows another character is a
  cut. Texts with white space outside ASCII go to the library whole, as runs may mix both kinds.
* both: no pre-token goes on from a letter to ASCII punctuation or a digit, nor does a composition. The place between
  is a cut, after letters of ASCII and Latin-1, in texts without "<|", with which all added tokens begin.

Cutting, telling units apart and putting ids together are array operations over many texts at once. Each distinct unit
is encoded by the library once and remembered, in two generations of bounded size; forgetting a unit only means encoding
it again.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes without which a text holds no white space but ASCII's; each takes a closer look.
_HINT = np.isin(np.arange(256), [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3])
_BYTE_UNIT = re.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
#: White space that the library knows beyond ASCII's, and the separators \x1c-\x1f, as UTF-8.
_OTHER_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Kinds of bytes: white space, ASCII letters, ASCII punctuation and digits, others.
SPACE, LETTER, MARK, OTHER = 1, 2, 3, 0
#: Units of a byte tokenizer that have one edge: no white space but their first byte.
_REGULAR = re.compile(rb"[ \n](?:[!-~]|[\xc3-\xdf][\x80-\xbf])+")
_KIND = np.array([SPACE if c == 32 or 9 <= c <= 13 else LETTER if chr(c).isalpha() and c < 128 else MARK if 33 <= c < 127 else OTHER for c in range(256)], np.uint8)
#: Units remembered per generation; a unit longer than MAX_UNIT bytes isn't kept.
GENERATION = 250_000
MAX_UNIT = 256
#: Units that go to the library in one text.
GROUP = 256


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[k] .. start[k] + size[k] - 1 of all k, one after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class UnitEncoder:
    """The ids of texts, little-endian unsigned 32-bit, equal to the library's without added special tokens."""

    def __init__(self, path: str, generation: int = GENERATION):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.word = "</w>" == self.lib.model.end_of_word_suffix
        self.generation = generation
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        #: by id: whether the token ends a word, or begins with white space (a byte-level vocabulary writes it as Ġ, Ċ, ...)
        edge = (lambda t: t.endswith("</w>")) if self.word else (lambda t: t[:1] in "ĉĊċČčĠ")
        vocab = self.lib.get_vocab(with_added_tokens=False)
        self.edge = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.edge[[k for t, k in vocab.items() if edge(t)]] = True

    def apart(self, text: bytes) -> list[bytes] | None:
        """The units of a text that cut() may not cut; None for the others."""
        if not self.word and _OTHER_SPACE.search(text):
            return [text]
        if b"<|" in text:
            return text.split() if self.word else _BYTE_UNIT.findall(text)
        return None

    def doubtful(self, flat: bytes, first: np.ndarray) -> list[int]:
        """The texts (by their first bytes in flat) that apart() has to look at."""
        found = []
        if not self.word:
            at = np.flatnonzero(_HINT[np.frombuffer(flat, np.uint8)])
            found = [p for p in at.tolist() if _OTHER_SPACE.match(flat, p)]
        p = flat.find(b"<|")
        while p >= 0:
            found.append(p)
            p = flat.find(b"<|", p + 1)
        return np.unique(np.searchsorted(first, found, "right") - 1).tolist()

    def cut(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """(units of all texts, one after another; how many each text has). Lower-casing is a word normalizer's own work."""
        flat = b"".join(texts)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(size) - size
        a = np.frombuffer(flat.lower() if self.word else flat, np.uint8)
        kind = _KIND[a]
        space = kind == SPACE
        letter = kind == LETTER
        letter[1:] |= (a[:-1] == 0xC3) & (a[1:] != 0x97) & (a[1:] != 0xB7)
        new = np.zeros(len(a), bool)
        new[1:] = (kind[1:] == MARK) & letter[:-1]
        new[1:] |= (space[:-1] > space[1:]) if self.word else (space[1:] > space[:-1])
        new[first[size > 0]] = True
        if self.word:
            new &= ~space
        at = np.flatnonzero(new)
        count = np.searchsorted(at, first + size) - np.searchsorted(at, first)
        if self.word:
            before = np.cumsum(~space, dtype=np.int32)
            values, offsets = a[~space], np.append(before[at] - 1, before[-1] if len(a) else 0)
        else:
            values, offsets = a, np.append(at, len(a))
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]), count

    def regular(self, unit: bytes) -> bool:
        """Whether a unit has one edge: a space or line feed at its beginning alone, or letters that end in one </w>."""
        if b"<|" in unit or len(unit) > MAX_UNIT:
            return False
        if not self.word:
            return _REGULAR.fullmatch(unit) is not None
        return unit.isalpha() or (s := unit.decode("utf-8", "replace")).isalpha() and max(s) < "ɐ"

    def of_library(self, units: list[bytes]) -> list[bytes]:
        """The ids of each unit, as a text of its own.

        Regular ones go to the library side by side in one text, cut apart again at their edges; should the edges not be
        one a unit, and for all other units, they go as separate words.
        """
        out: list[bytes] = [b""] * len(units)
        fit = [self.regular(u) for u in units]
        some = [k for k, ok in enumerate(fit) if ok]
        rest = [k for k, ok in enumerate(fit) if not ok]
        for k in range(0, len(some), GROUP):
            part = some[k : k + GROUP]
            text = (b" " if self.word else b"").join([units[i] for i in part]).decode("utf-8", "replace")
            ids = np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            edges = np.flatnonzero(self.edge[np.minimum(ids, len(self.edge) - 1)])
            if len(edges) != len(part):
                rest += part
                continue
            ends = (4 * edges + 4).tolist() if self.word else [*(4 * edges[1:]).tolist(), 4 * len(ids)]
            data = ids.tobytes()
            for i, x, y in zip(part, [0, *ends], ends, strict=False):
                out[i] = data[x:y]
        for k in range(0, len(rest), GROUP):
            part = rest[k : k + GROUP]
            words = [units[i].decode("utf-8", "replace") for i in part]
            got = self.lib.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0]
            if None in got.word_ids:  # an added token belongs to no word
                found = [np.array(x.ids, "<u4").tobytes() for x in self.lib.encode_batch_fast(words, add_special_tokens=False)]
            else:
                ids = np.array(got.ids, "<u4").tobytes()
                ends = (4 * np.cumsum(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)))).tolist()
                found = [ids[x:y] for x, y in zip([0, *ends], ends, strict=False)]
            for i, x in zip(part, found, strict=True):
                out[i] = x
        return out

    def remembered(self, units: list[bytes]) -> list[bytes]:
        """The ids of distinct units."""
        new, old = self.new, self.old
        got = list(map(new.get, units))
        missing = [k for k, x in enumerate(got) if x is None]
        if missing and old:
            for k in missing:
                if (x := old.get(units[k])) is not None:
                    got[k] = new[units[k]] = x
            missing = [k for k in missing if got[k] is None]
        if missing:
            for k, x in zip(missing, self.of_library([units[k] for k in missing]), strict=True):
                got[k] = x
                if len(units[k]) <= MAX_UNIT:
                    new[units[k]] = x
        if len(new) > self.generation:
            self.old, self.new = new, {}
        return got

    def encode_flat(self, texts: list[bytes], with_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; how many each text has); without ids the first is empty."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        odd = {k: units for k in self.doubtful(b"".join(texts), np.cumsum(size) - size) if (units := self.apart(texts[k])) is not None}
        units, count = self.cut([t for k, t in enumerate(texts) if k not in odd])
        of = np.arange(len(texts))
        if odd:
            units = pa.concat_arrays([units, pa.array(chain.from_iterable(odd.values()), pa.binary())])
            count = np.append(count, [len(x) for x in odd.values()])
            of = np.append(np.delete(of, list(odd)), list(odd))
        coded = units.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        known = self.remembered(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        n = size[codes]
        before = np.append(0, np.cumsum(n))
        ends = np.cumsum(count)
        lengths = np.zeros(len(texts), np.int64)
        lengths[of] = before[ends] - before[ends - count]
        if not with_ids:
            return np.zeros(0, "<u4"), lengths
        pool = np.frombuffer(b"".join(known), "<u4")
        ids = pool[ranges((np.cumsum(size) - size)[codes], n)] if len(codes) else np.zeros(0, "<u4")
        if len(of) and (np.diff(of) < 0).any():  # texts cut apart() come last: back to the order of texts
            start = np.zeros(len(texts), np.int64)
            start[of] = before[ends - count]
            ids = ids[ranges(start, lengths)]
        return ids, lengths

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        ids, lengths = self.encode_flat(texts)
        data, ends = ids.tobytes(), (4 * np.cumsum(lengths)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def counts(self, texts: list[bytes]) -> list[int]:
        """How many ids each text has."""
        return self.encode_flat(texts, with_ids=False)[1].tolist()


def encoder(path: str, generation: int = GENERATION) -> UnitEncoder:
    """A Python worker's encoder, kept over its tasks."""
    return held(("units", path, generation), lambda: UnitEncoder(path, generation))


def slices(texts: list[bytes], size: int = 8_000_000) -> list[list[int]]:
    """Indexes of texts in runs of about `size` bytes, so that units in hand stay bounded."""
    out, run, n = [], [], 0
    for k, x in enumerate(texts):
        run.append(k)
        n += len(x)
        if n >= size:
            out.append(run)
            run, n = [], 0
    return out + [run] if run else out

"""Token ids of whole texts from a public vocabulary file, word by word.

A text's ids are those of its units one after the other: units are runs of
non-space bytes, cut where a letter of ASCII or Latin (U+00C0 to U+024F) is
followed by another ASCII character that isn't a letter.  The vocabulary's
splitting rule has a boundary at each such place, whatever stands around it, so
nothing is lost by the cut; a vocabulary whose units depend on the white space
before them is refused.  Each worker process keeps the ids of the units it
has met; new ones are encoded together, with a special token between them.  A
text that holds a special token's string is encoded as a whole.
"""

from __future__ import annotations

import os

import numpy as np

from . import textops

#: Units whose ids a process keeps at most.
CACHE_UNITS = 3_000_000

#: Letters for the cut: ASCII letters, and the second byte of U+00C0 to U+024F.
_ASCII_LETTER = textops._byte_class((0x41, 0x5A), (0x61, 0x7A))
_CUT_BEFORE = textops._byte_class((0x21, 0x40), (0x5B, 0x60), (0x7B, 0x7E))

_open: dict[tuple[str, bool], WordTokenizer] = {}


class WordTokenizer:
    """Encodes chunks of texts with the tokenizer of a vocabulary file."""

    def __init__(self, path: str, ordinary: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = Tokenizer.from_file(path)  # for texts with a special token's string
        self.whole.encode_special_tokens = ordinary
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = [x.encode() for x in special.values()]
        self.between, self.mark = max(special.items())
        # units are known by their bytes, in lower case where the vocabulary takes no other
        self.fold = textops.LOWER if self.tokenizer.encode("AbC zZ", add_special_tokens=False).ids == self.tokenizer.encode("abc zz", add_special_tokens=False).ids else np.arange(256, dtype=np.uint8)
        plain = self.tokenizer.encode("ab", add_special_tokens=False).ids
        if self.tokenizer.encode(" ab", add_special_tokens=False).ids != plain or self.tokenizer.encode(f"ab{self.mark}ab", add_special_tokens=False).ids != [*plain, self.between, *plain]:
            raise ValueError(f"{path}: this vocabulary's units depend on the white space before them")
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of units
        self.place = np.zeros(0, np.int64)  # of a unit's ids in ids
        self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, units: list[bytes], keys: np.ndarray) -> None:
        got = self.tokenizer.encode(self.mark.join(x.decode() for x in units), add_special_tokens=False).ids
        got = np.array(got, np.uint32)
        ends = np.append(np.flatnonzero(got == self.between), len(got))
        starts = np.append(0, ends[:-1] + 1)
        length = ends - starts
        ids = got[got != self.between]
        place = len(self.ids) + np.cumsum(length) - length
        keys_all = np.concatenate([self.keys, keys])
        order = np.argsort(keys_all, kind="stable")
        self.keys = keys_all[order]
        self.place = np.concatenate([self.place, place])[order]
        self.length = np.concatenate([self.length, length])[order]
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: textops.Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32), and where each text's begin and the last's end."""
        data = texts.data
        n = len(data)
        cut = np.zeros(n, bool)
        if n > 1:
            letter = _ASCII_LETTER[data]
            second = (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xC9)
            second &= ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
            letter[1:] |= second
            cut[1:] = letter[:-1] & _CUT_BEFORE[data[1:]]
        starts, ends = textops.spans(texts, textops.NON_SPACE, cut)
        keys = textops.span_hashes(self.fold[data], starts, ends)
        first = textops.words_of_text(starts, texts.offsets)
        raw = data.tobytes()
        if any(s in raw for s in self.special):
            return self._with_special(texts)
        uniques, where, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(uniques) > CACHE_UNITS:
            self._empty()
        at = np.searchsorted(self.keys, uniques)
        new = np.ones(len(uniques), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != uniques[inside]
        if new.any():
            w = where[new]
            self._learn([data[a:b].tobytes() for a, b in zip(starts[w].tolist(), ends[w].tolist())], uniques[new])
            at = np.searchsorted(self.keys, uniques)
        at = at[back]
        length, place = self.length[at], self.place[at]
        to = np.zeros(len(at) + 1, np.int64)
        np.cumsum(length, out=to[1:])
        ids = self.ids[np.arange(to[-1]) + np.repeat(place - to[:-1], length)]
        return ids, to[first]

    def _with_special(self, texts: textops.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Text by text, for chunks in which a special token's string occurs."""
        ids, to = [], [0]
        for i in range(len(texts)):
            raw = texts.bytes_of(i)
            if any(s in raw for s in self.special):
                own = np.array(self.whole.encode(raw.decode(), add_special_tokens=False).ids, np.uint32)
            else:
                own, _ = self.encode(textops.Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 0))
            ids.append(own)
            to.append(to[-1] + len(own))
        return np.concatenate(ids), np.array(to)


def tokenizer_of(path: str, ordinary: bool = False) -> WordTokenizer:
    """This process's tokenizer for a vocabulary file; ordinary: special tokens' strings in a text are ordinary text."""
    if (path, ordinary) not in _open:
        _open[path, ordinary] = WordTokenizer(path, ordinary)
    return _open[path, ordinary]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)

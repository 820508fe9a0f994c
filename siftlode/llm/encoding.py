"""Encoding whole texts with a public tokenizer, one distinct word at a time.

The tokenizer's own pre-tokenizer never joins characters across white space, so encoding a text equals encoding its
white-space separated words one after another.  A worker keeps the ids of the words it has met; a batch of texts is then
a vectorised gather.  The memory of met words is bounded: beyond ``MAX_WORDS`` it starts anew.

The strings of special tokens become these tokens, as the library does by default, or are ordinary text on request.  In
the first case they are looked for in the text as it is (not in lower case), so the whole text goes through the library.

Defined results: a null or empty text, or white space only, is the end token alone; texts of any length are encoded whole;
an empty batch gives no ids.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_WORDS = 700_000
_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def default_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file; the import is the installed package's, not a copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _raw(texts: pa.Array) -> tuple[np.ndarray, bytes]:
    """Offsets and bytes of the texts, null as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, "i8")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, "i8")
    return at - at[0], bytes(memoryview(data)[at[0] : at[-1]]) if data is not None else b""


#: Bytes of a text: A-Z in lower case, every white-space character a space.
_BYTES = bytes(32 if x in b" \t\n\x0b\x0c\r" else x + 32 if 65 <= x <= 90 else x for x in range(256))


def plain(texts: pa.Array) -> pa.Array:
    """The texts (null: empty) with A-Z in lower case and spaces for other white space; one pass over their bytes."""
    return _plain(*_raw(texts))


def _plain(at: np.ndarray, raw: bytes) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(raw.translate(_BYTES)))


#: A run of letters, then ASCII punctuation without the apostrophe: two pre-tokens that normalising cannot join.
_PARTS = re.compile(r"([a-zà-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


class _Store:
    """Strings and their ids, in one flat array."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, "<u2"), 0
        self.starts, self.lengths = np.empty(1 << 16, "i4"), np.empty(1 << 16, "i4")

    def add(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.index)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(names) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.lengths))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[n : n + len(names)] = self.used + np.cumsum(sizes) - sizes
        self.lengths[n : n + len(names)] = sizes
        self.used += len(ids)
        self.index.update(zip(names, range(n, n + len(names)), strict=True))

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings at these places, in one array, and how many each has."""
        size = self.lengths[at]
        total = int(size.sum())
        shift = self.starts[at] - (np.cumsum(size, dtype="i4") - size)
        return self.flat[np.repeat(shift, size) + np.arange(total, dtype="i4")], size


class WordEncoder:
    """Encodes with a tokenizers file whose ids fit 16 bits, whose pre-tokens are runs of letters, single digits or runs
    of other characters and never span white space, and whose vocabulary marks the last token of a pre-token."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # words are ordinary text; texts with special strings go elsewhere
        self.whole = None if special_as_text else Tokenizer.from_file(path)
        special = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = [t.encode() for t in special]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.words, self.parts = _Store(), _Store()

    def _learn(self, fresh: list[str]) -> None:
        """Encode new words: letters with punctuation after them by these two parts, any other word alone."""
        cut = [_PARTS(w) for w in fresh]
        bodies, tails = [m[1] for m in cut if m], [m[2] for m in cut if m]
        new = [p for p in dict.fromkeys(bodies + tails) if p and p not in self.parts.index]
        for at in range(0, len(new), 2000):  # many at a time, told apart by the tokens that end a pre-token
            part = new[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "i8")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                raise ValueError("the vocabulary does not mark the ends of words")
            self.parts.add(part, ids, np.diff(stops, prepend=0))
        find = self.parts.index
        pairs = np.array([[find[x] for x in bodies], [find[x] if x else -1 for x in tails]], "i8").T.ravel()
        ids, sizes = self.parts.gather(pairs[pairs >= 0])
        per = np.zeros(len(pairs), "i8")
        per[pairs >= 0] = sizes
        self.words.add([w for w, m in zip(fresh, cut, strict=True) if m], ids, per[::2] + per[1::2])
        others = [w for w, m in zip(fresh, cut, strict=True) if not m]
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        self.words.add(others, np.fromiter(chain.from_iterable(encoded), "i8"), np.fromiter(map(len, encoded), "i8", len(encoded)))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by ``end``, in one array; number of ids of each text with its end."""
        at, raw = _raw(texts)
        places = [m.start() for t in self.special if t in raw for m in re.finditer(re.escape(t), raw)]
        if not places:
            return self._by_words(_plain(at, raw), end)
        # a match may join the end of one text to the start of the next; then the library finds none and nothing is lost
        apart = np.unique(np.searchsorted(at, places, side="right") - 1)
        marked = np.zeros(len(texts), bool)
        marked[apart] = True
        ids, counts = self._by_words(plain(pc.if_else(pa.array(marked), "", texts)), end)
        encoded = [np.array([*e.ids, end], "<u2") for e in self.whole.encode_batch_fast([t or "" for t in texts.take(pa.array(apart)).to_pylist()], add_special_tokens=False)]
        stops = np.cumsum(counts)
        pieces, done = [], 0
        for k, own in zip(apart.tolist(), encoded, strict=True):
            pieces += [ids[done : stops[k] - 1], own]  # in place of the lone end
            done, counts[k] = stops[k], len(own)
        return np.concatenate([*pieces, ids[done:]]), counts

    def _by_words(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words.index) > MAX_WORDS:
            self._clear()
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        distinct, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.words.index
        places = list(map(index.get, distinct))
        if None in places:
            self._learn([w for w, at in zip(distinct, places, strict=True) if at is None])
            places = list(map(index.get, distinct))
        own = np.array(places, "i4")
        ids, size = self.words.gather(own[coded.indices.to_numpy()])
        count = pc.list_value_length(split).to_numpy()
        stop = np.cumsum(count)
        ends = np.concatenate([[0], np.cumsum(size)])
        per_text = ends[stop] - ends[stop - count] + 1
        out = np.full(len(ids) + len(count), end, "<u2")
        last = np.zeros(len(out), bool)
        last[np.cumsum(per_text) - 1] = True
        out[~last] = ids
        return out, per_text


def encoder(path: str, special_as_text: bool = False) -> WordEncoder:
    """The worker's encoder for a vocabulary file; kept between tasks."""
    key = path, special_as_text
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, special_as_text)
    return _ENCODERS[key]


def forget() -> None:
    """Drop the encoders that this worker keeps from tasks of other operators."""
    _ENCODERS.clear()

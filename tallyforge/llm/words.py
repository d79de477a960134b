"""Token ids of whole texts from the tokenizers library, each distinct part of a text encoded once per batch."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyforge.llm.shared import ASCII_SPACE, binary, ragged, tokenizer_path, word_cuts

CACHE_PARTS, CACHE_BYTES = 500_000, 16 << 20
BLOCK = 2 << 20  # bytes of text encoded at a time


class PartCache:
    """Ids of text parts in compact arrays; it lives as long as the Python worker and stops growing at a bound."""

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], whole: list[str] | None = None, limit: int = CACHE_PARTS):
        """whole: strings that are taken out of a text before all else, each a part of its own."""
        self.encode, self.limit = encode, limit
        self.whole = re.compile(b"|".join(re.escape(x.encode()) for x in whole)) if whole else None
        self.parts = pa.array([], pa.binary())
        self.ids, self.off = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def codes(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length): where each of the distinct ``parts`` has its ids."""
        at = pc.index_in(parts, value_set=self.parts)
        new = np.asarray(at.is_null().to_numpy(zero_copy_only=False))
        at = np.array(pc.fill_null(at, 0).to_numpy(zero_copy_only=False), np.int64)
        fresh = parts.filter(pa.array(new))
        got, off = self.encode(fresh)
        ids = np.concatenate([self.ids, got])
        both = np.concatenate([self.off, self.off[-1] + off[1:]])
        at[new] = len(self.parts) + np.arange(len(fresh))
        if len(self.parts) + len(fresh) <= self.limit and self.parts.nbytes + fresh.nbytes <= CACHE_BYTES:
            self.parts, self.ids, self.off = pa.concat_arrays([self.parts, fresh]), ids, both
        return ids, both[at], both[at + 1] - both[at]

    def texts(self, buf: np.ndarray, off: np.ndarray, space: np.ndarray = ASCII_SPACE, marks: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in ``buf``, and n + 1 offsets."""
        starts = self._apart(buf, off, word_cuts(buf, off, space, marks))
        coded = binary(buf, np.r_[starts, len(buf)]).dictionary_encode()
        ids, at, n = self.codes(coded.dictionary)
        code = coded.indices.to_numpy(zero_copy_only=False)
        lens = n[code]
        ends = np.r_[0, np.cumsum(lens)]
        return ids[ragged(at[code], lens)], ends[np.searchsorted(starts, off)]


    def _apart(self, buf: np.ndarray, off: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The starts of parts with those strings apart."""
        found = np.array([m.span() for m in self.whole.finditer(np.ascontiguousarray(buf))] if self.whole else [], np.int64).reshape(-1, 2)
        found = found[np.searchsorted(off, found[:, 0], "right") == np.searchsorted(off, found[:, 1] - 1, "right")]
        if not len(found):
            return starts
        before = np.searchsorted(found[:, 0], starts, "left") - 1  # the last one that starts before a cut
        inside = (before >= 0) & (starts < found[np.maximum(before, 0), 1])
        more = np.concatenate([found[:, 0], found[:, 1]])
        return np.unique(np.concatenate([starts[~inside], more[more < len(buf)]]))


_caches: dict[str, PartCache] = {}


def library_cache(name: str, blanks: bool) -> PartCache:
    """The worker's cache over one tokenizer file, with the settings that the library opens it with.

    blanks: a blank before a word counts, or else words are lower-cased. Strings of added tokens in a text are those tokens.
    """
    if name not in _caches:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer_path(name))
        _caches[name] = PartCache(lambda parts: _encode(t, parts, blanks), [x.content for x in t.get_added_tokens_decoder().values()])
    return _caches[name]


def byte_cache(name: str) -> PartCache:
    """For byte-level files, where blanks give ids."""
    return library_cache(name, True)


def word_cache(name: str) -> PartCache:
    """For files that drop blanks and lower-case."""
    return library_cache(name, False)


#: Parts that any of these files takes as one word: its pre-tokenizer has nothing to split, so the model alone encodes it.
WORD = r"^ ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+$"


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level models have for bytes: printable Latin-1 stands for itself, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def _encode(t, parts: pa.Array, blanks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each part: words by the library's model, all else by its whole encoder."""
    texts = parts.cast(pa.string())
    word = np.asarray(pc.match_substring_regex(texts, WORD).to_numpy(zero_copy_only=False), bool)
    words = texts.filter(pa.array(word))
    if not blanks:
        words = pc.utf8_lower(pc.ascii_ltrim_whitespace(words))
    model = t.model
    rows = [[x.id for x in model.tokenize(w.decode("latin-1").translate(_LETTERS))] for w in words.cast(pa.binary()).to_pylist()]
    other = [e.ids for e in t.encode_batch_fast(texts.filter(pa.array(~word)).to_pylist(), add_special_tokens=False)]
    lens = np.zeros(len(texts), np.int64)
    lens[word] = [len(x) for x in rows]
    lens[~word] = [len(x) for x in other]
    ends = np.r_[0, np.cumsum(lens)]
    ids = np.empty(int(ends[-1]), np.int32)
    for own, got in ((word, rows), (~word, other)):
        ids[ragged(ends[:-1][own], lens[own])] = np.fromiter((x for r in got for x in r), np.int32, int(lens[own].sum()))
    return ids, ends

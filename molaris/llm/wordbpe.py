"""Encoding with the word-level vocabulary by the tokenizers library, each distinct word once.

The vocabulary lower-cases, drops white space and encodes runs of letters and runs of signs apart. So a text is the
sequence of its parts between blanks, and a part that is letters followed by signs is the two one after the
other. Texts are split and their parts numbered by Arrow, block by block; only the distinct parts of a block are looked
up among those that the worker has met (``KEEP`` about; rare ones go first). The library encodes the new runs of letters, many to a call, as
each ends with one of the tokens that end a word, and one by one whatever is left. The names of special tokens in a text
are these tokens, as in a plain call of the library; what stands before and after them is encoded apart.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

KEEP = 400_000
#: Characters of text that are worked on at once.
AT_ONCE = 1 << 22
#: Documents that are handed over at once.
TOGETHER = 1024
#: Plain words that are encoded as one text.
LINE = 256
WORD_END = "</w>"
#: Letters that are one letter in lower case as well.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-į"
_PLAIN = f"^[{_LETTERS}]+$"
#: Letters, then ASCII signs but the apostrophe, which may begin a word.
_PAIR = rf"^(?P<letters>[{_LETTERS}]+)(?P<signs>[!-&(-/:-@\[-`{{-~]+)$"
#: No text without these has a mark that could join the letter before it.
_FAR = re.compile("[^\u0000-˿]")


def parts_of(text: str) -> list[bytes]:
    """What stands between blanks; in lower case where that changes nothing in the ids."""
    return (text if _FAR.search(text) else text.lower()).encode("utf-8").split()


class Words:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        # names of special tokens are found in the texts; one that only appears in lower case is ordinary text
        self.lib.encode_special_tokens = True
        vocabulary = self.lib.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.special = {t.content: i for i, t in self.lib.get_added_tokens_decoder().items()}
        self.special_names = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(0, np.uint32), np.zeros(0, dtype=bool)
        # no part has a blank, so none is taken for a special token
        names = pa.array([" " + name for name in self.special], pa.string())
        self.add(names, np.array(list(self.special.values()), np.uint32), np.ones(len(names), np.int64))

    def add(self, words: pa.StringArray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])
        self.used = np.concatenate([self.used, np.zeros(len(words), dtype=bool)])

    def make_room(self, more: int) -> None:
        """Most parts occur once; at the bound those stay that have been met again since they were last looked through."""
        if len(self.words) + more <= KEEP:
            return
        stay = np.flatnonzero(self.used)
        if len(stay) + more > KEEP:
            self.forget()
            return
        words, ids, sizes = self.words.take(pa.array(stay)), self.joined(stay), self.sizes[stay]
        self.forget()
        special = pc.invert(pc.starts_with(words, " "))
        own = special.to_numpy(zero_copy_only=False)
        self.add(words.filter(special), ids[np.repeat(own, sizes)], sizes[own])

    def places(self, words: pa.StringArray) -> np.ndarray:
        """Where known parts are; -1 for others."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add_plain(self, words: pa.StringArray) -> None:
        """Runs of letters, many to a call."""
        names = words.to_pylist()
        lines = [" ".join(names[at:at + LINE]) for at in range(0, len(names), LINE)]
        got = [np.array(x.ids, np.uint32) for x in self.lib.encode_batch_fast(lines, add_special_tokens=False)]
        flat = np.concatenate([*got, np.zeros(0, np.uint32)])
        ends = np.flatnonzero(self.ends[flat]) + 1
        if len(ends) == len(names):
            self.add(words, flat, np.diff(ends, prepend=0))
        else:  # not the word ends that are expected
            self.add_each(words)

    def add_each(self, words: pa.StringArray) -> None:
        got = [x.ids for x in self.lib.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        self.add(words, np.array([i for x in got for i in x], np.uint32), sizes)

    def learn(self, new: pa.StringArray) -> np.ndarray:
        """Where the ids of parts are now that the worker has not met before."""
        plain = pc.match_substring_regex(new, _PLAIN)
        pairs = pc.extract_regex(new, _PAIR)
        split = pc.and_not(pairs.is_valid(), plain)
        # the letters and signs of split parts; some are known, some among the new ones
        halves = pairs.filter(split)
        halves = pa.concat_arrays([halves.field(0), halves.field(1)])
        found = pc.unique(halves)
        before = self.places(found)
        missing = found.filter(pc.and_(pa.array(before < 0), pc.invert(pc.is_in(found, new))))
        letters = pc.match_substring_regex(missing, _PLAIN)
        base = len(self.words)
        self.add_plain(pa.concat_arrays([new.filter(plain), missing.filter(letters)]))
        self.add_each(pa.concat_arrays([new.filter(pc.invert(pc.or_(plain, split))), missing.filter(pc.invert(letters))]))
        added = self.words.slice(base)

        def place(words: pa.StringArray) -> np.ndarray:
            return base + pc.fill_null(pc.index_in(words, value_set=added), -1 - base).to_numpy(zero_copy_only=False).astype(np.int64)

        out = place(new)
        if len(halves):
            where = np.where(before < 0, place(found), before)
            at = where[pc.index_in(halves, value_set=found).to_numpy()].reshape(2, -1).T
            out[split.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(at))
            self.add(new.filter(split), self.joined(at.ravel()), self.sizes[at].sum(axis=1))
        return out

    def known(self, words: pa.StringArray) -> np.ndarray:
        """Where the ids of distinct parts are."""
        at = self.places(words)
        new = at < 0
        self.used[at[~new]] = True
        if new.any():
            room = len(self.words)
            self.make_room(3 * int(new.sum()))
            if len(self.words) != room:
                at = self.places(words)
                new = at < 0
            at[new] = self.learn(words.filter(pa.array(new)))
        return at

    def joined(self, at: np.ndarray) -> np.ndarray:
        """The ids of known parts one after the other."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)]

    def parts(self, text: str) -> list[bytes]:
        if "<" not in text or self.special_names is None or not self.special_names.search(text):
            return parts_of(text)
        pieces = self.special_names.split(text)
        return list(chain.from_iterable([b" " + p.encode("utf-8")] if i % 2 else parts_of(p) for i, p in enumerate(pieces)))

    def encode_some(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        parts = [self.parts(t) for t in texts]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        numbered = pa.array(chain.from_iterable(parts), pa.binary(), size=int(counts.sum())).dictionary_encode()
        at = self.known(numbered.dictionary.cast(pa.string()))[numbered.indices.to_numpy(zero_copy_only=False)]
        bounds = np.concatenate([[0], np.cumsum(self.sizes[at])])[np.cumsum(counts)]
        return np.split(self.joined(at), bounds[:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit integers."""
        out: list[np.ndarray] = []
        some, size = [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size >= AT_ONCE:
                out += self.encode_some(some)
                some, size = [], 0
        return out + self.encode_some(some)


@lru_cache(1)
def loaded(path: str) -> Words:
    """One per worker; it keeps what it has learnt from task to task."""
    return Words(path)

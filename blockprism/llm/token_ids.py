"""Token ids of whole texts by a public byte-level tokenizer file."""

from __future__ import annotations

import json
import os
import re
import string

import numpy as np
import pyarrow as pa

from blockprism.llm.common import flat, held
from blockprism.llm.rolling import BYTE, Rolling

#: Words whose ids a worker keeps at most (a few more while a batch lasts).
_WORDS = 600_000
#: New words that are encoded as one text.
_JOINED = 1024


class _Table:
    """Places of 64-bit hashes, by open addressing; all steps work on arrays of hashes."""

    def __init__(self, bits: int = 16):
        self.mask, self.used = np.int64((1 << bits) - 1), 0
        self.keys, self.places = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def hashes(self) -> np.ndarray:
        """In the order of their places, which are those from 0 on."""
        there = np.flatnonzero(self.places >= 0)
        out = np.empty(len(there), np.uint64)
        out[self.places[there]] = self.keys[there]
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """-1 for those that are not there."""
        at = hashes.view(np.int64) & self.mask
        out = self.places[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[at] != hashes))
        at = at[open_]
        while len(open_):
            at = at + 1 & self.mask
            found = self.places[at]
            wrong = (found >= 0) & (self.keys[at] != hashes[open_])
            out[open_] = found
            open_, at = open_[wrong], at[wrong]
        return out

    def add(self, hashes: np.ndarray, first: int) -> None:
        """Distinct hashes that are not there get the places from ``first`` on."""
        if 2 * (self.used + len(hashes)) > len(self.keys):
            old = np.flatnonzero(self.places >= 0)
            keys, places = self.keys[old], self.places[old]
            self.__init__(int(2 * (len(old) + len(hashes))).bit_length())
            self._put(keys, places)
        self._put(hashes, np.arange(first, first + len(hashes), dtype=np.int32))

    def _put(self, hashes: np.ndarray, places: np.ndarray) -> None:
        self.used += len(hashes)
        at = hashes.view(np.int64) & self.mask
        while len(hashes):
            free = self.places[at] < 0
            self.places[at[free]] = places[free]
            won = self.places[at] == places  # of several for one slot the last
            self.keys[at[won]] = hashes[won]
            hashes, places, at = hashes[~won], places[~won], at[~won] + 1 & self.mask


class _Growing:
    """An array that grows at its end, by doubling: an addition costs what is added, not what is there."""

    def __init__(self, kind: type, start: tuple = ()):
        self.n, self.room = len(start), np.array(start, kind)

    def add(self, values: np.ndarray) -> None:
        to = self.n + len(values)
        if to > len(self.room):
            room = np.empty(max(to, 2 * len(self.room), 1 << 12), self.room.dtype)
            room[: self.n] = self.all
            self.room = room
        self.room[self.n : to] = values
        self.n = to

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]


class _Lists:
    """Lists of ids, one behind another; an odd one stands for what has to be encoded in its context."""

    def __init__(self):
        self.ids, self.starts, self.counts, self.odd = (_Growing(t) for t in (np.uint32, np.int64, np.int64, bool))

    def add(self, ids: np.ndarray, counts: np.ndarray, odd: np.ndarray) -> None:
        self.starts.add(self.ids.n + np.cumsum(counts) - counts)
        for have, more in ((self.ids, ids), (self.counts, counts), (self.odd, odd)):
            have.add(more)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists at these places, one behind another, and their lengths."""
        counts = self.counts.all[at]
        return self.ids.all[_slices(self.starts.all[at], counts)], counts


def _slices(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of slices, one behind another."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - ends + sizes, sizes)
    at += np.arange(len(at))
    return at


#: A word: a space or newline, or a text's beginning, and then no white space at either end, of characters of which all
#: libraries agree whether they are letters, numbers or white space.
_regular = re.compile("[ \n]?[!-~\xa1-\u024f](?:[!-~\xa1-\u024f\t]*[!-~\xa1-\u024f])?").fullmatch


#: Bytes of characters that are regular everywhere in a word; of two bytes, those that begin by C2 and C9 are so in part.
_PLAIN = np.array([33 <= c < 127 or 0x80 <= c < 0xC0 or 0xC2 <= c < 0xCA for c in range(256)], bool)
#: Bytes of words of letters alone; of those of two bytes, the signs of multiplication and division are none.
_LETTERS = np.array([c < 128 and chr(c).isalpha() or 0x80 <= c < 0xC0 or 0xC3 <= c < 0xC9 for c in range(256)], bool)
_LETTER, _PUNCTUATION = (np.array([c < 128 and test(chr(c)) for c in range(256)], bool) for test in (str.isalpha, lambda c: c in string.punctuation))


def _characters() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = np.zeros(256, "<u2")
    out[shown] = shown
    hidden = np.flatnonzero(out == 0)
    out[hidden] = 256 + np.arange(len(hidden))
    return out


_CHARACTERS = _characters()


def encoder(path: str) -> Encoder:
    """One for all tasks of a worker, as what it has learned serves them all; it is held under its path."""
    return held(path, lambda: Encoder(path))


class Encoder:
    """Ids of texts by a ``tokenizers`` file with the usual byte-level pre-tokenizer.

    Such a tokenizer splits a text into parts by an expression and encodes each
    for itself; no part goes beyond a space or a newline between two characters that
    are no white space, nor from a letter to punctuation.  So words, which begin with
    each space, newline and punctuation behind a letter, are looked up where they are
    known, and only new words reach the tokenizer, many as one text.  New words of
    letters alone are parts already (a newline before them is one of its own): they go
    to the tokenizer's model as such, past its expression.
    When there are too many words, those stay that were met again since they came.
    Words are found by hashes and compared byte by byte.  A text with uncommon
    characters or with more white space in a row is encoded as one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id: a character stands for one
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        splitter = self.tokenizer.pre_tokenizer and json.loads(self.tokenizer.pre_tokenizer.__getstate__())
        whole = bool(splitter) and usual.items() <= splitter.items() and self.tokenizer.normalizer is None
        #: What takes parts, if the expression is the usual one and no other token is looked for in texts.
        self.model = self.tokenizer.model if whole and all(t.special for t in self.tokenizer.get_added_tokens_decoder().values()) else None
        self._no_words()

    def _no_words(self) -> None:
        self.words, self.word_ids = _Table(), _Lists()
        self.word_bytes, self.word_ends = _Growing(np.uint8), _Growing(np.int64, (0,))
        self.again = _Growing(bool)  # whether a word was met after it had been learned

    def _forget_words(self) -> None:
        """All but those that were met again, if these are half of what is kept at most."""
        keep, lists = self.again.all, self.word_ids
        size, counts = np.diff(self.word_ends.all), lists.counts.all
        kept = self.words.hashes()[keep], lists.ids.all[np.repeat(keep, counts)], counts[keep], lists.odd.all[keep], self.word_bytes.all[np.repeat(keep, size)], np.cumsum(size[keep])
        del keep, lists, size, counts  # what is old goes before there is anything new
        self._no_words()
        if 2 * len(kept[0]) <= _WORDS:
            self._add_words(*kept)

    def _add_words(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray, odd: np.ndarray, own: np.ndarray, ends: np.ndarray) -> None:
        self.words.add(hashes, self.word_ids.counts.n)
        self.word_ids.add(ids, counts, odd)
        self.word_ends.add(self.word_bytes.n + ends)
        self.word_bytes.add(own)
        self.again.add(np.zeros(len(hashes), bool))

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        size, head = ends - starts, data[starts]
        first = (head != 32) & (head != 10)  # of its text: stands behind nothing
        own = data[_slices(starts, size)]
        uncommon = ~_PLAIN[own]
        uncommon[:-1] |= ((own[:-1] == 0xC2) & (own[1:] < 0xA1)) | ((own[:-1] == 0xC9) & (own[1:] > 0x8F))
        heads = np.cumsum(size) - size
        uncommon[heads] &= first | (size == 1)
        odd = np.logical_or.reduceat(uncommon, heads)
        for k in np.flatnonzero(odd).tolist():  # with a tab, or odd
            odd[k] = not _regular(data[starts[k] : ends[k]].tobytes().decode())
        letters = self._letters(own, heads) & ~odd
        order = np.argsort(np.where(odd, 3, np.where(letters, 0, 1 + first)), kind="stable")
        size = size[order]
        edges = np.concatenate([[0], np.cumsum(size)])
        own = data[_slices(starts[order], size)]
        raw = own.tobytes()
        parts, regular = int(letters.sum()), int((~odd).sum())
        inside = parts + int((~odd & ~letters & ~first).sum())
        joined = [self._of_parts(own, edges[: parts + 1])]
        cuts = [*range(parts, inside, _JOINED), inside]
        cuts = list(zip(cuts, cuts[1:], strict=False))
        joined += self._plain([raw[edges[a] : edges[b]].decode() for a, b in cuts])
        alone = self._plain([raw[edges[k] : edges[k + 1]].decode() for k in range(inside, regular)])
        counts = []
        for (a, b), found in zip([(0, parts), *cuts], joined, strict=True):
            reached = np.concatenate([[0], np.cumsum(self.width[found])])
            counts.append(np.diff(np.searchsorted(reached, edges[a + 1 : b + 1] - edges[a]), prepend=0))
        counts += [np.fromiter(map(len, alone), np.int64, len(alone)), np.zeros(len(order) - regular, np.int64)]
        self._add_words(hashes[order], np.concatenate([*joined, *alone, np.empty(0, np.uint32)]), np.concatenate(counts), odd[order], own, edges[1:])

    def _letters(self, own: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Whether words that begin at ``heads`` are letters, behind a space or a newline at most."""
        if self.model is None:
            return np.zeros(len(heads), bool)
        other = ~_LETTERS[own]
        other[:-1] |= (own[:-1] == 0xC3) & ((own[1:] == 0x97) | (own[1:] == 0xB7))
        other[heads] &= (own[heads] != 32) & (own[heads] != 10)
        return ~np.logical_or.reduceat(other, heads)

    def _of_parts(self, own: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Ids of words of letters alone between these edges, one behind another."""
        newlines = edges[:-1][(own[edges[:-1]] == 10) & (np.diff(edges) > 1)] + 1
        at = np.sort(np.concatenate([edges, newlines])).tolist()
        text = _CHARACTERS[own[: at[-1]]].tobytes().decode("utf-16-le")
        return np.fromiter((token.id for a, b in zip(at, at[1:], strict=False) for token in self.model.tokenize(text[a:b])), np.uint32)

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text's behind another's, and how many each text has; a null is empty."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if self.words.used > _WORDS:
            self._forget_words()
        data, offsets = flat(texts)
        begins = (data == 32) | (data == 10)
        begins[1:] |= _PUNCTUATION[data[1:]] & _LETTER[data[:-1]]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        hashes = Rolling(BYTE[data], 0).of(starts, ends)
        at = self.words.find(hashes)
        missed = np.flatnonzero(at < 0)
        self.again.all[at[at >= 0]] = True
        if len(missed):
            new, where = np.unique(hashes[missed], return_index=True)
            where = missed[where]
            self._learn_words(data, starts[where], ends[where], new)
            at[missed] = self.words.find(hashes[missed])
        ids, counts = self.word_ids.take(at)
        before = np.searchsorted(starts, offsets)
        edges = np.concatenate([[0], np.cumsum(counts)])[before]
        sizes = np.diff(edges)
        bad = self.word_ids.odd.all[at] | self._differs(data, starts, ends, at)
        odd = np.unique(np.searchsorted(before, np.flatnonzero(bad), "right") - 1)
        if len(odd):
            lists = [ids[edges[k] : edges[k + 1]] for k in range(len(texts))]
            for k, found in zip(odd, self._plain([texts[k].as_py() for k in odd.tolist()]), strict=True):
                lists[k], sizes[k] = found, len(found)
            ids = np.concatenate(lists)
        return ids, sizes

    def _differs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether a word is another than the one found for its hash; the words have all of ``data``."""
        begins, size = self.word_ends.all[at], ends - starts
        out = size != self.word_ends.all[at + 1] - begins
        if not out.any():
            there = self.word_bytes.all[_slices(begins, size)]
            if not np.array_equal(there, data):
                out |= np.add.reduceat(there != data, starts) > 0
        return out

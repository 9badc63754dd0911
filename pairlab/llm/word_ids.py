"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker.

The tokenizer's own pieces never reach over white space (its pre-tokenizer drops it), so a text's ids
are its words' ids one after another. Workers keep a bounded memory of words they have met.
"""

from __future__ import annotations

import re
from array import array
from codecs import charmap_decode
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pairlab.llm.common import byte_letters, kept, slices

#: Composed Latin letters whose lower case depends on nothing else and is one letter.
LATIN = "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and len(c.lower()) == 1)
#: Words that `PIECES` cuts: printable ASCII and such letters, and no beginning of a special token.
PLAIN = re.compile(rf"(?:[!-;=-~{LATIN}]+|<(?!\|))*")
#: The pre-tokenizer's pattern of word_bpe_49k.json, for lower-case plain words, one a line.
PIECES = re.compile(rb"\n|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[!-/:-@\[-`{-~]+|[^\n!-@\[-`{-~]+")


class WordEncoder(dict):
    """word (bytes) -> number of its entry; the ids of all entries lie in one array.

    Texts are cut and their distinct words found by Arrow, a batch at a time; new words are cut into
    pieces together. Entry 0 has no ids.
    """

    def __init__(self, path: str, keep: int = 1_200_000) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.model = self.tokenizer.model
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = "".join("\n" if b == 10 else c for b, c in enumerate(byte_letters()))
        self._clear()

    def _clear(self) -> None:
        self.clear()
        self.ids, self.starts, self.lengths, self.again = array("I"), array("Q", [0]), array("I", [0]), bytearray(1)
        self[b""] = self[b"\n"] = 0

    def _forget(self) -> None:
        """Only words met again in a later batch stay, and none if they are more than half of what is kept."""
        again = [(word, entry) for word, entry in self.items() if self.again[entry]]
        if 2 * len(again) > self.keep:
            again = []
        ids, ends = self._gather(np.array([entry for _, entry in again], np.int64))
        self._clear()
        self.update(zip([word for word, _ in again], self._extend(array("I", ids.tobytes()), np.diff(ends)).tolist()))

    def _add(self, ids: list[int]) -> int:
        self.starts.append(len(self.ids))
        self.lengths.append(len(ids))
        self.ids.extend(ids)
        self.again.append(0)
        return len(self.starts) - 1

    def _extend(self, ids: array, lengths: np.ndarray) -> np.ndarray:
        """Numbers of new entries whose ids stand in a row."""
        first, starts = len(self.starts), len(self.ids) + slices(None, lengths)[:-1]
        self.starts.frombytes(starts.astype(np.uint64).tobytes())
        self.lengths.frombytes(lengths.astype(np.uint32).tobytes())
        self.ids.extend(ids)
        self.again.extend(bytes(len(lengths)))
        return first + np.arange(len(lengths))

    def _known(self, words: list[bytes]) -> np.ndarray:
        """Their entries, -1 for new ones."""
        return np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))

    def _gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries in a row, and where each entry's begin, with the end."""
        lengths = np.frombuffer(self.lengths, np.uint32)[entries].astype(np.int64)
        starts = np.frombuffer(self.starts, np.uint64)[entries].astype(np.int64)
        ends = slices(None, lengths)
        where = np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])
        return np.frombuffer(self.ids, np.uint32)[where] if len(where) else np.zeros(0, np.uint32), ends

    def _learn(self, words: list[bytes]) -> None:
        """Entries of new words."""
        texts = b"\n".join(words).decode("utf-8", "replace").split("\n")
        plain = [PLAIN.fullmatch(text) is not None for text in texts]
        for word, text, known in zip(words, texts, plain):
            if not known:
                self[word] = self._odd(text)
        words = [word for word, known in zip(words, plain) if known]
        if not words:
            return
        pieces = PIECES.findall("\n".join([t for t, known in zip(texts, plain) if known]).lower().encode())
        found = self._known(pieces)
        new = np.flatnonzero(found < 0)
        if len(new):
            missing = [pieces[i] for i in new]
            self._tokenize(list(dict.fromkeys(missing)))
            found[new] = self._known(missing)
        # Word i has the pieces between line ends i - 1 and i. One piece: its entry; more: an entry of their ids.
        ends = np.concatenate([[-1], np.flatnonzero(found == 0), [len(found)]])
        counts = np.diff(ends) - 1
        entries = np.concatenate([found, [0]])[ends[:-1] + 1]
        many = counts > 1
        ids, bounds = self._gather(found[np.repeat(np.append(many, False), np.append(counts + 1, 0))[: len(found)]])
        bounds = bounds[np.concatenate([[0], np.cumsum(counts[many] + 1)]).clip(max=len(bounds) - 1)]
        entries[many] = self._extend(array("I", ids.tobytes()), np.diff(bounds))
        self.update(zip(words, entries.tolist()))

    def _tokenize(self, pieces: list[bytes]) -> None:
        """Entries of new pieces."""
        tokenize, ids, lengths = self.model.tokenize, array("I"), []
        for piece in charmap_decode(b"\n".join(pieces), "strict", self.letters)[0].split("\n"):
            found = [t.id for t in tokenize(piece)]
            lengths.append(len(found))
            ids.extend(found)
        self.update(zip(pieces, self._extend(ids, np.array(lengths)).tolist()))

    def _odd(self, text: str) -> int:
        if "<|" in text:  # may hold a special token
            return self._add(self.tokenizer.encode(text, add_special_tokens=False).ids)
        plain = self.tokenizer.normalizer.normalize_str(text)
        pieces = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)]
        return self._add([t.id for p in pieces for t in self.model.tokenize(p)])

    def encode(self, docs: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        if len(self) > self.keep:
            self._forget()
        cut = pc.ascii_split_whitespace(pa.array([doc or b"" for doc in docs], pa.binary()).view(pa.string()))
        words = cut.flatten().view(pa.binary()).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        entries = self._known(distinct)
        np.frombuffer(self.again, np.uint8)[entries[entries > 0]] = 1
        new = np.flatnonzero(entries < 0)
        if len(new):
            missing = [distinct[i] for i in new]
            self._learn(missing)
            entries[new] = self._known(missing)
        ids, ends = self._gather(entries[words.indices.to_numpy()])
        return ids, np.diff(ends[slices(None, pc.list_value_length(cut).to_numpy())])


_ENCODERS: dict[str, WordEncoder] = kept()


def encoder(path: str) -> WordEncoder:
    """One encoder per worker and tokenizer, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> Iterator[np.ndarray]:
    """Every text's ids with the end id behind them, as little-endian unsigned 32-bit numbers."""
    bounds = slices(None, counts)
    closed = np.insert(ids.astype("<u4"), bounds[1:], end_id)
    bounds = bounds + np.arange(len(bounds))
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield closed[a:b]

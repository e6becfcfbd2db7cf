"""Token ids of whole texts from a word-end vocabulary of the tokenizers library.

The vocabulary drops white space, folds case and ends every word with its own symbol, so
the ids of a text are those of its white-space separated chunks, one after the other. A chunk is
cut where letters end as well, as the vocabulary's own split always does, so that a word is one
chunk whatever sign follows it. Each distinct chunk goes through the library once per worker. A text with any character for
which that split isn't provably the library's own (see SPLITTABLE) goes through whole.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from millrace.llm.text_batches import distinct, list_offsets, ragged

#: Characters that composition leaves alone and whose lower case is a single letter.
SPLITTABLE = r"^[\x00-\x1b\x20-\x7e\x{a1}-\x{12f}\x{131}-\x{24f}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20a0}-\x{20bf}]*$"
#: How the vocabulary file splits a chunk: one word-end symbol for each match.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Where letters end within a chunk.
LETTERS_END = r"(\p{L})([^\s\p{L}])"
SPECIAL = r"<\|startoftext\|>|<\|endoftext\|>"
WORD_END = "</w>"


class WordIds:
    """Encodes text columns; keeps the ids of up to `most` distinct chunks, and as many of the time before."""

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocabulary = vocabulary
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for w, i in vocabulary.items() if w.endswith(WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        """Starts anew; what is asked for again is taken over from the last generation."""
        self.old = (self.known, self.pool, self.begin) if hasattr(self, "known") else ({}, array("i"), array("q", [0]))
        self.known: dict[str, int] = {}
        self.pool, self.begin = array("i"), array("q", [0])

    def _keep(self, chunks: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        at = len(self.pool)
        self.pool.frombytes(ids.tobytes())
        self.begin.frombytes((ends + at).astype(np.int64).tobytes())
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks)), strict=True))

    def _take_over(self, chunks: list[str]) -> list[str]:
        """Copies chunks of the last generation; returns the others."""
        known, pool, begin = self.old
        again = [c for c in chunks if c in known]
        if not again:
            return chunks
        rows = np.fromiter(map(known.__getitem__, again), np.int64, len(again))
        starts = np.frombuffer(begin, dtype=np.int64)
        lengths = starts[rows + 1] - starts[rows]
        self._keep(again, np.frombuffer(pool, dtype=np.int32)[ragged(starts[rows], lengths)], np.cumsum(lengths))
        return [c for c in chunks if c not in known]

    def rest(self) -> None:
        """Gives back the last generation's memory, at the end of a task."""
        self.old = ({}, array("i"), array("q", [0]))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int32)

    def _learn(self, chunks: list[str]) -> None:
        lines = [" ".join(chunks[i : i + 256]) for i in range(0, len(chunks), 256)]
        coded = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, dtype=np.int32) for x in coded])
        pieces = np.ones(len(chunks), np.int64)
        for i in np.flatnonzero(~pc.utf8_is_alpha(pa.array(chunks, pa.large_string())).to_numpy(zero_copy_only=False)).tolist():
            pieces[i] = len(PIECES.findall(chunks[i]))
        ends = np.flatnonzero(self.ends_word[ids])[np.cumsum(pieces) - 1] + 1
        self._keep(chunks, ids, ends)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets): text i has ids[offsets[i]:offsets[i + 1]]."""
        plain = pc.and_(pc.match_substring_regex(texts, SPLITTABLE), pc.invert(pc.match_substring_regex(texts, SPECIAL)))
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        lower = pc.utf8_lower(pc.if_else(plain, texts, ""))
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, LETTERS_END, r"\1 \2"))
        words = split.flatten()
        used, bounds = pc.not_equal(words, ""), list_offsets(split)
        if not pc.all(used).as_py():  # white space at either end of a text leaves empty chunks, which have no ids
            words = words.filter(used)
            bounds = bounds - np.searchsorted(np.flatnonzero(~used.to_numpy(zero_copy_only=False)), bounds)
        at, chunks = distinct(words)
        if len(self.known) + len(chunks) > self.most:
            self._forget()
        if new := self._take_over([c for c in chunks if c not in self.known]):
            self._learn(new)
        rows = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))[at]
        begin = np.frombuffer(self.begin, dtype=np.int64)
        lengths = begin[rows + 1] - begin[rows]
        pool = np.frombuffer(self.pool, dtype=np.int32)
        ids = pool[ragged(begin[rows], lengths)]
        offsets = np.concatenate([[0], np.cumsum(lengths)])[bounds]
        del begin, pool
        if not len(odd):
            return ids, offsets
        parts, at = [], 0
        sizes = np.diff(offsets)
        for i in odd:
            ids_i = self.whole(texts[int(i)].as_py())
            parts += [ids[at : offsets[i]], ids_i]
            at, sizes[i] = offsets[i], len(ids_i)
        return np.concatenate([*parts, ids[at:]]), np.concatenate([[0], np.cumsum(sizes)])


_ready: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One encoder for each worker process and vocabulary."""
    if path not in _ready:
        _ready[path] = WordIds(path)
    return _ready[path]

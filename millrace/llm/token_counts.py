"""Token counts by heap-and-linked-list byte-pair merging.

A text's count is its initial symbols (bytes) minus the merges that apply, summed over the
pieces the vocabulary's pattern cuts; no token id is ever made. Each distinct piece is
merged once per worker.

Rows: one out for each row in, in any order. A null text counts as empty: 0 bytes and 0
tokens. Repeated rows give repeated results. Texts of any length are counted whole; a heap
keeps a piece of n bytes at O(n log n). Other columns of the input are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from millrace.llm.text_batches import distinct, list_offsets, slices, text_column

#: White space as the vocabulary's pattern reads it.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SPACE = SPACE.replace(r"\x{85}\x{a0}", r"\x85\xa0").replace(r"\x{", r"\u").replace("}", "")
#: The pattern of the byte-level vocabulary.
PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: A space with white space on both sides may lie inside a piece; no other space does, but as its first character.
INNER_SPACE = rf"[{SPACE}] [{SPACE}]"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class MergeCounter:
    """Counts tokens; keeps the counts of up to `most` distinct pieces and chunks each."""

    def __init__(self, path: str, most: int = 600_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.special = [t["content"] for t in model["added_tokens"]]
        self.at_special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.symbol, self.most = byte_symbols(), most
        self.pieces: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Symbols left of one piece after all merges, lowest rank first, leftmost among equals."""
        symbols: list = [self.symbol[b] for b in piece.encode()]
        left = n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank = self.rank.get
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = a + b, None
            after[i] = k = after[j]
            left -= 1
            if k >= 0:
                before[k] = i
                if (r := rank((a + b, symbols[k]))) is not None:
                    heappush(heap, (r, i, a + b, symbols[k]))
            if (h := before[i]) >= 0 and (r := rank((symbols[h], a + b))) is not None:
                heappush(heap, (r, h, symbols[h], a + b))
        return left

    def _plain(self, text: str) -> int:
        total = 0
        for piece in PIECES.findall(text):
            count = self.pieces.get(piece)
            if count is None:
                count = self.merged(piece)
                if len(piece) <= 64:
                    if len(self.pieces) >= self.most:
                        self.pieces.clear()
                    self.pieces[piece] = count
            total += count
        return total

    def whole(self, text: str) -> int:
        """A special string inside the text is one token and parts what stands around it."""
        found = self.at_special.findall(text)
        return len(found) + sum(map(self._plain, self.at_special.split(text) if found else [text]))

    def _chunk(self, chunk: str) -> int:
        count = self.chunks.get(chunk)
        if count is None:
            count = self._plain(chunk)
            if len(chunk) <= 64:
                if len(self.chunks) >= self.most:
                    self.chunks.clear()
                self.chunks[chunk] = count
        return count

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text. Texts are cut before spaces, which the pattern does too."""
        odd = pc.match_substring_regex(texts, INNER_SPACE)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        split = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        offsets = list_offsets(split)
        at, chunks = distinct(split.flatten())
        counts = np.fromiter((self._chunk(" " + c) for c in chunks), np.int64, len(chunks))[at]
        first = offsets[:-1]  # no space stands before the first chunk
        counts[first] = [self._chunk(chunks[k]) for k in at[first]]
        out = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            out[i] = self.whole(texts[int(i)].as_py())
        return out


_ready: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    if path not in _ready:
        _ready[path] = MergeCounter(path)
    return _ready[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; a scan without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for part in slices(batch):
                texts = text_column(part)
                n = own.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

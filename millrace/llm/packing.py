"""Order-preserving packing: window cuts by dynamic programming with a monotone queue.

Documents in ascending doc_id order form one stream for each range of ids. Cuts may stand at
document ends (no penalty), at sentence ends (a small one) and, where neither comes for a
while, inside a sentence (a large one). With p the places of the cuts, the cheapest way to
have cut at p[k] is

    f[k] = penalty[k] + overhead + min over i of f[i] + padding(p[k] - p[i]),  p[k] - p[i] <= width

and as padding is width - (p[k] - p[i]), the minimum is that of f[i] + p[i] over a sliding
window, which a monotone queue gives in constant time. A window of 2^j ids isn't padded; halves,
quarters and eighths of the width are looked up on their own. A smaller window costs more in overhead than
it saves, so it is counted as padded to the width when cuts are chosen, though it isn't padded if chosen.

Defined cases: a null text is empty and packs as its end id; rows that share a doc_id are
separate documents, ordered by a hash of the text; a null doc_id comes first; an empty table gives no
piece; other columns are ignored; a text longer than a window goes on in the next ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from millrace.llm.text_batches import slices
from millrace.llm.token_files import encoded, in_id_order
from millrace.llm.word_ids import WORD_END, encoder

WIDTH = 2048
OVERHEAD, SENTENCE, INSIDE = 16, 6, 48  # in ids of padding
#: Where no sentence ends for so many ids, a cut may stand at each STEP of them.
STEP = 32
#: Ids that one run of the dynamic programme spans; its last windows go on into the next run.
RUN_IDS = 1 << 19
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SENTENCE_END = regex.compile(r"[.!?]+[\"')\]]*")


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts may stand, ascending from 0, and the penalty of each."""
    cost = np.full(len(ids) + 1, -1, np.int32)
    cost[np.flatnonzero(ends_sentence[ids]) + 1] = SENTENCE
    cost[doc_ends] = 0
    cost[0] = 0
    natural = np.flatnonzero(cost >= 0)
    gaps = np.diff(natural)
    wide = np.flatnonzero(gaps > STEP)
    inner = np.concatenate([np.arange(natural[i] + STEP, natural[i + 1], STEP) for i in wide]) if len(wide) else np.zeros(0, np.int64)
    cost[inner] = INSIDE
    places = np.flatnonzero(cost >= 0)
    return places, cost[places]


def best_cuts(places: list[int], penalties: list[int], width: int = WIDTH) -> tuple[list[int], int]:
    """Indices of the chosen places, from 0 to the last, and their total cost. No gap exceeds width."""
    n = len(places)
    f, back = [0] * n, [0] * n
    queue, values, head = [0], [places[0]], 0  # values: f[i] + p[i], ascending
    halves = [width >> j for j in (1, 2, 3) if width & (width - 1) == 0]
    index = {p: i for i, p in enumerate(places)}
    find = index.get
    for k in range(1, n):
        p = places[k]
        low = p - width
        while places[queue[head]] < low:
            head += 1
        i = queue[head]
        best = values[head] - low
        for half in halves:
            j = find(p - half)
            if j is not None and f[j] < best:
                best, i = f[j], j
        f[k] = best = best + OVERHEAD + penalties[k]
        back[k] = i
        value = best + p
        while len(values) > head and values[-1] >= value:
            values.pop()
            queue.pop()
        queue.append(k)
        values.append(value)
    chosen, k = [n - 1], n - 1
    while k:
        k = back[k]
        chosen.append(k)
    return chosen[::-1], f[-1]


def power_tail(length: int, width: int = WIDTH) -> list[int]:
    """A last window cut into powers of two where that wastes less than its padding."""
    parts = [1 << j for j in range(length.bit_length() - 1, -1, -1) if length >> j & 1]
    return parts if (len(parts) - 1) * (OVERHEAD + INSIDE) < width - length else [length]


def pack(docs: DataFrame, vocabulary: str, end: int = 1, width: int = WIDTH) -> DataFrame:
    """One row for each piece of a document; sequence_id orders the sequences as the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        ends_sentence = np.zeros(len(own.ends_word), bool)
        ends_sentence[[i for w, i in own.vocabulary.items() if w.endswith(WORD_END) and SENTENCE_END.fullmatch(w.removesuffix(WORD_END))]] = True
        sequence = TaskContext.get().partitionId() << 33
        ids, sizes, skips, keys = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [pa.array([], pa.int64())]

        def windows(last: bool) -> pa.RecordBatch | None:
            """Packs what is held; unless it is the last run, keeps all from two windows before its end."""
            nonlocal sequence
            flat, size, skip = np.concatenate(ids), np.concatenate(sizes), np.concatenate(skips)
            key = pa.chunked_array(keys).combine_chunks()
            doc_ends = np.cumsum(size - skip)
            places, penalties = cut_places(flat, doc_ends, ends_sentence)
            cuts = places[best_cuts(places.tolist(), penalties.tolist(), width)[0]]
            if last:
                tail = power_tail(int(cuts[-1] - cuts[-2]), width)
                cuts = np.concatenate([cuts[:-1], cuts[-2] + np.cumsum(tail)])
            else:
                cuts = cuts[:-2]
            done = int(cuts[-1])
            edges = np.unique(np.concatenate([cuts, doc_ends[doc_ends <= done]]))
            begin, stop = edges[:-1], edges[1:]
            doc = np.searchsorted(doc_ends, begin, side="right")
            window = np.searchsorted(cuts, begin, side="right") - 1
            raw = flat.astype("<u4")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin, stop, strict=True)]
            doc_begin = doc_ends - size  # where the document would begin if none of it had been packed
            out = [key.take(pa.array(doc)), begin - doc_begin[doc], stop - begin, crc, size[doc], sequence + window, begin - cuts[window]]
            sequence += len(cuts) - 1
            k = int(np.searchsorted(doc_ends, done, side="right"))
            rest = skip[k:].copy()
            if len(rest):
                rest[0] = done - doc_begin[k]
            ids[:], sizes[:], skips[:], keys[:] = [flat[done:]], [size[k:]], [rest], [key.slice(k)]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in out], [c.split()[0] for c in COLUMNS.split(", ")])

        for batch in batches:
            for piece in slices(batch, most=2 << 20):
                new, offsets = encoded(piece, vocabulary, end)
                ids.append(new)
                sizes.append(np.diff(offsets))
                skips.append(np.zeros(piece.num_rows, np.int64))
                keys.append(piece.column(0))
                if sum(map(len, ids)) >= max(RUN_IDS, 8 * width):
                    yield windows(False)
        if sum(map(len, ids)):
            yield windows(True)
        own.rest()

    return in_id_order(docs).mapInArrow(run, COLUMNS)

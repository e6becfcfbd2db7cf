"""Re-Pair grammars over token ids: one blob for each shard of documents.

Round by round the most frequent adjacent pairs of the shard become nonterminals, twice as many
in each round, until no pair is left that occurs LEAST times without overlap. A pair never
reaches over the end of a document, so each document is a run of symbols of its own, and
the stored expansion length of each rule finds any id of it without expanding the rest.

Counts are kept up round by round: a pair of symbols never occurs more often than in the round before
unless one of them is new. So a round looks only at places where the pair might have repeated before
and at those beside a merged pair; there pairs are counted in hashed slots first, and sorted only
where the slot is full enough.

Layout (little endian): header; round bounds u4[rounds + 1]; rules, two symbols each; expansion
lengths u4[n]; document ids i8 and their validity bits; first symbol and first id of each
document i8[docs + 1] each; symbols. Symbols are stored as their low 16 bits, u2, and then one bit
plane for each further bit.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from millrace.llm.text_batches import ragged

HEADER = struct.Struct("<4sHHIIIQQ")
MAGIC = b"RPG2"
#: Pairs that become rules in the first round; how often a pair must occur to become one.
PAIRS, LEAST = 4096, 2


@dataclass
class Grammar:
    terminals: int
    bounds: np.ndarray  # rules known before each round, and after the last
    rules: np.ndarray
    lengths: np.ndarray  # of the expansion of each rule
    doc_ids: np.ndarray
    valid: np.ndarray  # False for a document whose id is null
    first_symbol: np.ndarray
    first_id: np.ndarray
    symbols: np.ndarray


def _slots(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    h = left.astype(np.uint32) * np.uint32(0x9E3779B1) ^ right.astype(np.uint32) * np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - bits)).view(np.int32)


def _round(seq: np.ndarray, places: np.ndarray, first: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rules, where they apply, symbols put there, places left): pairs begin at places, ascending."""
    bits = min(21, max(8, len(places).bit_length() + 1))
    left, right = seq[places], seq[places + 1]
    slots = _slots(left, right, bits).astype(np.int64)  # as numpy's lookups take them
    full = np.flatnonzero((np.bincount(slots, minlength=1 << bits) >= LEAST)[slots])
    places, slots = places[full], slots[full]
    nothing = np.zeros((0, 2), np.int32), places[:0], places[:0], places
    if not len(places):
        return nothing
    keys = left[full].astype(np.int64) << 32 | right[full]
    at = places
    goes_on = np.flatnonzero((keys[1:] == keys[:-1]) & (places[1:] == places[:-1] + 1)) + 1
    if len(goes_on):  # of a run of one symbol, every other pair
        nth = np.arange(len(goes_on))
        begins = np.concatenate([[True], goes_on[1:] != goes_on[:-1] + 1])
        even = np.ones(len(places), bool)
        even[goes_on[(nth - np.maximum.accumulate(np.where(begins, nth, 0))) & 1 == 0]] = False
        at, slots, keys = places[even], slots[even], keys[even]
    ordered = np.sort(keys)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(np.append(starts, len(ordered)))
    often = np.flatnonzero(counts >= LEAST)
    if not len(often):
        return nothing
    often = often[np.argsort(-counts[often], kind="stable")[:most]]
    # a pair whose slot another pair has, of the same or a higher count, waits for a later round
    chosen, table = ordered[starts[often]], np.full(1 << bits, -1, np.int32)
    table[_slots(chosen >> 32, chosen & 0xFFFFFFFF, bits)[::-1]] = np.arange(len(chosen), dtype=np.int32)[::-1]
    mine = np.flatnonzero((table >= 0)[slots])  # bytes first, as most places have no chosen pair
    rank = table[slots[mine]]
    same = chosen[rank] == keys[mine]
    at, rank = at[mine[same]], rank[same]
    # of pairs that overlap the more frequent one is merged
    apart = at[1:] > at[:-1] + 1
    best = np.concatenate([[True], apart | (rank[1:] < rank[:-1])]) & np.concatenate([apart | (rank[:-1] <= rank[1:]), [True]])
    at, rank = at[best], rank[best]
    frequent = np.bincount(rank, minlength=len(chosen)) >= LEAST
    at, rank = at[frequent[rank]], rank[frequent[rank]]
    number = first + np.cumsum(frequent) - 1
    rules = chosen[frequent]
    return np.stack([rules >> 32, rules & 0xFFFFFFFF], 1).astype(np.int32), at, number[rank].astype(np.int32), places


def compress(ids: np.ndarray, first_id: np.ndarray, doc_ids: np.ndarray, valid: np.ndarray, terminals: int) -> Grammar:
    """The grammar of documents ids[first_id[k]:first_id[k + 1]], none of them empty."""
    seq, bounds, found = ids.astype(np.int32), [0], [np.zeros((0, 2), np.int32)]
    last = np.zeros(len(seq), bool)
    last[first_id[1:] - 1] = True
    places, most = np.flatnonzero(~last[:-1]), PAIRS
    while len(places):
        new, at, symbols, places = _round(seq, places, terminals + bounds[-1], most)
        most *= 2
        if not len(new):
            break
        kept = np.ones(len(seq), bool)
        seq[at], kept[at + 1] = symbols, False
        last[at] |= last[at + 1]  # a merged symbol ends the document if its right half did
        now = np.cumsum(kept) - 1
        again = np.zeros(now[-1] + 1, bool)
        again[now[places[kept[places]]]] = again[now[at]] = again[np.maximum(now[at] - 1, 0)] = True
        seq, last = seq[kept], last[kept]
        again[-1] = False
        places = np.flatnonzero(again & ~last)
        found.append(new)
        bounds.append(bounds[-1] + len(new))
    rules = np.concatenate(found)
    lengths = np.ones(terminals + len(rules), np.int64)
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        lengths[terminals + lo : terminals + hi] = lengths[rules[lo:hi]].sum(1)
    first_symbol = np.concatenate([[0], np.flatnonzero(last) + 1])
    return Grammar(terminals, np.array(bounds), rules, lengths[terminals:], doc_ids, valid, first_symbol, first_id, seq)


def to_bytes(g: Grammar) -> bytes:
    planes = max(0, int(g.terminals + len(g.rules) - 1).bit_length() - 16)
    packed = lambda x: [(x & 0xFFFF).astype("<u2"), *(np.packbits((x >> (16 + k) & 1).astype(bool)) for k in range(planes))]
    head = HEADER.pack(MAGIC, len(g.bounds), planes, g.terminals, len(g.rules), len(g.doc_ids), len(g.symbols), int(g.first_id[-1]))
    parts = [g.bounds.astype("<u4"), *packed(g.rules.reshape(-1)), g.lengths.astype("<u4"), g.doc_ids.astype("<i8"), np.packbits(g.valid), g.first_symbol.astype("<i8"), g.first_id.astype("<i8"), *packed(g.symbols)]
    return head + b"".join(p.tobytes() for p in parts)


def from_bytes(blob: bytes) -> Grammar:
    magic, n_bounds, planes, terminals, n_rules, n_docs, n_symbols, _ = HEADER.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a grammar blob")
    at = HEADER.size

    def take(dtype: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, dtype, count, at)
        at += out.nbytes
        return out

    bits = lambda n: np.unpackbits(take("u1", (n + 7) // 8), count=n)

    def symbols(n: int) -> np.ndarray:
        out = take("<u2", n).astype(np.int32)
        for k in range(planes):
            out |= bits(n).astype(np.int32) << (16 + k)
        return out

    bounds, rules, lengths = take("<u4", n_bounds), symbols(2 * n_rules).reshape(-1, 2), take("<u4", n_rules)
    doc_ids, valid = take("<i8", n_docs), bits(n_docs).astype(bool)
    first_symbol, first_id = take("<i8", n_docs + 1), take("<i8", n_docs + 1)
    return Grammar(terminals, bounds, rules, lengths.astype(np.int64), doc_ids, valid, first_symbol, first_id, symbols(n_symbols))


def expand(g: Grammar, symbols: np.ndarray | None = None) -> np.ndarray:
    """All ids of the given symbols, by default of the whole shard."""
    symbols = g.symbols if symbols is None else symbols
    lengths = np.concatenate([np.ones(g.terminals, np.int64), g.lengths])
    starts = np.cumsum(lengths) - lengths
    pool = np.empty(int(lengths.sum()), np.int32)
    pool[: g.terminals] = np.arange(g.terminals)
    for lo, hi in zip(g.bounds, g.bounds[1:], strict=False):
        halves = g.rules[lo:hi].reshape(-1).astype(np.int64)
        if len(halves):
            begin = starts[g.terminals + lo]
            piece = pool[ragged(starts[halves], lengths[halves])]
            pool[begin : begin + len(piece)] = piece
    return pool[ragged(starts[symbols], lengths[symbols])]


def ids_at(g: Grammar, doc: int, start: int = 0, count: int | None = None) -> list[int]:
    """count ids of document number doc from its id number start on, expanding no others."""
    symbols = g.symbols[g.first_symbol[doc] : g.first_symbol[doc + 1]]
    of = lambda s: 1 if s < g.terminals else int(g.lengths[s - g.terminals])
    ends = np.cumsum([of(s) for s in symbols])
    count = int(ends[-1]) - start if count is None else count
    k = int(np.searchsorted(ends, start, side="right"))
    skip = start - (int(ends[k - 1]) if k else 0)
    stack, out = [int(s) for s in symbols[k:][::-1]], []
    while stack and len(out) < count:
        s = stack.pop()
        if skip >= of(s):
            skip -= of(s)
        elif s < g.terminals:
            out.append(s)
        else:
            a, b = g.rules[s - g.terminals]
            stack += [int(b), int(a)]
    return out

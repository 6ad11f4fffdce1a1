"""Prediction by partial matching over bytes, trained from the corpus.

The trie of byte contexts up to ORDER is held as counts of (context, symbol) pairs, packed into one number each, with the
symbol and the nearest bytes in the low bits; every shorter context is a mask away. A symbol that a context has not seen
escapes to the next shorter one (method D: half a count of each of the context's distinct symbols), where the symbols
that the longer context has seen are excluded. Below order 0 all symbols left are equally likely. The end of a text is a symbol.
"""

from __future__ import annotations

import numpy as np

from .common import LOWER_BYTES

ORDER = 5
BITS = 9
SYMBOLS = 257


def mask(order: int) -> int:
    """Of a packed context of ``order`` bytes with its symbol."""
    return (1 << BITS * (order + 1)) - 1


def pack(data: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all symbols of the texts, one after the other; how many symbols each text has).

    Symbols are 1 to 256 for bytes and 0 for the end, which also stands before the start of each text."""
    sizes = np.array([len(d) + 1 for d in data], dtype=np.int64)
    flat = np.frombuffer(b"".join(d + b"\0" for d in data), dtype=np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes) - 1
    flat[ends] = 0
    key = flat.copy()
    since = np.arange(len(flat)) - np.repeat(ends - sizes + 1, sizes)  # place within the text
    for j in range(1, order + 1):
        key[j:] |= np.where(since[j:] >= j, flat[:-j], 0) << (BITS * j)
    return key, sizes


def normalise(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(LOWER_BYTES)


def _sums(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values of the sorted ``at``, sums of n, place of each row's value)."""
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, dtype=np.int64)
    return at[first], np.add.reduceat(n, first) if len(at) else n[:0], np.cumsum(np.concatenate([[0], (at[1:] != at[:-1]).astype(np.int64)])) if len(at) else at


class LowOrders:
    """Counts of the orders below ``least``, from counts of packed pairs of order ``least`` - 1 or more: at most SYMBOLS to the
    power of ``least`` pairs, however large the corpus."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, least: int):
        self.least, self.tables = least, []
        for j in range(least):
            by = np.argsort(part := keys & mask(j), kind="stable")
            pairs, count, _ = _sums(part[by], n[by])
            contexts, total, _ = _sums(pairs >> BITS, count)
            self.tables.append((pairs, count, contexts, total, _sums(pairs >> BITS, (count > 0).astype(np.int64))[1]))
        self.excluded = []  # of order j: what the symbols that a context one byte longer has seen count for at order j
        for j in range(least - 1):
            pairs, count, *_ = self.tables[j + 1]
            own, _, _ = self.counts(pairs, j)
            self.excluded.append(_sums(pairs >> BITS, np.where(count > 0, own, 0))[1])

    def exclusions(self, keys: np.ndarray, j: int) -> np.ndarray:
        """The sum at order ``j`` of all symbols that the context of order ``j`` + 1 (below ``least``) has seen anywhere."""
        contexts, longer = self.tables[j + 1][2], (keys & mask(j + 1)) >> BITS
        if not len(contexts):
            return np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(contexts, longer), len(contexts) - 1)
        return np.where(contexts[at] == longer, self.excluded[j][at], 0)

    def counts(self, keys: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count of the pair, sum and number of kinds of its context) at order ``j`` for each packed pair."""
        pairs, count, contexts, total, kinds = self.tables[j]
        part = keys & mask(j)
        if not len(pairs):
            return (np.zeros(len(keys), dtype=np.int64),) * 3
        at, up = np.minimum(np.searchsorted(pairs, part), len(pairs) - 1), np.minimum(np.searchsorted(contexts, part >> BITS), len(contexts) - 1)
        known = contexts[up] == part >> BITS
        return np.where(pairs[at] == part, count[at], 0), np.where(known, total[up], 0), np.where(known, kinds[up], 0)


def low_orders(keys: np.ndarray, n: np.ndarray, least: int = 3) -> LowOrders:
    return LowOrders(keys, n, least)


def code_lengths(keys: np.ndarray, n: np.ndarray, low: LowOrders, order: int = ORDER) -> np.ndarray:
    """log10 probability of each packed pair, given all pairs that share its nearest bytes, as many as ``low`` has orders.

    n: training counts (0: the pair only occurs in texts that are scored). low: stands for the orders below, complete with
    what their contexts have seen, so that values do not depend on which other pairs are at hand."""
    logp, open_ = np.zeros(len(keys)), np.ones(len(keys), dtype=bool)
    seen_above = np.zeros(len(keys), dtype=np.int64)  # distinct symbols of the next longer context
    mass_above = None
    for j in range(order, -2, -1):
        if j == -1:
            left = SYMBOLS - seen_above
            logp -= np.where(open_, np.log10(np.maximum(left, 1)), 0)
            break
        if j >= low.least:
            # sort by this order's context and symbol
            part = keys & mask(j)
            by = np.argsort(part, kind="stable")
            pair, count, place = _sums(part[by], n[by])
            _, total, where = _sums(pair >> BITS, count)
            _, kinds, _ = _sums(pair >> BITS, (count > 0).astype(np.int64))
            own, tot, dist = (np.empty(len(keys), dtype=np.int64) for _ in range(3))
            own[by], tot[by], dist[by] = count[place], total[where][place], kinds[where][place]
        else:
            own, tot, dist = low.counts(keys, j)
        # what the longer context has seen is excluded: its symbols' counts here do not take part
        if mass_above is None:
            rest, kinds_left = tot, dist
        elif j < low.least - 1:  # the longer context's pairs lie in other tasks too
            rest, kinds_left = tot - low.exclusions(keys, j), dist - seen_above
        else:
            longer, symbol_seen = mass_above
            up, at = np.unique(longer, return_inverse=True)
            pairs_of = np.unique(np.stack([at[symbol_seen], (keys & 511)[symbol_seen]]), axis=1, return_index=True)[1]
            rows = np.flatnonzero(symbol_seen)[pairs_of]
            excluded = np.bincount(at[rows], weights=own[rows], minlength=len(up)).astype(np.int64)[at]
            rest, kinds_left = tot - excluded, dist - seen_above
        here = open_ & (own > 0)
        logp[here] += np.log10((own[here] - 0.5) / rest[here])
        away = open_ & ~here & (rest > 0)
        logp[away] += np.log10(kinds_left[away] / 2 / rest[away])
        open_ &= ~here
        mass_above = ((keys & mask(j)) >> BITS, own > 0)
        seen_above = dist
    return logp

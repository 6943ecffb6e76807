"""Counting quotient filter over 64-bit fingerprints, kept without loss.

A fingerprint splits into a shared prefix (the slice of the hash space that a filter is for), a quotient
and a remainder. The quotient names a home slot. Remainders of one quotient form a run in ascending order,
shifted right where slots are taken. Three bits a slot say which quotients have a run, where runs end, and
which slots hold the counter of the remainder before them; a remainder that occurs once has no counter.
As whole remainders are kept, entries() gives back exactly what was put in, and merging sorted entries is
lossless.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class QuotientFilter:
    prefix: int
    prefix_bits: int
    quotient_bits: int
    occupied: np.ndarray
    run_ends: np.ndarray
    counters: np.ndarray
    slots: np.ndarray

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray, prefix_bits: int) -> QuotientFilter:
        """Of distinct unsigned fingerprints in ascending order that share their first prefix_bits bits."""
        n = len(fingerprints)
        q = max(3, (n + n // 3).bit_length())
        r = 64 - prefix_bits - q
        prefix = int(fingerprints[0]) >> (64 - prefix_bits) if n and prefix_bits else 0
        remainders = fingerprints & np.uint64((1 << r) - 1)
        quotients = ((fingerprints >> np.uint64(r)) & np.uint64((1 << q) - 1)).astype(np.int64)
        width = 1 + (counts > 1).astype(np.int64)  # slots of each entry
        first = np.flatnonzero(np.concatenate([[True], quotients[1:] != quotients[:-1]])) if n else np.empty(0, np.int64)
        homes, lengths = quotients[first], np.add.reduceat(width, first) if n else first
        before = np.cumsum(lengths) - lengths
        starts = np.maximum.accumulate(homes - before) + before if n else first
        ends = starts + lengths - 1
        size = max(1 << q, int(ends[-1]) + 1 if n else 0)
        runs = np.searchsorted(first, np.arange(n), side="right") - 1
        at = starts[runs] + (np.cumsum(width) - width) - before[runs] if n else first
        occupied, run_ends, counters, slots = np.zeros(1 << q, bool), np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, np.uint64)
        occupied[homes] = True
        run_ends[ends] = True
        slots[at] = remainders
        many = counts > 1
        counters[at[many] + 1] = True
        slots[at[many] + 1] = counts[many].astype(np.uint64)
        return cls(prefix, prefix_bits, q, occupied, run_ends, counters, slots)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct fingerprints in ascending order, and how often each was put in."""
        quotients, ends = np.flatnonzero(self.occupied), np.flatnonzero(self.run_ends)
        if not len(quotients):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        starts = np.maximum(quotients, np.concatenate([[0], ends[:-1] + 1]))
        lengths = ends - starts + 1
        at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        owner, is_counter, values = np.repeat(quotients, lengths), self.counters[at], self.slots[at]
        of = np.cumsum(~is_counter) - 1
        counts = np.ones(of[-1] + 1, np.int64)
        counts[of[is_counter]] = values[is_counter].astype(np.int64)
        r = 64 - self.prefix_bits - self.quotient_bits
        top = np.uint64(self.prefix << (64 - self.prefix_bits)) if self.prefix_bits else np.uint64(0)
        return top | (owner[~is_counter].astype(np.uint64) << np.uint64(r)) | values[~is_counter], counts

    @classmethod
    def merge(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """One filter of all that the filters, of one prefix, hold; counts add up."""
        parts = [f.entries() for f in filters]
        fingerprints, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(fingerprints, kind="stable")
        fingerprints, counts = fingerprints[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], fingerprints[1:] != fingerprints[:-1]])) if len(order) else order
        return cls.build(fingerprints[first], np.add.reduceat(counts, first) if len(order) else counts, filters[0].prefix_bits)

    def count(self, fingerprints: np.ndarray) -> np.ndarray:
        """How often each of the fingerprints was put in."""
        held, counts = self.entries()
        if not len(held):
            return np.zeros(len(fingerprints), np.int64)
        at = np.minimum(np.searchsorted(held, fingerprints), len(held) - 1)
        return np.where(held[at] == fingerprints, counts[at], 0)

    def to_bytes(self) -> bytes:
        """Head, the bits, then the used slots in as many bytes as a remainder needs; counters follow in eight."""
        wide = -(-(64 - self.prefix_bits - self.quotient_bits) // 8)
        head = np.array([self.prefix, self.prefix_bits, self.quotient_bits, len(self.slots)], "<i8").tobytes()
        used = np.zeros(len(self.slots), bool)
        quotients, ends = np.flatnonzero(self.occupied), np.flatnonzero(self.run_ends)
        if len(ends):
            starts = np.maximum(quotients, np.concatenate([[0], ends[:-1] + 1]))
            steps = np.zeros(len(used) + 1, np.int64)
            steps[starts] += 1
            np.add.at(steps, ends + 1, -1)
            used = np.cumsum(steps)[:-1] > 0
        remainders = np.ascontiguousarray(self.slots[used & ~self.counters].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :wide]
        bits = [np.packbits(x).tobytes() for x in (self.occupied, self.run_ends, self.counters, used)]
        return b"".join([head, *bits, remainders.tobytes(), self.slots[self.counters].astype("<u8").tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> QuotientFilter:
        prefix, prefix_bits, q, size = np.frombuffer(raw, "<i8", 4).tolist()
        at, bits = 32, []
        for n in (1 << q, size, size, size):
            bits.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at), count=n).astype(bool))
            at += -(-n // 8)
        occupied, run_ends, counters, used = bits
        wide, held = -(-(64 - prefix_bits - q) // 8), used & ~counters
        full = np.zeros((int(held.sum()), 8), np.uint8)
        full[:, :wide] = np.frombuffer(raw, np.uint8, full.shape[0] * wide, at).reshape(-1, wide)
        slots = np.zeros(size, np.uint64)
        slots[held] = full.view("<u8").ravel()
        slots[counters] = np.frombuffer(raw, "<u8", int(counters.sum()), at + full.shape[0] * wide)
        return cls(prefix, prefix_bits, q, occupied, run_ends, counters, slots)

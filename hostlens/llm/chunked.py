"""Whole-text encoding through distinct space-delimited chunks.

A space between two characters that are not white space starts a new pre-token
in byte-level split patterns, so a text's ids are the ids of its chunks in
order.  Texts lie end to end in one byte vector: chunk ends are found, chunks
are hashed (128 bits) and grouped as vectors, each distinct chunk of a group of
texts is looked up or encoded once, and the ids are put together by index.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .common import mix64, span_sums

MAX_CHUNKS = 300_000  # distinct chunks kept per worker; beyond it the store starts anew
LONGEST_KEPT = 64  # bytes of a chunk that is worth keeping
GROUP_BYTES = 4 << 20


def _boundaries(raw: np.ndarray) -> np.ndarray:
    """Places of spaces that surely stand between two characters other than white space.

    Bytes up to 0x20 count as white space, as do all characters that share their first two bytes with
    some white space beyond ASCII."""
    n = len(raw)
    at = np.flatnonzero(raw == 0x20)
    at = at[(at > 0) & (at < n - 1)]
    before, after = raw[at - 1], raw[at + 1]
    ok = (before > 0x20) & (after > 0x20)
    at, before, after = at[ok], before[ok], after[ok]
    wide = (before >= 0x80) | (after >= 0x80)
    if wide.any():
        w = at[wide]

        def blank(a, b):  # two bytes that may begin white space
            return ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | (
                (a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))

        bad = blank(raw[w + 1], raw[np.minimum(w + 2, n - 1)]) | blank(raw[np.maximum(w - 2, 0)], raw[w - 1]) | blank(
            raw[np.maximum(w - 3, 0)], raw[np.maximum(w - 2, 0)])
        at = np.delete(at, np.flatnonzero(wide)[bad])
    return at


class ChunkedEncoder:
    """``learn`` gives the ids (as int32 bytes) of each of a list of strings."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]], most: int = MAX_CHUNKS):
        self.learn, self.most = learn, most
        self.known: dict[bytes, bytes] = {}

    def encode_rows(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows laid end to end, and the rows' offsets into them."""
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        begins = np.zeros(len(raw), bool)
        begins[starts[:-1][np.diff(starts) > 0]] = True
        begins[_boundaries(raw)] = True
        first = np.flatnonzero(begins)
        end = np.append(first[1:], len(raw))
        one, two = span_sums(raw, first)
        one = mix64(one ^ ((end - first).astype(np.uint64) << np.uint64(40)))
        order = np.argsort(one, kind="stable")
        a, b = one[order], two[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))  # unequal chunks of one hash only split a group
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        shown = order[new]
        data = raw.tobytes()
        chunks = [data[i:j] for i, j in zip(first[shown].tolist(), end[shown].tolist())]
        ids = list(map(self.known.get, chunks))
        if len(self.known) > self.most:  # start anew with what these texts need
            self.known = {c: v for c, v in zip(chunks, ids) if v is not None}
        unseen = [i for i, v in enumerate(ids) if v is None]
        for i, v in zip(unseen, self.learn([chunks[i].decode() for i in unseen])):
            ids[i] = v
            if len(chunks[i]) <= LONGEST_KEPT:
                self.known[chunks[i]] = v
        flat = np.frombuffer(b"".join(ids), np.int32)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        begin = np.cumsum(size) - size
        n = size[group]
        total = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.arange(total[-1]) + np.repeat(begin[group] - total[:-1], n)]
        return out, total[np.searchsorted(first, starts)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        k = 0
        while k < len(texts):
            part, size = [], 0
            while k < len(texts) and (not part or size < GROUP_BYTES):
                part.append((texts[k] or "").encode())
                size += len(part[-1])
                k += 1
            starts = np.concatenate([[0], np.cumsum([len(p) for p in part])])
            flat, offsets = self.encode_rows(np.frombuffer(b"".join(part), np.uint8), starts)
            out += [flat[i:j] for i, j in zip(offsets[:-1], offsets[1:])]
        return out

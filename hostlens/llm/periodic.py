"""Runs of periodic words by recompression.

A *run* is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are identical) of at least ``least_words`` words and ``least_exponent`` periods,
which no neighbouring word extends.  The words of a slice of texts, each text
between separators, are recompressed into a run-length grammar: rounds of block
compression (equal neighbours become one symbol with a count) and of pair
compression (symbols fall into left and right ones; a left one followed by a right
one becomes one symbol) alternate until little is left.  Equal stretches get equal
symbols but for a few at their borders, so the longest common extension of two
places climbs the levels while symbols agree and descends where they differ; all
queries of a slice go level by level together, to the right and, over the
mirrored levels, to the left.

A run of period ``p`` holds a place of the grid of step ``(least_exponent - 2) p``
at which words ``p`` apart agree, with room behind it.  The places of all grids
(a harmonic sum, ``n log n``) that agree in a few words are candidates; their exact
extensions give the runs.  A run's multiples of its period give the same stretch, of
which the least period counts.

Defined results: null and empty texts have no words and no runs; runs never cross
texts; every row is a text of its own (repeated rows and rows sharing an id each
give a row); a null id is kept; all input columns stay, in front, save ones named
like an output, which are replaced; a text is worked on whole (about 150 bytes of
vectors for each of its words), other texts in slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, row_groups, slices

SLICE_BYTES = 2 << 20
MOST_CANDIDATES = 1 << 21
MOST_LEVELS = 200
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
OUTPUTS = {"n_words": "bigint", "runs": RUN, "best": "struct<start:bigint,length:bigint,period:bigint,exponent_milli:bigint>",
           "collapsed": "string"}


# ---- the grammar ------------------------------------------------------------------------------------------------------

class _Level:
    """Symbols of a level, the word at which each begins (one more than symbols), and, towards the next
    level: each symbol's parent and each parent's first child (one more than parents)."""

    def __init__(self, symbol: np.ndarray, begin: np.ndarray):
        self.symbol, self.begin = symbol, begin
        self.parent = self.first = None

    def join(self, starts: np.ndarray, symbol: np.ndarray) -> "_Level":
        """The next level, whose symbols begin at the marked ones of this level."""
        self.parent = (np.cumsum(starts) - 1).astype(np.int32)
        self.first = np.append(np.flatnonzero(starts), len(starts)).astype(np.int32)
        return _Level(symbol, self.begin[self.first])

    def mirrored(self) -> "_Level":
        out = _Level(self.symbol[::-1], self.begin[-1] - self.begin[::-1])
        if self.parent is not None:
            out.parent = (len(self.first) - 2 - self.parent)[::-1]
            out.first = (len(self.symbol) - self.first)[::-1]
        return out


def _numbered(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int32)


def grammar(word: np.ndarray, enough: int = 64) -> list[_Level]:
    """Levels of ``word`` (ids of words), alternately after block and pair compression."""
    levels = [_Level(_numbered(word), np.arange(len(word) + 1, dtype=np.int32))]
    while len(levels[-1].symbol) > enough and len(levels) < MOST_LEVELS:
        top = levels[-1]
        s = top.symbol
        starts = np.append(True, s[1:] != s[:-1])
        count = np.diff(np.append(np.flatnonzero(starts), len(s)))
        levels.append(top.join(starts, _numbered((s[starts].astype(np.int64) << 32) | count)))
        top = levels[-1]
        s = top.symbol
        # left or right by a bit of the symbol's hash, of the two ways round the one with more pairs
        side = (mix64(s.astype(np.uint64) + np.uint64(len(levels) * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(1)).astype(bool)
        if np.count_nonzero(side[:-1] & ~side[1:]) < np.count_nonzero(~side[:-1] & side[1:]):
            side = ~side
        starts = np.append(True, ~(side[:-1] & ~side[1:]))
        one = s[starts].astype(np.int64)
        at = np.flatnonzero(starts)
        paired = np.append(at[1:], len(s)) - at == 2
        other = np.where(paired, s[np.minimum(at + 1, len(s) - 1)].astype(np.int64) + 1, 0)
        levels.append(top.join(starts, _numbered((one << 32) | other)))
    return levels


def common_extension(levels: list[_Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that agree from the places ``a`` and ``b`` on, ``a < b``; the last word differs from all others."""
    a0, n = a, len(a)
    i, j = a.copy(), b.copy()  # symbols of the current level
    stop = np.full(n, len(levels))  # the level at which a query's symbols differed
    live = np.arange(n)
    up = []
    for k, level in enumerate(levels):
        s, last = level.symbol, k == len(levels) - 1
        todo, ready = live, []
        while len(todo):
            same = s[i[todo]] == s[j[todo]]
            stop[todo[~same]] = k
            todo = todo[same]
            if not len(todo):
                break
            if last:
                i[todo] += 1
                j[todo] += 1
                continue
            # whoever stands at the beginning of a parent on both sides climbs
            pi, pj = level.parent[i[todo]], level.parent[j[todo]]
            both = (level.first[pi] == i[todo]) & (level.first[pj] == j[todo])
            ready.append(todo[both])
            todo, pi, pj = todo[~both], pi[~both], pj[~both]
            if k % 2 == 0:  # towards blocks: as far as both blocks of the symbol go
                step = np.minimum(level.first[pi + 1] - i[todo], level.first[pj + 1] - j[todo])
            else:
                step = 1
            i[todo] += step
            j[todo] += step
        live = np.concatenate(ready) if ready else live[:0]
        up.append(live)
        if not last:
            i[live], j[live] = level.parent[i[live]], level.parent[j[live]]
    # down again: symbols that differ agree in their first children
    for k in range(len(levels) - 2, -1, -1):
        level = levels[k]
        down = up[k]
        i[down], j[down] = level.first[i[down]], level.first[j[down]]
        todo = down
        while len(todo):
            todo = todo[level.symbol[i[todo]] == level.symbol[j[todo]]]
            if not len(todo):
                break
            if k % 2 == 0:
                pi, pj = level.parent[i[todo]], level.parent[j[todo]]
                step = np.minimum(level.first[pi + 1] - i[todo], level.first[pj + 1] - j[todo])
            else:
                step = 1
            i[todo] += step
            j[todo] += step
    return levels[0].begin[i].astype(np.int64) - a0


# ---- runs -----------------------------------------------------------------------------------------------------------------

def _candidates(word: np.ndarray, first: np.ndarray, n: np.ndarray, least_words: int, least_exponent: int):
    """(place, period) of the grids, in parts of bounded size, where the words a period apart agree for a few words."""
    spread = least_exponent - 2
    most = np.where(n >= least_words, n // least_exponent, 0)  # largest period of each text
    text = np.repeat(np.arange(len(n)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    places = (n[text] - period - 1) // (spread * period) + 1
    upto = np.concatenate([[0], np.cumsum(places)])
    for lo, hi in row_groups(upto, MOST_CANDIDATES):
        many = places[lo:hi]
        p = np.repeat(period[lo:hi], many)
        t = np.repeat(text[lo:hi], many)
        at = (np.arange(int(many.sum())) - np.repeat(upto[lo:hi] - upto[lo], many)) * spread * p
        limit = n[t]
        at += first[t]
        limit += first[t]
        for k in range(4):  # a run has words p apart in agreement for p + 1 words from some place of the grid on
            ok = (k > p) | (at + p + k < limit)
            ok &= (k > p) | (word[at + np.minimum(k, p)] == word[np.minimum(at + p + k, limit - 1)])
            at, p, limit = at[ok], p[ok], limit[ok]
        yield at, p


def find_runs(word: np.ndarray, first: np.ndarray, n: np.ndarray, least_words: int = 6, least_exponent: int = 4) -> np.ndarray:
    """(text, start in the text, length, period) rows of all runs, by text, start and period.

    ``word`` holds the ids of the words of all texts, a separator of id -1 before each text and after the
    last; ``first`` and ``n`` are the texts' first places and numbers of words."""
    if least_exponent < 3:
        raise ValueError("grids need runs of three periods at least")
    found, levels = [], None
    for at, p in _candidates(word, first, n, least_words, least_exponent):
        if not len(at):
            continue
        if levels is None:
            levels = grammar(word)
            mirror = [x.mirrored() for x in levels]
        right = common_extension(levels, at, at + p)
        end = len(word)
        left = common_extension(mirror, end - at - p, end - at)  # from the words before both, to the left
        size = left + right + p
        ok = size >= np.maximum(least_words, least_exponent * p)
        found.append(np.stack([at[ok] - left[ok], size[ok], p[ok]], axis=1))
    if not found:
        return np.zeros((0, 4), np.int64)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)  # of one stretch the least period
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[new]
    text = np.searchsorted(first, runs[:, 0], side="right") - 1
    runs = np.column_stack([text, runs[:, 0] - first[text], runs[:, 1], runs[:, 2]])
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """Of (start, length, period) in order of start and period, the first of greatest exact exponent."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, end to end, and each text's number of words."""
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    offsets = parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    some = pc.not_equal(pc.binary_length(flat), 0)
    seen = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return flat.filter(some), np.diff(seen[offsets]).astype(np.int64)


def periodic_runs(df: DataFrame, least_words: int = 6, least_exponent: int = 4, text_col: str = "text") -> DataFrame:
    """All columns, ``n_words``, ``runs`` (by start, then period), ``best`` (the run of greatest length/period, null
    without a run) and ``collapsed``: the words that no run holds after its first period, joined by one space."""
    keep = [f for f in df.schema.fields if f.name not in OUTPUTS]
    kinds = T._parse_datatype_string(", ".join(f"`{c}` {t}" for c, t in OUTPUTS.items())).fields
    schema = T.StructType(keep + list(kinds))
    hidden = "text of periodic_runs"
    rows = df.select(*[F.col(f"`{f.name}`") for f in keep], F.coalesce(F.col(text_col), F.lit("")).alias(hidden))
    run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    best_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period", "exponent_milli")])

    def run(batches):
        for part in slices(batches, hidden, SLICE_BYTES):
            words, n = _words(part.column(len(keep)))
            code = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            first = np.cumsum(n + 1) - n  # a separator before each text
            word = np.full(int(n.sum()) + len(n) + 1, -1, np.int32)
            word[np.arange(len(code)) + np.repeat(np.arange(len(n)) + 1, n)] = code
            found = find_runs(word, first, n, least_words, least_exponent)
            cuts = np.searchsorted(found[:, 0], np.arange(len(n) + 1))
            depth = np.zeros(len(word) + 1, np.int64)
            np.add.at(depth, first[found[:, 0]] + found[:, 1] + found[:, 3], 1)
            np.add.at(depth, first[found[:, 0]] + found[:, 1] + found[:, 2], -1)
            stays = (np.cumsum(depth)[:-1] == 0) & (word >= 0)
            kept = np.bincount(np.repeat(np.arange(len(n)), n), weights=stays[word >= 0], minlength=len(n)).astype(np.int64)
            left = words.filter(pa.array(stays[word >= 0]))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)), left)
            triples = [tuple(r) for r in found[:, 1:].tolist()]
            best = [best_run(triples[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            best = [b and {"start": b[0], "length": b[1], "period": b[2], "exponent_milli": 1000 * b[1] // b[2]} for b in best]
            structs = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], fields=list(run_type))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(n), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), structs),
                 pa.array(best, best_type), pc.binary_join(lists, " ")], schema.names)

    return rows.mapInArrow(run, schema)

"""Jaccard self-join of shingle sets by PartEnum signatures, and its connected components.

Sets fall into bands of sizes; two sets of at least the wanted similarity lie
in one band or in adjacent ones and differ in at most ``k`` elements, ``k``
known for each pair of bands.  The feature domain (64-bit shingle hashes) is cut
into ``k // 2 + 1 + g`` parts, each into ``pieces``; more than ``g`` parts then
hold at most one difference, so all but one of their pieces agree: a signature
stands for (bands, part, all pieces but one, their elements), and similar sets
share one.  Signatures without elements would bring unlike sets together.  ``g``
is chosen so that few sets have more than ``g`` parts with such a signature; a
set with at most ``g`` shares another one with each similar set, so only the
others give their empty signatures too.

1. Equal sets are one class, named by its least id; only classes are joined.
2. Sets that share a signature make a list.  A list's sets are linked to its first
   where piece counts of a bounded size (``_sketch``) do not tell them apart; the
   components of these links are families.
3. Sets of lists of several families are put in one order of elements, rare ones
   first; similar sets share one of their first ``n - percent * n / 100 + 1``.  Sets
   of different families that share one meet in tasks of two bounded blocks, in which
   an element's largest family does not meet itself; where neither the sketches nor
   what is left of both from that element on rules the similarity out, their families
   become one.
4. A family's sets meet in tasks of two bounded blocks each; piece counts bound
   the difference from below, what passes is compared element by element, and a
   task returns the links that connect its sets, not all pairs.

Every similar pair shares a signature, hence a family, hence a block pair.

Defined results: null or empty texts have the empty set and are linked with
nothing; repeated rows each give a row; rows of equal id are one document (its
links are those of any of its rows); a null id joins no link but gets the
component of an equal set with an id; only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, binary_view, gathered, hashed_words, listed, mix64, saved, slices
from .components import connected_components

BLOCK_SETS, BLOCK_ELEMENTS = 512, 400_000
FEW = 64  # a signature's sets go as one list up to so many
CELLS = 256
BUCKET_BITS = 16
HELD = 1 << 16  # rows of an element that are looked at together


def shingle_sets(raw: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and the rows' offsets into them."""
    _, _, row, word = hashed_words(LOWER[raw], starts)
    n_words = np.bincount(row, minlength=len(starts) - 1)
    first = np.concatenate([[0], np.cumsum(n_words)])
    shingle = np.full(len(word), np.uint64(size))
    for k in range(size):  # short rows: the words there are, then nothing
        part = np.zeros(len(word), np.uint64)
        part[:max(len(word) - k, 0)] = word[k:]
        inside = np.arange(len(word)) + k < first[row + 1]
        shingle = mix64(shingle * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, part, np.uint64(0)))
    keep = np.arange(len(word)) < first[row] + np.maximum(n_words[row] - size + 1, 1)
    row, shingle = row[keep], shingle[keep]
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    row, shingle = row[new], shingle[new]
    return shingle, np.searchsorted(row, np.arange(len(starts)))


def _set_keys(shingle: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set: sums of two mixes of its elements."""
    out = []
    for salt in (0xA5A5A5A5DEADBEEF, 0x0123456789ABCDEF):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(shingle ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def bands(most: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sizes of the bands up to size ``most`` (and one more), their last sizes, and the most elements
    in which similar sets of a band and the one before differ."""
    first, last = [1], []
    while not last or last[-1] < most or len(last) < 3:
        last.append(max(first[-1], first[-1] * 100 // percent))
        first.append(last[-1] + 1)
    last.append(max(first[-1], first[-1] * 100 // percent))
    last = np.array(last)
    return np.array(first), last, 2 * last * (100 - percent) // (100 + percent)


def _spare(first: np.ndarray, differ: np.ndarray, pieces: int) -> np.ndarray:
    """``g`` for each pair of bands, from the sizes of the lower one."""
    out = []
    for j, k in enumerate(differ.tolist()):
        size, g = float(first[max(j - 1, 0)]), 0
        while g < k // 2:
            parts = k // 2 + 1 + g
            weak = parts * pieces * np.exp(-size / parts * (pieces - 1) / pieces)
            if g >= weak + 3 * np.sqrt(weak):
                break
            g += 1
        out.append(g)
    return np.array(out)


def signatures(shingle: np.ndarray, offsets: np.ndarray, percent: int, pieces: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of each set, for its band with the one before and with the one after."""
    size = np.diff(offsets)
    first, _, differ = bands(int(size.max(initial=1)), percent)
    first = np.append(first, first[-1] * 2)[:len(differ)]
    spare = _spare(first, differ, pieces)
    band = np.searchsorted(first, size, side="right") - 1
    row = np.repeat(np.arange(len(size)), size)
    spread = mix64(shingle ^ np.uint64(0x5851F42D4C957F2D))
    value = mix64(shingle ^ np.uint64(0x14057B7EF767814F))
    piece = ((spread & np.uint64(0xFFFFFFFF)) * np.uint64(pieces) >> np.uint64(32)).astype(np.int64)
    sigs, rows = [], []
    for join in (0, 1):  # with the band before; with the band after
        b = band + join
        k = np.where(size > 0, differ[b], 0)
        parts = np.where(k > 0, k // 2 + 1 + spare[b], 0)  # no difference allowed: equal sets, one class already
        base = np.concatenate([[0], np.cumsum(parts)])
        use = parts[row] > 0
        part = ((spread[use] >> np.uint64(32)) * parts[row[use]].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        at = (base[row[use]] + part) * pieces + piece[use]
        cell = np.zeros(int(base[-1]) * pieces, np.uint64)
        np.add.at(cell, at, value[use])
        cell = cell.reshape(-1, pieces)
        held = np.bincount(at, minlength=cell.size).reshape(-1, pieces)
        owner = np.repeat(np.arange(len(size)), parts)
        number = np.arange(int(base[-1])) - base[owner]
        key = mix64((b[owner].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64) * np.uint64(pieces + 1))
        left = held.sum(axis=1, keepdims=True) - held  # elements of all pieces but one
        weak = np.bincount(owner, weights=(left == 0).any(axis=1), minlength=len(size))
        many = weak > spare[b]
        mixed = mix64(cell ^ np.arange(1, pieces + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) + np.arange(pieces, dtype=np.uint64)
        together = mixed.sum(axis=1, dtype=np.uint64)
        for q in range(pieces):
            give = (left[:, q] > 0) | many[owner]
            sig = mix64(mix64(together - mixed[:, q] + np.uint64(q * 0x9E3779B97F4A7C15 % 2**64)) + key)
            sigs.append(sig[give].view(np.int64))
            rows.append(owner[give])
    return np.concatenate(sigs), np.concatenate(rows)


def _sketch(elements: np.ndarray) -> bytes:
    """Numbers of elements by their leading bits, in about one cell for eight elements."""
    bits = max(3, min(16, (len(elements) >> 3).bit_length()))
    cells = np.bincount((elements >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(cells, 255).astype(np.uint8).tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """A lower bound of the number of elements in which two sets differ."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int32), np.frombuffer(y, np.uint8).astype(np.int32)
    while len(a) > len(b):
        a = np.minimum(a.reshape(-1, 2).sum(axis=1), 255)
    while len(b) > len(a):
        b = np.minimum(b.reshape(-1, 2).sum(axis=1), 255)
    return int(np.abs(a - b).sum())


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, k1, k2, sketch): the size, 128 bits and cell counts of every row's set."""

    def run(batches):
        for batch in slices(batches, "text", 1 << 20):
            shingle, offsets = shingle_sets(*binary_view(batch.column(1)), size)
            k1, k2 = _set_keys(shingle, offsets)
            sketch = pa.array([_sketch(shingle[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(k1), pa.array(k2), sketch],
                                             ["doc_id", "n", "k1", "k2", "sketch"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, k1 bigint, k2 bigint, sketch binary")


LISTS = "ids array<bigint>, sig bigint, doc_id bigint"


def _shared_lists(docs: DataFrame, size: int, percent: int, pieces: int) -> DataFrame:
    """Rows of ``ids``, the documents that share a signature if they are few (each list once a task), and rows
    ``(sig, doc_id)`` of the signatures of many.

    Equal sets of a slice go once.  Sorted signatures are read as a stream: a group of any size needs no room."""

    def run(batches):
        for batch in slices(batches, "text", 1 << 20):
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            shingle, offsets = shingle_sets(*binary_view(batch.column(1)), size)
            sig, row = signatures(shingle, offsets, percent, pieces)
            k1, k2 = _set_keys(shingle, offsets)
            order = np.lexsort((ids, k2, k1))
            same = np.zeros(len(ids), bool)
            same[order[1:]] = (k1[order[1:]] == k1[order[:-1]]) & (k2[order[1:]] == k2[order[:-1]])
            fresh = ~same[row]
            yield pa.RecordBatch.from_arrays([pa.array(sig[fresh]), pa.array(ids[row[fresh]])], ["sig", "doc_id"])

    def batch_of(lists: list[np.ndarray], sig: np.ndarray, who: np.ndarray) -> pa.RecordBatch:
        ends = np.cumsum([0, *[x.size for x in lists]])
        sizes = np.concatenate([[0], *[np.arange(1, len(x) + 1) * x.shape[1] + e for x, e in zip(lists, ends)]]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int64), *[x.ravel() for x in lists]])
        n, m = len(sizes) - 1, len(sig)
        ids = pa.concat_arrays([pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)), pa.nulls(m, pa.list_(pa.int64()))])
        both = [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(x, pa.int64())]) for x in (sig, who)]
        return pa.RecordBatch.from_arrays([ids, *both], ["ids", "sig", "doc_id"])

    def group(batches):
        sig, who = np.zeros(0, np.int64), np.zeros(0, np.int64)  # rows of the signature read last
        crowded = False  # many rows of it were given already
        for batch in _with_end(batches):
            if batch is not None:
                sig, who = (np.concatenate([x, batch.column(k).to_numpy(zero_copy_only=False)]) for k, x in ((0, sig), (1, who)))
            if not len(sig):
                continue
            at = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            count = np.diff(np.append(at, len(sig)))
            crowd = count > FEW
            crowd[0] |= crowded
            goes_on = batch is not None  # the last signature may: it is kept while few, else one row of it
            closed = ~crowd
            closed[-1] &= not goes_on
            lists = []
            for c in np.unique(count[closed]).tolist():
                if c > 1:
                    rows = who[at[closed & (count == c)][:, None] + np.arange(c)]
                    lists.append(np.unique(rows.view(f"V{8 * c}")).view(np.int64).reshape(-1, c))
            use = np.repeat(crowd, count)
            yield batch_of(lists, sig[use], who[use])
            crowded = bool(goes_on and crowd[-1])
            keep = slice(len(sig) - 1 if crowded else at[-1] if goes_on else len(sig), None)
            sig, who = sig[keep], who[keep]

    found = docs.mapInArrow(run, "sig bigint, doc_id bigint")
    return found.repartition("sig").sortWithinPartitions("sig", "doc_id").mapInArrow(group, LISTS)


def _with_end(batches):
    yield from batches
    yield None


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches leave room for the similarity."""
    def side(c):
        return sketches.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    def run(batches):
        for batch in batches:
            a, b, na, nb, sa, sb = (batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "s_a", "s_b"))
            ok = [100 * min(m, n) >= percent * max(m, n) and _apart(x, y) * (100 + percent) <= (m + n) * (100 - percent)
                  for m, n, x, y in zip(na, nb, sa, sb)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint")


def _bucket_counts(docs: DataFrame, size: int) -> np.ndarray:
    """Numbers of elements of the sets of ``docs`` by their leading bits (a table of fixed size)."""

    def run(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in slices(batches, "text", 1 << 20):
            shingle, _ = shingle_sets(*binary_view(batch.column(0)), size)
            total += np.bincount((shingle >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "c"])

    found = docs.select("text").mapInArrow(run, "bucket bigint, c bigint").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    out[found["bucket"].to_numpy()] = found["c"].to_numpy()
    return out


RARE = "element bigint, rep bigint, n bigint, room bigint, component bigint"


def _rare_elements(docs: DataFrame, size: int, percent: int, counts: np.ndarray) -> DataFrame:
    """The rarest elements of each set of ``docs`` (doc_id, text, component), enough for similar sets to share one.

    All sets are in one order, by ``counts`` and then by hash; ``room`` is the number of a set's elements from this one on."""

    def run(batches):
        for batch in slices(batches, "text", 1 << 20):
            shingle, offsets = shingle_sets(*binary_view(batch.column(1)), size)
            n = np.diff(offsets)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((counts[(shingle >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], row))  # stable: by hash within a count
            rank = np.arange(len(row)) - offsets[row]
            use = rank < (n - (percent * n + 99) // 100 + 1)[row]
            rank, row, element = rank[use], row[use], shingle[order[use]].view(np.int64)
            doc, family = (batch.column(k).to_numpy()[row] for k in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (element, doc, n[row], n[row] - rank, family)],
                                             ["element", "rep", "n", "room", "component"])

    return docs.mapInArrow(run, RARE)


def _mixed_groups(rows: DataFrame) -> DataFrame:
    """Of ``rows`` those of elements that sets of several families have (long groups are given unseen)."""

    def run(batches):
        held, crowded = np.zeros((5, 0), np.int64), False  # rows of the element read last; whether many were given already
        for batch in _with_end(batches):
            if batch is not None:
                held = np.concatenate([held, np.stack([batch.column(k).to_numpy() for k in range(5)])], axis=1)
            if not held.shape[1]:
                continue
            at = np.flatnonzero(np.append(True, held[0, 1:] != held[0, :-1]))
            count = np.diff(np.append(at, held.shape[1]))
            give = np.minimum.reduceat(held[4], at) != np.maximum.reduceat(held[4], at)
            give[0] |= crowded
            left = held.shape[1]
            if batch is not None:  # the last element may go on
                crowded = crowded and len(at) == 1 or bool(count[-1] > HELD)
                left = left - 1 if count[-1] > HELD else at[-1]
                give[-1] |= crowded
            use = np.repeat(give, count)
            use[left:] = False
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[:, use]], ["element", "rep", "n", "room", "component"])
            held = held[:, left:]

    return rows.repartition("element").sortWithinPartitions("element").mapInArrow(run, RARE)


def _meetings(groups: DataFrame, documents: int | None = None) -> DataFrame:
    """``groups`` dealt into tasks (``one``, ``two``) of two bounded blocks, in which sets of different families meet.

    An element's largest family need not meet itself: its rows go once for each block of the others."""
    mine = F.xxhash64("rep")
    per = groups.groupBy("element", "component").agg(
        F.count("*").alias("c"), F.sum(mine.cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("x"), F.sum("room").alias("room"))
    per = per.groupBy("element").agg(
        F.sum("c").alias("c"), F.sum("s").alias("s"), F.bit_xor("x").alias("x"), F.sum("room").alias("room"), F.max("c").alias("most"),
        F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("families")).where("families > 1")
    # elements of the same sets: the first in the order, where all have most room
    kept = per.groupBy("c", "s", "x").agg(F.max_by(F.struct("element", "main", "most"), "room").alias("k"))
    kept = kept.select("k.element", "k.main", F.ceil(F.col("k.most") / BLOCK_SETS).alias("mains"), F.ceil((F.col("c") - F.col("k.most")) / BLOCK_SETS).alias("others"))
    rows = groups.join(saved(gathered(kept, documents), "kept-elements"), "element")
    main = F.col("component") == F.col("main")
    rows = rows.withColumn("block", F.when(main, F.lit(-1) - F.pmod(mine, "mains")).otherwise(F.pmod(mine, "others")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(main, F.lit(0).cast("bigint")).otherwise(-F.col("mains")), F.col("others") - 1)))
    return rows.withColumn("one", F.greatest("block", "other")).withColumn("two", F.least("block", "other")).select(
        "element", "one", "two", "block", "rep", "n", "room", "component")


def _possible_links(ids, size, room, family, whole, side, percent: int) -> list[tuple[int, int]]:
    """Pairs of sets of two blocks (or one) whose sketches and room leave the similarity open, as many as join families."""
    sketches = [np.frombuffer(x, np.uint8).astype(np.int32) for x in whole]
    width = min(len(x) for x in sketches)
    cells = np.stack([np.minimum(x.reshape(width, -1).sum(axis=1), 255) for x in sketches])
    root = {f: f for f in family.tolist()}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i in range(len(ids) - 1):
        rest = slice(i + 1, None)
        both = size[rest] + size[i]
        ok = (np.minimum(room[rest], room[i]) * (100 + percent) >= percent * both) & (family[rest] != family[i])
        if side is not None:
            ok &= side[rest] != side[i]
        ok = np.flatnonzero(ok) + i + 1
        if not len(ok):
            continue
        apart = np.abs(cells[ok] - cells[i]).sum(axis=1)
        for j in ok[apart * (100 + percent) <= (size[ok] + size[i]) * (100 - percent)].tolist():
            a, b = find(int(family[i])), find(int(family[j]))
            if a != b and _apart(whole[i], whole[j]) * (100 + percent) <= (size[i] + size[j]) * (100 - percent):
                root[max(a, b)] = min(a, b)
                links.append((int(ids[i]), int(ids[j])))
    return links


def _meeting_links(meetings: DataFrame, percent: int) -> DataFrame:
    """(a, b) of sets that met and may be similar; a task's meetings are read as a stream, one at a time."""

    def run(batches):
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                held = pa.Table.from_batches(([batch] if held is None else held.to_batches() + [batch])).combine_chunks()
            if held is None or not len(held):
                continue
            element, one, two, block, ids, size, room, family = (held.column(k).to_numpy() for k in range(8))
            new = (element[1:] != element[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            at = np.append(np.flatnonzero(np.append(True, new)), len(held))
            if batch is not None:  # the last meeting may go on
                at = at[:-1]
            links, whole = [], held.column(8).slice(0, at[-1]).to_pylist()
            for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
                side = block[x:y] == two[x] if one[x] != two[x] else None
                if y > x + 1:
                    links += _possible_links(ids[x:y], size[x:y], room[x:y], family[x:y], whole[x:y], side, percent)
            held = held.slice(at[-1])
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = meetings.repartition("element", "one", "two").sortWithinPartitions("element", "one", "two")
    return dealt.select("element", "one", "two", "block", "rep", "n", "room", "component", "sketch").mapInArrow(run, "a bigint, b bigint")


def _dealt(rows: DataFrame, group: str, node: str, blocks: DataFrame) -> DataFrame:
    """``rows`` of each group dealt into its number of blocks, once for each pair of blocks (``one``, ``two``)."""
    some = rows.join(blocks, group).withColumn("block", F.pmod(F.xxhash64(node), "blocks"))
    some = some.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return some.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))


def _block_links(percent: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Links that connect the sets of two blocks (or one), none between those connected already."""
        _, one, two = key
        ids = pdf["node"].to_numpy()
        side = (pdf["block"] == two).to_numpy() if one != two else None
        sets = [np.frombuffer(x, np.uint64) for x in pdf["elements"]]
        size = np.array([len(s) for s in sets])
        cells = np.stack([np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=CELLS) for s in sets]).astype(np.int32)
        root = {i: i for i in ids.tolist()}

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        links = []
        for i in range(len(ids)):
            rest = slice(i + 1, None)
            ok = 100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])
            if side is not None:
                ok &= side[rest] != side[i]
            ok = np.flatnonzero(ok) + i + 1
            apart = np.abs(cells[ok] - cells[i]).sum(axis=1)  # at most the number of differing elements
            for j in ok[apart * (100 + percent) <= (size[ok] + size[i]) * (100 - percent)].tolist():
                a, b = find(int(ids[i])), find(int(ids[j]))
                if a != b:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (size[i] + size[j] - both):
                        root[max(a, b)] = min(a, b)
                        links.append((int(ids[i]), int(ids[j])))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def _listed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of ``ids``, and few others."""
    return listed(docs.where("doc_id is not null"), F.xxhash64("doc_id"), ids.select(F.xxhash64("doc_id").alias("h")), ids.count())


def similar_components(df: DataFrame, size: int = 3, percent: int = 90, pieces: int = 3, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: components of ``100 * |A n B| >= percent * |A u B|``.

    Fewer ``pieces`` make fewer signatures of fewer elements each, which suits lower similarities."""
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sets = saved(_sets(docs, size), "sets")
    rows = sets.count()

    def kept(found: DataFrame, name: str) -> DataFrame:
        return saved(gathered(found, rows), name)

    classes = sets.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"))
    named = kept(sets.join(kept(classes, "classes"), ["n", "k1", "k2"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"), "sketch"), "named")
    reps = named.where("doc_id is not null and n > 0").select("doc_id", "rep").distinct()
    sketches = named.where("doc_id = rep and n > 0").select("rep", "n", "sketch").distinct()  # an id's rows each with theirs
    shared = kept(_shared_lists(docs, size, percent, pieces), "lists")
    few = shared.where("ids is not null").select("ids").distinct().select(F.xxhash64("ids").alias("list"), F.explode("ids").alias("doc_id"))
    crowds = kept(shared.where("ids is null").select(F.col("sig").alias("list"), "doc_id").join(reps, "doc_id").select("list", "rep").distinct(), "crowds")
    # crowds of the same sets: one of them
    alike = crowds.groupBy("list").agg(F.count("*").alias("c"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("x"))
    alike = kept(alike.where("c > 1").groupBy("c", "s", "x").agg(F.min("list").alias("list")).select("list"), "alike")
    member = few.join(reps, "doc_id").select("list", "rep").distinct().unionByName(crowds.join(alike, "list"))
    member = kept(member, "list-members")
    first = member.groupBy("list").agg(F.min("rep").alias("b"))
    stars = member.join(first, "list").select(F.col("rep").alias("a"), "b").where("a <> b").distinct()
    links = kept(_possible(stars, sketches, percent), "links")
    families = saved(connected_components(links, rows=rows), "families")
    # sets of a list in different families
    placed = member.join(families.select(F.col("node").alias("rep"), "component"), "rep", "left")
    placed = placed.withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("list").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    mixed = kept(placed.join(mixed.select("list"), "list").select(F.col("rep").alias("doc_id"), "component").distinct(), "mixed")
    some = _listed(docs, mixed)
    rare = _rare_elements(some.join(mixed, "doc_id").select("doc_id", "text", "component"), size, percent, _bucket_counts(some, size))
    meetings = _meetings(kept(_mixed_groups(rare), "mixed-elements"), rows)
    more = _meeting_links(meetings.join(sketches, ["rep", "n"]), percent)
    more = kept(more.distinct(), "more-links")
    if more.limit(1).count():
        families = saved(connected_components(links.unionByName(more), rows=rows), "families")
    some = _listed(docs, families.select(F.col("node").alias("doc_id")))

    def elements(batches):
        for batch in slices(batches, "text", 1 << 20):
            shingle, offsets = shingle_sets(*binary_view(batch.column(1)), size)
            raw = shingle.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(
                [raw[8 * a:8 * b] for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())], ["node", "n", "elements"])

    members = saved(some.mapInArrow(elements, "node bigint, n bigint, elements binary").where("n > 0").join(families, "node"), "members")
    blocks = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_ELEMENTS)).alias("blocks"))
    dealt = _dealt(members, "component", "node", kept(blocks, "blocks")).select("component", "one", "two", "node", "block", "elements")
    links = dealt.groupBy("component", "one", "two").applyInPandas(_block_links(percent), "a bigint, b bigint")
    # an id whose rows have unequal sets links their classes
    ties = reps.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).where("a <> b")
    ties = reps.join(ties.select("doc_id", "b"), "doc_id").select(F.col("rep").alias("a"), "b")
    found = saved(connected_components(links.unionByName(ties), rows=rows), "components")
    return (named.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")))

"""Operator 10: exact n-gram Jaccard join as a metric-space join.

A document's set is its distinct shingles of ``SHINGLE`` words (64-bit hashes
of A-Z lower-cased, white-space separated words; with fewer words the whole
sequence is one shingle).  Two documents link when their similarity is at least
``NUMERATOR / DENOMINATOR``, that is within radius r = 1 - similarity of the
Jaccard distance, a metric.  The result is the classes of the link graph.

1. Equal sets (distance 0) are one class; from here on a class stands for them.
2. First pivots are single shingles, ranked by one global order (rare ones
   first, by a fixed-size count sketch over the whole corpus, then by hash).
   The nearest pivot of a document is its first shingle; the documents within
   r of it may miss that one but none of the first n - ceil(s n) + 1, so a
   document is replicated to the cells of these: each linked pair shares one.
   Cells are cut where neighbouring sizes differ by more than s.
   A parity signature of n to 2 n bits bounds the symmetric difference of two
   sets from below; members of a cell that no chain of pairs within the bound
   joins are kept apart.  Documents that cells join form a region (connected
   components); regions don't link to each other.
3. A region is split: ``PIVOTS`` members become pivots and are linked to the
   members within r of them.  Each other member is at home in the Voronoi
   region of its nearest pivot and, as a boundary document, in those whose
   pivot is at most 2 r farther away and of whose members some may be within r
   by the windows of all pivots' distances.  Home members are compared with
   home and boundary members, and each Voronoi region is split again in the
   same way until it has no two classes or no member that wasn't a pivot.
4. A region of up to ``REGION_SHINGLES`` does all of this in one task, with
   distances from its inverted lists; a larger one has its first splits across
   tasks, with its rows salted, until the parts fit.  A part that a split
   doesn't shrink is dealt into blocks and joined block by block, so the join
   stays exact at any size.

Links within regions are joined to classes by connected components.  Nothing
is capped; hot groups cost one entry for each batch and cell.

Defined results: null and empty texts have empty sets, are linked with nothing
and are their own class.  Ids keep their type, any that Spark orders; "least"
is by its order.  Rows with equal ids are told apart by their texts;
repeated rows get equal results.  A class of rows without ids has a null id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm import wordhash
from verdigris.llm.common import bounded_broadcast, bytes_of, free_name, named, partitions_for, released, row_slices, stored
from verdigris.llm.components import components

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
#: Counters of the sketch (2**SKETCH_BITS).
SKETCH_BITS = 18
#: Text whose entries one bucket holds on average, and shingles that a region may have in one task.
BUCKET_BYTES, REGION_SHINGLES = 32 << 20, 3_000_000
#: Members of a cell that are told apart by signatures; beyond, a cell counts as joined.  Members that one task compares:
#: larger cells are dealt into blocks of about so many, and pairs of blocks into tasks.
CELL_MEMBERS, CELL_BLOCK = 4000, 500
#: Members of a region that become pivots of a split, and parts that a region's rows are salted into.
PIVOTS, SALTS = 8, 16
#: Bits (2**WANTED_BITS) of the filter that tells which texts a region may want.
WANTED_BITS = 26
#: Slack of the windows for rounding.
EPSILON = 1e-9

_CHUNK = 4096


class Sets:
    """Distinct shingles of some rows: ``hash`` sorted within each row,
    ``first`` with the n + 1 offsets of the rows."""

    def __init__(self, hasher: wordhash.Hasher, buf: np.ndarray, offs: np.ndarray, size: int):
        w = hasher.words(buf, offs, wordhash.WHITE_SEPARATED, True)
        rows = w.rows()
        full = np.flatnonzero(np.arange(len(rows)) + size <= w.row_ends())
        hashes, at = [wordhash.gram_at(w.hash, full, size)], [rows[full]]
        for n in range(1, size):
            short = np.flatnonzero(w.counts == n)
            hashes.append(wordhash.gram_at(w.hash, w.first[short], n))
            at.append(short)
        h, row = np.concatenate(hashes), np.concatenate(at)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        self.hash, self.row = h[new], row[new]
        self.first = np.searchsorted(self.row, np.arange(len(offs)))
        self.sizes = np.diff(self.first)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each row's set."""
        return tuple(_row_sums(wordhash.mix(self.hash, seed), self.first).view(np.int64) for seed in (31, 32))


    def signatures(self) -> list[bytes]:
        """For each row the parity of its shingles by their low bits, packed."""
        bits = np.array([_signature_bits(n) for n in self.sizes.tolist()], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(bits)])
        place = (self.hash & (bits[self.row] - 1).astype(np.uint64)).astype(np.int64) + first[self.row]
        odd = np.bincount(place, minlength=int(first[-1])).astype(np.uint8) & 1
        packed = np.packbits(odd, bitorder="little")
        return [packed[a:b].tobytes() for a, b in zip((first // 8).tolist(), (first[1:] // 8).tolist(), strict=False)]


def _signature_bits(n: int) -> int:
    return 1 << max(6, (n - 1).bit_length()) if n else 64


def _row_sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def _sliced(batch, column: int, hasher: wordhash.Hasher, size: int):
    buf, offs = bytes_of(batch.column(column))
    for i, j in row_slices(offs, wordhash.TEXT_SLICE):
        yield i, j, Sets(hasher, buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], size)


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(named(text_col), F.lit(""))
    return df.select(named(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))


def _id_type(docs: DataFrame) -> str:
    return docs.schema["id"].dataType.simpleString()


def _surveyed(docs: DataFrame, size: int) -> DataFrame:
    """Stored: (id, t, n, k1, k2, signature) of each row, and of each task the
    chunks of its count sketch (chunk, counts)."""

    def task(batches):
        hasher, sketch, id_type = wordhash.Hasher(), np.zeros(1 << SKETCH_BITS, dtype=np.int64), None
        for batch in batches:
            id_type = batch.column(0).type
            n, k1, k2 = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            signatures: list[bytes] = []
            for i, j, sets in _sliced(batch, 2, hasher, size):
                n[i:j] = sets.sizes
                signatures += sets.signatures()
                k1[i:j], k2[i:j] = sets.keys()
                sketch += np.bincount((sets.hash >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
            none = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(k1), pa.array(k2),
                                              pa.array(signatures, pa.binary()), *none], names)
        chunks = sketch.reshape(-1, _CHUNK)
        used = np.flatnonzero(chunks.any(axis=1))
        if not len(used):
            return
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(used), id_type), *(pa.nulls(len(used), pa.int64()) for _ in range(4)), pa.nulls(len(used), pa.binary()), pa.array(used.astype(np.int32)),
             pa.array([chunks[c].tobytes() for c in used], pa.binary())], names)

    names = ["id", "t", "n", "k1", "k2", "signature", "chunk", "counts"]
    return stored(docs.mapInArrow(released(task), f"id {_id_type(docs)}, t long, n long, k1 long, k2 long, signature binary, "
                                                  "chunk int, counts binary"), "sets")


def _rarity(surveyed: DataFrame) -> np.ndarray:
    """The rank (0: rare) of each of the sketch's counters: how far, in powers
    of two, it is beyond what chance gives."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(counts, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()),
                                          pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])

    parts = (1 << SKETCH_BITS) // _CHUNK
    rows = (surveyed.where("chunk is not null").select("chunk", "counts").repartition(parts, "chunk")
            .mapInArrow(released(add), "chunk int, counts binary").collect())  # one row a chunk: 2**SKETCH_BITS counters in all
    sketch = np.zeros((parts, _CHUNK), dtype=np.int64)
    for r in rows:
        sketch[r["chunk"]] = np.frombuffer(r["counts"], dtype=np.int64)
    counts = sketch.reshape(-1)
    usual = np.median(counts)
    beyond = counts - usual - 6 * math.sqrt(usual) - 8
    return np.where(beyond > 0, 1 + np.log2(np.maximum(1, beyond)), 0).astype(np.uint8)


def _cells(docs: DataFrame, rarity: np.ndarray, size: int, buckets: int, share: tuple[int, int]) -> DataFrame:
    """Distinct rows (cell, node) of the cells with several classes; cells with
    the same members count once."""
    ranks = bounded_broadcast(docs.sparkSession, rarity, rarity.nbytes)
    num, den = share

    def deal(batches):
        hasher = wordhash.Hasher()
        for batch in batches:
            keys, sizes, entries = [], [], []
            for i, _, sets in _sliced(batch, 0, hasher, size):
                rank = ranks.value[(sets.hash >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.lexsort((sets.hash, rank, sets.row))
                row = sets.row[order]
                within = np.arange(len(row)) - sets.first[row]
                n = sets.sizes[row]
                cells = order[within < n - -(-num * n // den) + 1]
                entries.append((sets.hash[cells], sets.row[cells] + i))
                keys.append(sets.keys()[0])
                sizes.append(sets.sizes)
            if not keys:
                continue
            key, n = np.concatenate(keys), np.concatenate(sizes).astype("<u4")
            h, row = (np.concatenate(x) for x in zip(*entries, strict=True))
            _, first, one = np.unique(key, return_index=True, return_inverse=True)
            some = first[one][row] == row  # of equal sets in a batch one sends its cells
            h, row = h[some], row[some]
            bucket = ((h & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((row, bucket))
            h, row = h[order], row[order]
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = []
            for b in np.flatnonzero(bounds[1:] > bounds[:-1]):
                part = slice(bounds[b], bounds[b + 1])
                used, which = np.unique(row[part], return_inverse=True)
                which = which.astype("<u2" if len(used) <= 1 << 16 else "<u4")
                out.append((int(b), key[used].tobytes(), n[used].tobytes(), which.tobytes(),
                            (h[part] >> np.uint64(24)).astype("<u4").tobytes(), (h[part] >> np.uint64(56)).astype("u1").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                                                 names)

    names, types = ["bucket", "keys", "sizes", "which", "low", "high"], [pa.int32(), *[pa.binary()] * 5]

    def meet(batches):
        held, now = [], None

        def out():
            which = [np.frombuffer(r["which"], f"<u{len(r['which']) // len(r['high'])}") for r in held]
            node = np.concatenate([np.frombuffer(r["keys"], np.int64)[w] for r, w in zip(held, which, strict=True)])
            n = np.concatenate([np.frombuffer(r["sizes"], "<u4")[w] for r, w in zip(held, which, strict=True)]).astype(np.int64)
            h = np.concatenate([np.frombuffer(r["low"], "<u4") for r in held]).astype(np.uint64)
            h |= np.concatenate([np.frombuffer(r["high"], "u1") for r in held]).astype(np.uint64) << np.uint64(32)
            order = np.lexsort((node, n, h))
            h, n, node = h[order], n[order], node[order]
            one = np.ones(len(h), dtype=bool)  # equal sets of several batches count once
            one[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
            h, n, node = h[one], n[one], node[one]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (den * n[:-1] < num * n[1:])
            start = np.flatnonzero(new)
            length = np.diff(np.append(start, len(h)))
            cell = np.add.reduceat(wordhash.mix(node.view(np.uint64), 40), start) if len(start) else h
            start, length, cell = start[length > 1], length[length > 1], cell[length > 1]
            cell, at = np.unique(cell, return_index=True)
            start, length = start[at], length[at]
            members = np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(cell, length).view(np.int64)), pa.array(node[members])],
                                              ["cell", "node"])

        for batch in batches:
            for r in batch.to_pylist():
                if held and r["bucket"] != now:
                    yield out()
                    held = []
                now = r["bucket"]
                held.append(r)
        if held:
            yield out()

    return (docs.select("text").mapInArrow(released(deal), "bucket int, keys binary, sizes binary, which binary, low binary, high binary")
            .repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(released(meet), "cell long, node long").distinct())


def _near(signatures: list[bytes], sizes: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """For each member of a cell the least member that a chain of pairs, each
    within the bound that its signatures give, joins it to."""
    num, den = share
    of, done = np.arange(len(sizes)), np.zeros(len(sizes), dtype=bool)
    words = np.array([len(x) // 8 for x in signatures])
    folded: dict[int, np.ndarray] = {}

    def fold(width: int) -> np.ndarray:
        if width not in folded:
            folded[width] = np.zeros((len(sizes), width), dtype=np.uint64)
            for i in np.flatnonzero(words >= width):
                folded[width][i] = np.bitwise_xor.reduce(np.frombuffer(signatures[i], np.uint64).reshape(-1, width), axis=0)
        return folded[width]

    for x in range(len(sizes)):
        done[x] = True
        n = sizes[x]
        other = np.flatnonzero(~done & (of != of[x]) & (den * np.minimum(sizes, n) >= num * np.maximum(sizes, n)))
        if not len(other):
            continue
        table = fold(int(min(words[x], words[other].min())))
        apart = np.bitwise_count(table[other] ^ table[x]).sum(axis=1, dtype=np.int64)
        joined = other[(num + den) * apart <= (den - num) * (sizes[other] + n)]
        if len(joined):
            classes = np.unique(of[np.append(joined, x)])
            of[np.isin(of, classes)] = classes[0]
    return of


def _joined_cells(cells: DataFrame, classes: DataFrame, share: tuple[int, int], cell_members: int, cell_block: int = CELL_BLOCK) -> DataFrame:
    """Edges (a, b) between classes that a cell joins.  A cell of more than
    ``cell_block`` members is compared by pairs of blocks of it (a member goes
    to as many as it has blocks): every two members meet in one of them, and
    chains over several join in the components."""
    sizes = stored(cells.groupBy("cell").agg(F.count("*").alias("members"), F.min("node").alias("first")), "cells")
    large = sizes.where(F.col("members") > cell_members)
    stars = cells.join(large, "cell").select(F.col("node").alias("a"), F.col("first").alias("b"))
    small = cells.join(sizes.where(F.col("members") <= cell_members).select("cell", "members"), "cell")
    blocks = F.ceil(F.col("members") / cell_block).cast("int")
    small = (small.withColumn("mine", F.pmod(F.xxhash64("node"), blocks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select(F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "node"))
    rows = small.join(classes.select(F.col("k1").alias("node"), "n", "signature"), "node")

    def task(batches):
        held, now = [], None

        def out():
            held.sort(key=lambda r: r[1])  # links then go to the least node, as components wants them
            of = _near([r[3] for r in held], np.array([r[2] for r in held]), share)
            links = [(held[i][1], held[c][1]) for i, c in enumerate(of.tolist()) if c != i]
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()),
                                               pa.array([b for _, b in links], pa.int64())], ["a", "b"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and r[0] != now:
                    yield out()
                    held = []
                now = r[0]
                held.append(r)
        if held:
            yield out()

    parts = partitions_for(cells, 0, 1)
    near = (rows.select("cell", "node", "n", "signature").repartition(parts, "cell").sortWithinPartitions("cell")
            .mapInArrow(released(task), "a long, b long"))
    return near.unionByName(stars).distinct()


_MEMBER = "region long, k1 long, k2 long, n long, shingles binary"


def _wanted_bits(wanted: DataFrame) -> np.ndarray:
    """A bitmap of the wanted texts' hashes, 2**WANTED_BITS bits at any size."""
    bit = F.pmod(F.col("t"), F.lit(1 << WANTED_BITS)) + 1
    parts = (wanted.groupBy(F.bitmap_bucket_number(bit).alias("part"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect())  # 4 KB each
    out = np.zeros(1 << WANTED_BITS - 3, dtype=np.uint8)
    for r in parts:
        out[4096 * (r["part"] - 1):4096 * r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def _maybe(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents that may be wanted: others are left out before a shuffle."""
    bits = _wanted_bits(wanted)
    shared = bounded_broadcast(docs.sparkSession, bits, bits.nbytes)

    def task(batches):
        for batch in batches:
            at = batch.column(1).to_numpy() % (1 << WANTED_BITS)
            yield batch.filter(pa.array(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0))

    return docs.select("id", "t", "text").mapInArrow(released(task), f"id {_id_type(docs)}, t long, text string")


def _members(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Classes (id, t, k1, k2, region) with their sets, taken from one document of each."""
    d, w = _maybe(docs, wanted).alias("d"), wanted.alias("w")
    rows = (d.join(w, F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.t") == F.col("w.t")))
            .select("d.text", "w.region", "w.k1", "w.k2"))

    def task(batches):
        hasher = wordhash.Hasher()
        for batch in batches:
            want = [c.to_numpy() for c in batch.columns[2:]]
            for i, j, sets in _sliced(batch, 0, hasher, size):
                k1, k2 = sets.keys()
                same = np.flatnonzero((k1 == want[0][i:j]) & (k2 == want[1][i:j]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(i, j - i).take(pa.array(same)), pa.array(k1[same]), pa.array(k2[same]),
                     pa.array(sets.sizes[same].astype(np.int64)),
                     pa.array([sets.hash[sets.first[r]:sets.first[r + 1]].tobytes() for r in same], pa.binary())],
                    ["region", "k1", "k2", "n", "shingles"])

    return rows.mapInArrow(released(task), _MEMBER)


class Region:
    """Members of one region in a task, with inverted lists of their shingles."""

    def __init__(self, sets: list[np.ndarray], share: tuple[int, int]):
        self.num, self.den = share
        self.sizes = np.array([len(s) for s in sets])
        h, member = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(h, kind="stable")
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[order][1:] != h[order][:-1]
        self.start = np.flatnonzero(new)
        self.length = np.diff(np.append(self.start, len(h)))
        self.lists = member[order]
        number = np.empty(len(h), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        shared = self.length[number] > 1
        self.numbers = np.split(number[shared], np.cumsum(np.bincount(member[shared], minlength=len(sets)))[:-1])

    def distances(self, x: int, here: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of ``x`` to the members ``here`` and whether they link to
        it; ``place`` has their places in ``here``, and -1 for other members."""
        of = self.numbers[x]
        length = self.length[of]
        at = np.repeat(self.start[of] - np.cumsum(length) + length, length) + np.arange(length.sum())
        found = place[self.lists[at]]
        both = np.bincount(found[found >= 0], minlength=len(here))
        both[place[x]] = self.sizes[x]
        either = self.sizes[here] + self.sizes[x] - both
        return 1 - both / either, self.den * both >= self.num * either

    def classes(self, pivots: int = PIVOTS) -> np.ndarray:
        """For each member the least member of its class."""
        return self.split(pivots)[0]

    def split(self, pivots: int = PIVOTS) -> tuple[np.ndarray, int]:
        """The classes, and how many Voronoi regions were made on the way.

        A Voronoi region is its home members, each at home in one region of a
        level, and its boundary members; pairs of a home member and any member
        are compared in it.  Pivots and members without an open partner are
        done and don't go on, so every level shrinks."""
        num, den = self.num, self.den
        r, of = 1 - num / den, np.arange(len(self.sizes))
        place, made = np.full(len(of), -1), 0
        waiting = [(of.copy(), of[:0])]
        while waiting:
            home, edge = waiting.pop()
            here = np.concatenate([home, edge])
            if (of[here] == of[home[0]]).all():
                continue
            place[here] = np.arange(len(here))
            sizes, rest, away = self.sizes[here], np.ones(len(here), dtype=bool), []
            for x in home.tolist():
                if len(away) == pivots:
                    break
                n, at = self.sizes[x], place[x]
                rest[at] = False
                partners = rest & (of[here] != of[x]) & (den * np.minimum(sizes, n) >= num * np.maximum(sizes, n))
                for d in away:
                    partners &= np.abs(d - d[at]) <= r + EPSILON
                if not partners.any():
                    continue
                d, linked = self.distances(x, here, place)
                away.append(d)
                joined = np.unique(of[here[linked]])
                if len(joined) > 1:
                    of[np.isin(of, joined)] = joined[0]
            place[here] = -1
            at_home = rest.copy()
            at_home[len(home):] = False
            if not at_home.any():
                continue
            table = np.array(away)
            nearest, own = table.min(axis=0), table.argmin(axis=0)
            for p in range(len(away)):
                mine = at_home & (own == p)
                if not mine.any():
                    continue
                inner, low, high = table[:, mine], sizes[mine].min(), sizes[mine].max()
                near = rest & ~mine & (table[p] - nearest <= 2 * r + EPSILON) & (den * sizes >= num * low) & (den * high >= num * sizes)
                near &= ((table >= inner.min(axis=1)[:, None] - r - EPSILON)
                         & (table <= inner.max(axis=1)[:, None] + r + EPSILON)).all(axis=0)
                waiting.append((here[mine], here[near]))
                made += 1
        return of, made


def _node(k1: int, k2: int) -> bytes:
    return k1.to_bytes(8, "big", signed=True) + k2.to_bytes(8, "big", signed=True)


def _joined(members: DataFrame, share: tuple[int, int], pivots: int) -> DataFrame:
    """Links (a, b) that give the classes within each region."""

    def task(batches):
        held, seen, now = [], set(), None

        def out():
            if len(held) < 2:
                return []
            held.sort()  # links then go to the least node, as components wants them
            of = Region([np.frombuffer(s, np.uint64) for _, s in held], share).classes(pivots)
            return [(held[i][0], held[c][0]) for i, c in enumerate(of.tolist()) if i != c]

        def rows(links):
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.binary()),
                                               pa.array([b for _, b in links], pa.binary())], ["a", "b"])

        links = []
        for batch in batches:
            for region, k1, k2, _, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if region != now:
                    links += out()
                    held, seen, now = [], set(), region
                if (k1, k2) not in seen:
                    seen.add((k1, k2))
                    held.append((_node(k1, k2), shingles))
            yield rows(links)
            links = []
        yield rows(out())

    parts = partitions_for(members, 0, 1)
    return members.select(*(c.split()[0] for c in _MEMBER.split(", "))).repartition(parts, "region").sortWithinPartitions("region").mapInArrow(released(task), "a binary, b binary")


def _split(members: DataFrame, share: tuple[int, int], pivots: int, level: int) -> tuple[DataFrame, DataFrame]:
    """One round: links to pivots, and the members of the Voronoi regions with
    the shingles that their region had before (``before``)."""
    num, den = share
    r = 1 - num / den
    ordered = Window.partitionBy("region").orderBy(F.xxhash64("k1", "k2", F.lit(level)), "k1", "k2")
    chosen = (members.select("region", "k1", "k2").distinct().withColumn("number", F.row_number().over(ordered))
              .where(F.col("number") <= pivots))
    centres = (chosen.join(members, ["region", "k1", "k2"]).dropDuplicates(["region", "k1", "k2"]).groupBy("region")
               .agg(F.sort_array(F.collect_list(F.struct("number", "k1", "k2", "shingles"))).alias("pivots")))
    salted = centres.select("region", "pivots", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = (members.withColumn("salt", F.pmod(F.xxhash64("k2"), F.lit(SALTS)).cast("int")).join(salted, ["region", "salt"])
            .select("region", "k1", "k2", "n", "before", "shingles", "pivots"))

    def measure(batches):
        for batch in batches:
            near, distance = [], []
            for shingles, centres in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                mine = np.frombuffer(shingles, np.uint64)
                linked, away = [], []
                for c in centres:
                    other = np.frombuffer(c["shingles"], np.uint64)
                    place = np.minimum(np.searchsorted(other, mine), len(other) - 1)
                    both = int(np.count_nonzero(other[place] == mine))
                    either = len(mine) + len(other) - both
                    away.append(1 - both / either)
                    linked.append(_node(c["k1"], c["k2"]) if den * both >= num * either else None)
                near.append(linked)
                distance.append(away)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(near, pa.list_(pa.binary())),
                                              pa.array(distance, pa.list_(pa.float64()))],
                                             ["region", "k1", "k2", "n", "before", "shingles", "linked", "distance"])

    measured = stored(rows.mapInArrow(released(measure), "region long, k1 long, k2 long, n long, before long, shingles binary, "
                                               "linked array<binary>, distance array<double>"), "measured")
    me = F.unhex(F.concat(F.lpad(F.hex("k1"), 16, "0"), F.lpad(F.hex("k2"), 16, "0")))
    links = (measured.select(me.alias("a"), F.explode("linked").alias("b")).where("b is not null and a != b"))
    placed = (measured.withColumn("nearest", F.array_min("distance"))
              .select("*", F.posexplode("distance").alias("cell", "away"))
              .where(F.col("away") - F.col("nearest") <= 2 * r + EPSILON)
              .withColumn("inner", F.get("linked", F.col("cell")).isNotNull()))
    outer = [F.min(F.when(~F.col("inner"), F.get("distance", F.lit(p)))).alias(f"lo{p}") for p in range(pivots)] + \
            [F.max(F.when(~F.col("inner"), F.get("distance", F.lit(p)))).alias(f"hi{p}") for p in range(pivots)]
    bounds = placed.groupBy("region", "cell").agg(*outer, F.count(F.when(~F.col("inner"), 1)).alias("outside"))
    bounds = bounds.where("outside > 0").drop("outside")
    within = F.lit(True)
    for p in range(pivots):
        d = F.get("distance", F.lit(p))
        within &= d.isNull() | ((d >= F.col(f"lo{p}") - r - EPSILON) & (d <= F.col(f"hi{p}") + r + EPSILON))
    kept = (placed.join(bounds, ["region", "cell"]).where(~F.col("inner") | within)
            .select(F.xxhash64("region", "cell", F.lit(level)).alias("region"), "k1", "k2", "n", "before", "shingles"))
    return links, kept


def _blocks(members: DataFrame, limit: int) -> DataFrame:
    """Regions (with their ``total``) that don't shrink, dealt into blocks: a region for each pair of
    blocks, so that all pairs of members meet."""
    count = F.ceil(2 * F.col("total") / limit).cast("int")
    rows = (members.withColumn("blocks", F.greatest(F.lit(2), count))
            .withColumn("mine", F.pmod(F.xxhash64("k1", "k2"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return rows.select(F.xxhash64("region", F.least("mine", "other"), F.greatest("mine", "other"), F.lit("block")).alias("region"),
                       "k1", "k2", "n", "shingles")


def links_of(docs: DataFrame, wanted: DataFrame, size: int = SHINGLE, share: tuple[int, int] = (NUMERATOR, DENOMINATOR),
             region_shingles: int = REGION_SHINGLES, pivots: int = PIVOTS) -> DataFrame:
    """Links whose components are the classes of linked members; ``wanted``
    has id, t, k1, k2, n and region."""
    totals = wanted.groupBy("region").agg(F.sum("n").alias("total"))
    wanted = stored(wanted.join(totals, "region"), "wanted")
    found = [_joined(_members(docs, wanted.where(F.col("total") <= region_shingles), size), share, pivots)]
    large = wanted.where(F.col("total") > region_shingles)
    if large.isEmpty():
        return found[0]
    before = large.select("region", F.col("total").alias("before")).distinct()
    rest, level = stored(_members(docs, large, size).join(before, "region"), "members"), 0
    while True:
        links, members = _split(rest, share, pivots, level)
        members = stored(members, "members")
        totals = members.groupBy("region").agg(F.sum("n").alias("total"))
        members = members.join(totals, "region")
        fits = F.col("total") <= region_shingles
        stuck = ~fits & (F.col("total") > 0.8 * F.col("before"))
        found += [links, _joined(members.where(fits), share, pivots),
                  _joined(_blocks(members.where(stuck), region_shingles), share, pivots)]
        rest = stored(members.where(~fits & ~stuck).withColumn("before", F.col("total")).drop("total"), "regions")
        if rest.isEmpty():
            break
        level += 1
    out = found[0]
    for links in found[1:]:
        out = out.unionByName(links)
    return out


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
         share: tuple[int, int] = (NUMERATOR, DENOMINATOR), region_shingles: int = REGION_SHINGLES,
         pivots: int = PIVOTS, cell_members: int = CELL_MEMBERS, cell_block: int = CELL_BLOCK) -> DataFrame:
    """One row per row of ``df``: id, t (a hash of the text), n_shingles,
    component_id (the least id of its class) and representative (whether this
    is the class's first document by id, null last, and text hash)."""
    docs = _documents(df, id_col, text_col)
    surveyed = _surveyed(docs, shingle)
    rows = surveyed.where("chunk is null").select("id", "t", "n", "k1", "k2", "signature")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "t"))
    classes = stored(rows.where("n > 0").groupBy("k1", "k2").agg(first.alias("f"), F.first("n").alias("n"),
                                                                 F.first("signature").alias("signature"))
                     .select("k1", "k2", "n", "signature", "f.id", "f.t"), "classes")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = stored(_cells(docs, _rarity(surveyed), shingle, partitions_for(df, size, BUCKET_BYTES), share), "cells")
    regions = components(_joined_cells(cells, classes, share, cell_members, cell_block), "regions")
    wanted = (classes.join(regions, F.col("k1") == F.col("node"))
              .select("id", "t", "k1", "k2", "n", F.col("root").alias("region")))
    links = links_of(docs, wanted, shingle, share, region_shingles, pivots)
    roots = components(links, "links")
    me = F.unhex(F.concat(F.lpad(F.hex("k1"), 16, "0"), F.lpad(F.hex("k2"), 16, "0")))
    placed = (classes.withColumn("node", me).join(roots, "node", "left")
              .select("k1", "k2", F.coalesce("root", "node").alias("root"),
                      F.struct(F.col("id").isNull().alias("last"), "id", "t").alias("f")))
    least = placed.groupBy("root").agg(F.min("f").alias("least"))
    labelled = stored(placed.join(least, "root").select("k1", "k2", "least"), "labelled")
    own = F.struct(F.col("id").isNull().alias("last"), "id", "t")
    return (rows.drop("signature").join(labelled, ["k1", "k2"], "left")
            .withColumn("least", F.when(F.col("n") > 0, F.col("least")).otherwise(own))
            .select(F.col("id").alias(id_col), "t", F.col("n").alias("n_shingles"), F.col("least.id").alias("component_id"),
                    (F.col("least") == own).alias("representative")))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df``, with its columns, that represent their class."""
    kept = (join(df, id_col, text_col, **options).where("representative")
            .select(F.col(id_col).alias("keep_id"), F.col("t").alias("keep_t")).distinct())
    t = free_name(df, "t")
    return (df.withColumn(t, F.xxhash64(F.coalesce(named(text_col), F.lit("")))).alias("d")
            .join(kept.alias("k"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("k.keep_id"))
                  & (F.col(f"d.`{t}`") == F.col("k.keep_t")), "left_semi")
            .select(*(named(c) for c in df.columns)))

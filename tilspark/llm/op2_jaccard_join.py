"""N-gram Jaccard join by set-relation skipping.

A document's set: the hashes of its distinct ``n``-word shingles.

1. Equal sets become one (by a 128-bit digest).
2. *Order.*  A fixed-size table of shingle counts over all documents puts shingles that many documents
   share last; ties go by hash.  Any order is right; this one keeps common passages out of prefixes.
3. *Lists.*  Linked sets share a shingle in their prefixes.  Prefix entries (shingle, set, size,
   position) are dealt out by shingle and sorted by size.  For each entry, the sizes it can link to
   at its position make a range, and the best position bound in that range tells at once whether the
   whole block can be skipped; entries without any possible partner leave.
4. *Groups.*  In each list, the set that shares the most with others is the pivot, and every
   candidate pair of the list lies in its group.  Before any set is sent, a group is held together
   by parity bitmaps: bits in which two differ are a lower bound of the shingles in which
   the sets differ, so a set that is too far from all others of its group leaves it.  A group of more
   than ``tile_tokens`` shingles is cut into blocks; each set meets its block and the group's hub, and
   only sets that this doesn't join to the hub meet the other blocks.  No group grows past a task.
5. *Answers.*  A group keeps lists from shingle to rows.  The overlaps of the pivot with all rows are
   counted from its lists; those of a set similar to it are derived from the pivot's by the lists of
   the shingles in which the two differ.  Links that join two components are kept.
6. Components of all links by ``components``; nothing is gathered on the driver.

Sets of null or empty texts are empty and linked with nothing.  Rows of one id are one document each
in the result, and share the component if any of them has links; null ids come back null with null
components, and take no part.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .components import components
from .repeats import NO_ID, id_filter, in_filter, keyed, only
from .scratch import free_name, table


@dataclass(frozen=True)
class Join:
    n: int = 5  # words of a shingle
    percent: int = 80  # links: 100 * intersection >= percent * union
    slots: int = 1 << 20  # of the table of counts: 4 MB, whatever the corpus
    tile_tokens: int = 1 << 19  # of a task: about 30 MB with its lists


def sets_of(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, row by row, and their offsets."""
    buf = A.LOWER[buf]
    s, e, woff = A.words(buf, off)
    item = A.span_hashes(buf, s, e)
    count = np.diff(woff)
    full = A.window_hashes(item, n, n)
    begin = np.arange(len(full))
    row = A.rows_of(woff)
    ok = begin + n <= woff[1:][row[: len(full)]]
    h, r = full[ok], row[: len(full)][ok]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        some = np.concatenate([[0], np.cumsum(count[short])])
        h = np.concatenate([h, A.row_hashes(A.gather(item, woff[short], count[short]), some)])
        r = np.concatenate([r, short])
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[first], r[first]
    return h, np.searchsorted(r, np.arange(len(off)))


def shingle_sets(keys: DataFrame, j: Join) -> DataFrame:
    """``id, th, size, d1, d2, bits``: size, digest and bitmap of each document's set."""

    def run(batches):
        for batch in batches:
            for i, k, buf, off in A.sliced(A.column(batch, "text")):
                h, hoff = sets_of(buf, off, j.n)
                sums = []
                for x in (A.mix(h), A.mix(h + A.U(0x5851F42D4C957F2D))):
                    c = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(x, out=c[1:])
                    sums.append((c[hoff[1:]] - c[hoff[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_pydict({"id": A.column(batch, "id").slice(i, k - i), "th": A.column(batch, "th").slice(i, k - i), "size": np.diff(hoff), "d1": sums[0], "d2": sums[1], "bits": pa.array(bitmaps(h, hoff), pa.binary())})

    return keys.mapInArrow(A.trimmed(run), "id bigint, th int, size bigint, d1 bigint, d2 bigint, bits binary")


def shingle_counts(keys: DataFrame, j: Join) -> np.ndarray:
    """How many shingles of all documents fall in each slot, summed in Spark: parts of 1024 slots."""

    def run(batches):
        total = np.zeros(j.slots, np.int64)
        for batch in batches:
            for _, _, buf, off in A.sliced(A.column(batch, "text")):
                h, _ = sets_of(buf, off, j.n)
                total += np.bincount((h & A.U(j.slots - 1)).astype(np.int64), minlength=j.slots)
        parts = total.reshape(-1, 1024)
        for k in range(0, len(parts), 128):
            some = parts[k : k + 128]
            # as wide as the task's counts need
            wide = "<u2" if total.max() < 1 << 16 else "<u8"
            yield pa.RecordBatch.from_pydict({"part": np.arange(k, k + len(some), dtype=np.int32), "counts": [p.astype(wide).tobytes() for p in some]})

    def add(batches):
        part, total = None, None
        for batch in batches:
            for p, c in zip(A.column(batch, "part").to_pylist(), A.column(batch, "counts").to_pylist()):
                x = np.frombuffer(c, "<u2" if len(c) == 2048 else "<u8").astype(np.uint64)
                if p == part:
                    total = total + x
                    continue
                if part is not None:
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "counts": [_log(total)]})
                part, total = p, x
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "counts": [_log(total)]})

    def _log(x):  # in eighths of a power of two: a byte is enough
        return np.minimum(255, 8 * np.log2(x.astype(float) + 1)).astype(np.uint8).tobytes()

    schema = "part int, counts binary"
    rows = keys.mapInArrow(A.trimmed(run), schema).repartition("part").sortWithinPartitions("part").mapInArrow(A.trimmed(add), schema).collect()
    out = np.zeros(j.slots, np.uint8)
    for r in rows:
        out[r["part"] * 1024 : (r["part"] + 1) * 1024] = np.frombuffer(r["counts"], np.uint8)
    # common: clearly above the mean load
    mean = 8 * np.log2(np.mean(np.exp2(out / 8.0) - 1) + 1)
    return np.where(out > mean + 8, out, 0).astype(np.uint8)


def prefixes(keys: DataFrame, counts, j: Join, unless=None) -> DataFrame:
    """``token, id, size, pos``: the entries of each set's prefix.  ``unless``: a filter of ids that are
    left out, here rather than before, as that would be a second Python worker in the task."""

    def run(batches):
        level = counts.value
        for batch in batches:
            if unless is not None:
                batch = batch.filter(pa.array(~in_filter(unless.value, A.column(batch, "id").to_numpy())))
            ids = A.column(batch, "id").to_numpy()
            for i, _, buf, off in A.sliced(A.column(batch, "text")):
                h, hoff = sets_of(buf, off, j.n)
                size = np.diff(hoff)
                row = A.rows_of(hoff)
                # by row, then rank of the slot, then a scrambled hash
                order = np.lexsort((A.mix(h), level[(h & A.U(j.slots - 1)).astype(np.int64)], row))
                pos = np.arange(len(h)) - hoff[row]
                need = -(-j.percent * size // 100)  # the least overlap with any set
                keep = pos < (size - need + 1)[row]
                yield pa.RecordBatch.from_pydict({"token": h[order][keep].view(np.int64), "id": ids[i + row[keep]], "size": size[row[keep]].astype(np.int32), "pos": pos[keep].astype(np.int32)})

    return keys.mapInArrow(A.trimmed(run), "token bigint, id bigint, size int, pos int")


LEAST_BITS, MOST_BITS = 512, 1 << 17  # of a set's bitmap


def bitmaps(h: np.ndarray, hoff: np.ndarray) -> list[bytes]:
    """For each set: in each bit, whether an odd number of its shingles falls there.  A bitmap has two
    to four bits for each shingle, a thirtieth of the set; folding its halves gives a shorter one."""
    out: list[bytes] = []
    slot = (h >> A.U(20)).astype(np.int64)
    for k in range(len(hoff) - 1):
        a, b = hoff[k], hoff[k + 1]
        n = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * int(b - a) - 1).bit_length() if b > a else 0))
        odd = np.bincount(slot[a:b] & (n - 1), minlength=n) & 1
        out.append(np.packbits(odd.astype(bool)).tobytes())
    return out


#: a group of more sets goes on without a look at its bitmaps, which would be gathered in one task
BITMAP_ROWS = 1 << 12


def _fold(bits: bytes, length: int) -> np.ndarray:
    x = np.frombuffer(bits, np.uint8)
    while len(x) > length:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def may_link(size: np.ndarray, bits: list[bytes], percent: int) -> np.ndarray:
    """Which sets of a group may link to another one, by sizes and bitmaps.

    Sets are compared at the length of the shorter bitmap, so by classes of lengths.
    """
    m = len(size)
    if m > BITMAP_ROWS:
        return np.ones(m, bool)
    out = np.zeros(m, bool)
    length = np.array([len(b) for b in bits])
    for n in np.unique(length).tolist():
        small = np.flatnonzero(length == n)
        # of twice the length or more: what may link with these sizes at all
        far_size = int(size[small].max()) * 100 // percent
        every = np.concatenate([small, np.flatnonzero((length > n) & (size <= far_size))])
        words = np.stack([_fold(bits[i], n) for i in every]).view(np.uint64)
        step = max(1, (1 << 19) // len(every))
        for a in range(0, len(small), step):
            rows = small[a : a + step]
            both = size[rows, None] + size[None, every]
            # of intersection * (100 + percent) >= percent * both, the least intersection
            most = both - 2 * (-(-percent * both // (100 + percent)))
            far = np.zeros(both.shape, np.int64)
            for w in range(words.shape[1]):
                far += np.bitwise_count(words[a : a + len(rows), None, w] ^ words[None, :, w])
            ok = (far <= most) & (rows[:, None] != every[None, :])
            out[rows] |= ok.any(axis=1)
            out[every] |= ok.any(axis=0)
    return out


LIST_ROWS = 1 << 21  # entries of lists that a task looks at together


def _alive(token: np.ndarray, size: np.ndarray, pos: np.ndarray, percent: int) -> np.ndarray:
    """Which entries, sorted by token and size, may link to another entry of their list."""
    t = percent / 100
    first = np.ones(len(token), bool)
    first[1:] = token[1:] != token[:-1]
    run = np.cumsum(first) - 1
    wide = np.int64(1) << 32
    key = run * wide + size
    # the overlap is at most 1 + what follows the position, and at least t / (1 + t) of both sizes
    cap = np.floor((1 + t) / t * (size - pos) - size + 1e-6).astype(np.int64)
    low = np.ceil(t * size - 1e-6).astype(np.int64)
    high = np.minimum(np.floor(size / t + 1e-6).astype(np.int64), cap)
    lo = np.searchsorted(key, run * wide + low, "left")
    hi = np.searchsorted(key, run * wide + np.maximum(high, 0), "right")
    me = np.arange(len(token))
    out = np.zeros(len(token), bool)
    bound = np.append(cap, -1)
    for a, b in ((lo, np.minimum(hi, me)), (np.maximum(lo, me + 1), hi)):
        some = np.flatnonzero(b > a)
        if len(some):
            edges = np.stack([a[some], b[some]], axis=1).ravel()
            out[some] |= np.maximum.reduceat(bound, edges)[::2] >= size[some]
    return out


def lists(entries: DataFrame, j: Join) -> DataFrame:
    """The entries that may link, with ``len``, the number of them in their list."""

    def run(batches):
        names = ("token", "id", "size", "pos")
        held: list[dict] = []
        long = None  # the last list of which a part went on without the check: so does the rest

        def out(x):
            keep = _alive(x["token"], x["size"].astype(np.int64), x["pos"].astype(np.int64), j.percent) if len(x["token"]) < 4 * LIST_ROWS else np.ones(len(x["token"]), bool)
            if long is not None:
                keep = keep | (x["token"] == long)
            t = x["token"][keep]
            if len(t):
                _, inverse, n = np.unique(t, return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_pydict({"token": t, "id": x["id"][keep], "len": n[inverse], "size": x["size"][keep]})

        for batch in batches:
            x = {n: A.column(batch, n).to_numpy() for n in names}
            held.append(x)
            if sum(len(h["token"]) for h in held) < LIST_ROWS // 8:
                continue
            x = {n: np.concatenate([h[n] for h in held]) for n in names}
            cut = int(np.searchsorted(x["token"], x["token"][-1], "left"))
            whole = cut == 0 and len(x["token"]) > 4 * LIST_ROWS
            if whole:  # a list longer than a task holds: all of it may link
                cut = len(x["token"])
            if cut:
                yield from out({n: x[n][:cut] for n in names})
            if whole:
                long = x["token"][-1]
            held = [{n: x[n][cut:].copy() for n in names}]
        if held:
            yield from out({n: np.concatenate([h[n] for h in held]) for n in names})

    p = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return entries.repartition(p, "token").sortWithinPartitions("token", "size").mapInArrow(A.trimmed(run), "token bigint, id bigint, len bigint, size int")


class Group:
    """Answers of the sets of one tile."""

    def __init__(self, ids: np.ndarray, tokens: np.ndarray, off: np.ndarray, percent: int):
        self.ids, self.off, self.percent = ids, off, percent
        self.size = np.diff(off)
        _, t, n = np.unique(tokens, return_inverse=True, return_counts=True)
        self.weight = np.add.reduceat(n[t], off[:-1]) if len(ids) else n
        # shingles of one set only can't add to an overlap: no lists for them
        shared = n[t] > 1
        self.tok = t[shared]
        self.toff = np.concatenate([[0], np.cumsum(shared)])[off]
        order = np.argsort(self.tok, kind="stable")
        self.rows = np.repeat(np.arange(len(ids)), np.diff(self.toff))[order]
        self.list_end = np.searchsorted(self.tok[order], np.arange(len(n) + 1))

    def _count(self, t: np.ndarray) -> np.ndarray:
        """Of how many of the shingles' lists each row is a part."""
        a, n = self.list_end[t], self.list_end[t + 1] - self.list_end[t]
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.rows[at], minlength=len(self.ids))

    def links(self, settled: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Links that join the components of the rows, and each row's component.  Settled rows are in one
        component already; answers are made for the others."""
        m = len(self.ids)
        label = np.arange(m)
        label[settled] = np.argmax(settled)
        parts, out = m - max(0, int(settled.sum()) - 1), []
        pivot = int(np.argmax(self.weight / self.size))
        of = lambda k: self.tok[self.toff[k] : self.toff[k + 1]]
        mine = np.sort(of(pivot))
        base = self._count(mine)
        order = np.argsort(-base, kind="stable")
        for k in order[~settled[order]].tolist():
            t = of(k)
            if k == pivot:
                overlap = base
            else:
                new = np.setdiff1d(t, mine, assume_unique=True)
                common = len(t) - len(new)
                if len(new) + len(mine) - common < len(t):  # similar: derive
                    overlap = base - self._count(np.setdiff1d(mine, t, assume_unique=True)) + self._count(new)
                else:
                    overlap = self._count(t)
            hit = np.flatnonzero(100 * overlap >= self.percent * (self.size + self.size[k] - overlap))
            found = np.unique(label[hit])
            if len(found) > 1:
                own = label[k]
                for other in found.tolist():
                    if other != own:
                        out.append((int(self.ids[k]), int(self.ids[hit[np.argmax(label[hit] == other)]])))
                label[np.isin(label, found)] = found[0]
                parts -= len(found) - 1
                if parts == 1:
                    break
        return out, label


def group_links(members: DataFrame, keys: DataFrame, j: Join) -> DataFrame:
    """``a, b, pivot``: links that join the components of each tile, and with null ``b`` the sets of a tile
    that no link joins to its ``hub``.

    ``members``: ``pivot, id, hub, settled, first, step, count``; a set goes to ``count`` tiles of its
    group, from ``first`` on at a distance of ``step``.
    """
    by_doc = members.groupBy("id").agg(F.collect_list(F.struct("pivot", "hub", "settled", "first", "step", "count")).alias("want"))
    joined = only(keys, members.select("id")).join(by_doc, "id").select("id", "text", "want")

    def deal(batches):
        for batch in batches:
            want = A.column(batch, "want")
            woff = np.concatenate([[0], np.cumsum(want.value_lengths().to_numpy())])
            flat = pa.RecordBatch.from_struct_array(want.flatten())
            first, step, count = (A.column(flat, c).to_numpy() for c in ("first", "step", "count"))
            ids = A.column(batch, "id").to_numpy()
            for i, k, buf, off in A.sliced(A.column(batch, "text"), 1 << 19):
                h, hoff = sets_of(buf, off, j.n)
                sets = pa.Array.from_buffers(pa.large_binary(), k - i, [None, pa.py_buffer((hoff * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(h))])
                row = np.repeat(np.arange(k - i), np.diff(woff[i : k + 1]))
                n = count[woff[i] : woff[k]]
                each = np.repeat(np.arange(len(n)), n)
                w = woff[i] + each
                tile = first[w] + step[w] * (np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n))
                row = row[each]
                for a in range(0, len(row), 256):
                    some = slice(a, a + 256)
                    own = flat.take(pa.array(w[some]))
                    yield pa.RecordBatch.from_arrays(
                        [A.column(own, "pivot"), pa.array(tile[some]), pa.array(ids[i + row[some]]), A.column(own, "hub"), A.column(own, "settled"), sets.take(pa.array(row[some])).cast(pa.binary())],
                        ["pivot", "tile", "id", "hub", "settled", "tokens"],
                    )

    def answer(batches):
        key, hub, rows = None, None, []
        out: list[tuple[int, int | None, int]] = []

        def done():
            if not rows or (len(rows) == 1 and hub is None):
                return
            ids = np.array([r[0] for r in rows], np.int64)
            size = np.array([len(r[2]) // 8 for r in rows])
            group = Group(ids, np.frombuffer(b"".join(r[2] for r in rows), np.uint64), np.concatenate([[0], np.cumsum(size)]), j.percent)
            edges, label = group.links(np.array([r[1] for r in rows], bool))
            out.extend((a, b, key[0]) for a, b in edges if a != b)
            if hub is not None:
                near = np.isin(label, label[ids == hub])
                out.extend((i, None, key[0]) for i in ids[~near].tolist())

        def flush():
            cols = [pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))]
            return pa.RecordBatch.from_arrays(cols, ["a", "b", "pivot"])

        for batch in batches:
            for p, t, i, h, s, x in zip(*(A.column(batch, c).to_pylist() for c in ("pivot", "tile", "id", "hub", "settled", "tokens"))):
                if (p, t) != key:
                    done()
                    key, hub, rows = (p, t), h, []
                rows.append((i, s, x))
            if len(out) > 5000:
                yield flush()
                out.clear()
        done()
        yield flush()

    p = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = joined.mapInArrow(A.trimmed(deal), "pivot bigint, tile bigint, id bigint, hub bigint, settled boolean, tokens binary")
    return dealt.repartition(p, "pivot", "tile").sortWithinPartitions("pivot", "tile").mapInArrow(A.trimmed(answer), "a bigint, b bigint, pivot bigint")


def all_links(members: DataFrame, keys: DataFrame, j: Join) -> DataFrame:
    """``a, b``: links that join the components of each group.  ``members``: ``pivot, id, size, blocks,
    block, hub``.

    First every set meets its own block and the group's hub.  Sets that this joins to the hub are one
    component, whatever links there are between them; only the others meet all blocks.  So a group of
    copies of one text sends each set once or twice, however large it is.
    """
    zero, one, no = F.lit(0).cast("bigint"), F.lit(1).cast("bigint"), F.lit(False)
    many = F.col("blocks") > 1
    is_hub = many & (F.col("id") == F.col("hub"))
    start = members.select(
        "pivot", "id", F.when(many, F.col("hub")).alias("hub"), no.alias("settled"),
        F.when(is_hub, zero).otherwise(F.col("block")).cast("bigint").alias("first"), one.alias("step"), F.when(is_hub, F.col("blocks")).otherwise(1).cast("bigint").alias("count"),
    )
    found = table(group_links(start, keys, j), "links")
    links = found.where("b IS NOT NULL").select("a", "b")
    rest = found.where("b IS NULL").select("pivot", F.col("a").alias("id")).distinct()
    if rest.isEmpty():
        return links
    rest = members.join(rest.withColumn("rest", F.lit(True)), ["pivot", "id"], "left").withColumn("rest", F.coalesce("rest", no))
    rows = F.ceil(F.sum(F.when(F.col("rest"), F.col("size"))) / j.tile_tokens).cast("bigint")
    rest = table(rest.join(rest.groupBy("pivot").agg(rows.alias("bands")).where("bands > 0"), "pivot"), "rest")
    columns = lambda settled, first, step, count: ["pivot", "id", F.lit(None).cast("bigint").alias("hub"), settled.alias("settled"), first.cast("bigint").alias("first"), step.cast("bigint").alias("step"), count.cast("bigint").alias("count")]
    band = F.pmod(F.xxhash64("id", F.lit(5)), F.col("bands"))
    here = rest.select(*columns(~F.col("rest"), F.col("block"), F.col("blocks"), F.col("bands")))
    away = rest.where("rest").select(*columns(no, band * F.col("blocks"), one, F.col("blocks")))
    return links.unionByName(group_links(here.unionByName(away), keys, j).where("b IS NOT NULL").select("a", "b"))


def class_prefixes(keys: DataFrame, classes: DataFrame, sets: DataFrame, counts, j: Join) -> DataFrame:
    """``prefixes`` of the documents that stand for their class; only ids that a filter takes for copies
    are shuffled."""
    copies = sets.join(classes, ["size", "d1", "d2"]).where((F.col("n") > 1) & ((sets["id"] != F.col("rep")) | (sets["th"] != F.col("rep_th")))).select(sets["id"])
    bits = keys.sparkSession.sparkContext.broadcast(id_filter(copies))
    maybe = only(keys, bits=bits).join(classes.select(F.col("rep").alias("id"), F.col("rep_th").alias("th")), ["id", "th"], "left_semi")
    return prefixes(keys, counts, j, unless=bits).unionByName(prefixes(maybe, counts, j))


def near_members(members: DataFrame, sets: DataFrame, j: Join) -> DataFrame:
    """``pivot, id, size`` of the members that may link within their group."""

    def run(batches):
        key, held = None, []

        def done():
            if len(held) < 2:
                return None
            ids, size = np.array([x[0] for x in held]), np.array([x[1] for x in held], np.int64)
            keep = may_link(size, [x[2] for x in held], j.percent)
            return (np.full(int(keep.sum()), key), ids[keep], size[keep].astype(np.int32)) if keep.any() else None

        out: list = []
        for batch in batches:
            for p, i, n, b in zip(*(A.column(batch, c).to_pylist() for c in ("pivot", "id", "size", "bits"))):
                if p != key:
                    out.append(done())
                    key, held = p, []
                held.append((i, n, b))
            out = [x for x in out if x]
            if out:
                yield pa.RecordBatch.from_pydict({n: np.concatenate([x[k] for x in out]) for k, n in enumerate(("pivot", "id", "size"))})
            out = []
        if (x := done()) is not None:
            yield pa.RecordBatch.from_pydict(dict(zip(("pivot", "id", "size"), x)))

    p = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # an id with several texts has a bitmap for each: its sets are looked at one by one
    known = sets.select("id", F.col("size").cast("int").alias("size"), "bits")
    count = members.groupBy("pivot").agg(F.count("*").alias("m"))
    large = F.coalesce(F.col("m") > BITMAP_ROWS, F.lit(False))
    members = members.select("pivot", "id").join(count.where(F.col("m") > BITMAP_ROWS), "pivot", "left").join(known, "id")
    rows = members.where(~large).select("pivot", "id", "size", "bits").repartition(p, "pivot").sortWithinPartitions("pivot")
    near = rows.mapInArrow(A.trimmed(run), "pivot bigint, id bigint, size int").unionByName(members.where(large).select("pivot", "id", "size"))
    return near.groupBy("pivot", "id").agg(F.sum("size").alias("size"))


def group_members(alive: DataFrame, sets: DataFrame, j: Join) -> DataFrame:
    """``pivot, id, size, blocks, block, hub``: each list's sets under the list's pivot, once for each pivot."""
    score = alive.groupBy("id").agg((F.sum("len") / F.max("size")).alias("score"))
    pivots = alive.select("token", "id").join(score, "id").groupBy("token").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("pivot"))
    members = alive.select("token", "id", "size").join(pivots, "token").groupBy("pivot", "id").agg(F.max("size").alias("size"))
    members = table(near_members(members, sets, j), "members")
    hub = F.when(F.max(F.col("id") == F.col("pivot")), F.col("pivot")).otherwise(F.min("id"))
    total = members.groupBy("pivot").agg(F.ceil(F.sum("size") / j.tile_tokens).cast("int").alias("blocks"), hub.alias("hub"))
    return members.join(total, "pivot").withColumn("block", F.pmod(F.xxhash64("id", "pivot"), F.col("blocks")).cast("int"))


def jaccard_components(docs: DataFrame, j: Join = Join(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, th, size, component`` of each row of ``docs``: ``id`` is NO_ID and ``component`` null for null ids."""
    keys = keyed(docs, id_col, text_col)
    sets = table(shingle_sets(keys, j), "sets")
    real = sets.where((F.col("size") > 0) & (F.col("id") != NO_ID))
    classes = real.groupBy("size", "d1", "d2").agg(F.min(F.struct("id", "th")).alias("rep"), F.count("*").alias("n"))
    classes = table(classes.select("size", "d1", "d2", F.col("rep.id").alias("rep"), F.col("rep.th").alias("rep_th"), "n"), "classes")
    counts = keys.sparkSession.sparkContext.broadcast(shingle_counts(keys, j))
    entries = class_prefixes(keys.where(F.col("id") != NO_ID), classes, real, counts, j)
    alive = table(lists(entries, j), "lists")
    links = all_links(table(group_members(alive, real, j), "groups"), keys, j)
    rep = sets.join(classes.where("n > 1").select("size", "d1", "d2", "rep"), ["size", "d1", "d2"], "left").select("id", "th", "size", F.coalesce("rep", "id").alias("rep"))
    # an id with several texts joins their classes
    several = rep.where(F.col("id") != NO_ID).groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    several = several.select("a", "b").unionByName(several.select(F.col("id").alias("a"), "b"))
    comp = components(links.unionByName(several))
    out = rep.join(comp, F.col("rep") == F.col("node"), "left")
    return out.select("id", "th", "size", F.when(F.col("id") != NO_ID, F.coalesce("component", "rep")).alias("component"))


def dedup_documents(docs: DataFrame, j: Join = Join(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that of the smallest id, all columns unchanged.  Of rows with
    one id the first by text hash stays, and one of equal rows; rows without id all stay."""
    found = jaccard_components(docs, j, id_col=id_col, text_col=text_col)
    key, gone, row = (free_name(docs, f"_jaccard_{x}") for x in ("id", "gone", "row"))
    ids = found.where(F.col("id") != NO_ID).groupBy("id").agg(F.min("component").alias("component"), F.count("*").alias("n"))
    ids = table(ids.where("component < id OR n > 1").select(F.col("id").alias(key), (F.col("component") < F.col("id")).alias(gone)), "ids")
    names = [F.col(f"`{c}`") for c in docs.columns]
    single = docs.join(ids, F.col(id_col) == F.col(key), "left_anti").select(*names)
    repeated = ids.where(~F.col(gone))
    if repeated.isEmpty():
        return single
    # a buffer holds one row, and equal ids are merged before they are sent
    first = F.struct(F.hash(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.col(text_col), F.xxhash64(*names))
    rows = docs.join(repeated, F.col(id_col) == F.col(key), "left_semi")
    rows = rows.groupBy(F.col(id_col).alias(key)).agg(F.min_by(F.struct(*names), first).alias(row))
    return single.unionByName(rows.select(f"{row}.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.to_id),
m AS (SELECT id, min(to_id) c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id"""

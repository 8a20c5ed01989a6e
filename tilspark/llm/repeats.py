"""Exact repeats of at least ``length`` units (bytes or words) over a whole corpus.

1. *Fragments.*  Every window of ``length`` units has an anchor: its smallest-hashed gram.  Windows
   in a row with one anchor make a fragment.  Anchors depend on a window's content only, so equal
   windows lie in fragments of one anchor, at the same distance from it.
2. *Anchors.*  Fragments (hashes and positions, no text) are dealt out by anchor; those whose anchor
   occurs once are done: none of their windows repeats.  Anchors that a sample finds to be frequent
   are dealt over all parts by document.
3. *Classes.*  Fragments of equal content are one class with a count, first and last document.
4. *Search.*  The text of one fragment for each class that may hold a repeat is fetched; whole anchors
   are gathered into shards of bounded size, and each shard's index says which windows of its classes
   are repeats.  An anchor of more than ``most_classes`` classes (a passage in very many contexts)
   would outgrow a shard: its classes are cut into parts that share nearly a whole window, which
   leaves few of them to search (``search_parts``).
5. Each document's covered ranges come back by its key.

Null ids get ``NO_ID``, the largest; documents are known by id and a hash of the text, so that rows
with one id and different texts stay apart, while repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import arrays as A
from .scratch import table

NO_ID = 2**63 - 1
#: bits of the filter that tells which documents a join needs; false alarms cost a shuffled row
FILTER_BITS = 1 << 25
_POSITION = 26  # bits of a position in a slice
SLICE_UNITS = 1 << 17  # hashed at a time: they fit a core's cache
#: windows of a part of a fragment
PART = 8


@dataclass(frozen=True)
class Unit:
    """What a window consists of.  ``split``: (buf, off) -> starts and ends of the units, and unit offsets of the rows."""

    name: str
    length: int
    gram: int
    split: Callable
    most_classes: int = 2048
    shard_units: int = 1 << 18  # of a task: 50 MB with the index


def _bytes(buf, off):
    return np.arange(len(buf)), None, off


def byte_unit(length: int) -> Unit:
    return Unit("byte", length, max(1, length // 4), _bytes)


def word_unit(length: int) -> Unit:
    return Unit("word", length, max(1, length // 6), A.words, shard_units=1 << 17)


class _ByteWindows(A.Windows):
    """Windows of bytes: eight of them are their own hash, so shorter levels are not needed."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.levels = [A.BYTE[buf[:0]], None, None, A.mix(A.eights(buf)[: max(0, n - 7)])]
        self.buf = buf

    def of(self, m: int, salt: int = 0) -> np.ndarray:
        if m >= 8:
            self.levels[0] = self.buf  # for its length
            return super().of(m, salt)
        return A.Windows(A.BYTE[self.buf]).of(m, salt)


def windows(unit: Unit, buf: np.ndarray, off: np.ndarray) -> tuple[A.Windows, int, np.ndarray]:
    """Hashes of the windows of all units, the number of units, and the unit offsets of the rows."""
    if unit.name == "byte":
        return _ByteWindows(buf), len(buf), off
    s, e, uoff = A.words(buf, off)
    return A.Windows(A.span_hashes(buf, s, e)), len(s), uoff


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost minimum of each w values in a row (of their upper bits)."""
    n = len(x)
    m = -(-n // w) * w
    key = np.full(m, np.uint64(2**64 - 1))
    key[:n] = (x & ~np.uint64(2**_POSITION - 1)) | np.arange(n, dtype=np.uint64)
    block = key.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1]).ravel()
    best = np.minimum(back[: n - w + 1], ahead[w - 1 : n])
    return (best & np.uint64(2**_POSITION - 1)).astype(np.int64)


def fragments(unit: Unit, hashes: A.Windows, n: int, uoff: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first unit in the row, number of units, anchor hash and content hash of each fragment."""
    length, gram = unit.length, unit.gram
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    grams = hashes.of(gram, 11)
    anchor = sliding_argmin(grams, length - gram + 1)
    row = A.rows_of(uoff)
    ends = uoff[1:][row[: n - length + 1]]
    ok = np.flatnonzero(np.arange(n - length + 1) + length <= ends)
    a = anchor[ok]
    first = np.ones(len(ok), bool)
    first[1:] = (a[1:] != a[:-1]) | (ok[1:] != ok[:-1] + 1)
    f = np.flatnonzero(first)
    begin = ok[f]
    last = ok[np.append(f[1:], len(ok)) - 1] if len(f) else begin
    # all windows hold the anchor, so the first and the last one overlap: they are the whole content
    size = last + length - begin
    content = A.mix(A.fold(A.fold(hashes.at(length, begin, 29), hashes.at(length, last, 29)), size.astype(np.uint64)))
    r = row[begin]
    return r, begin - uoff[r], size, grams[a[f]], content


def _chunks(unit: Unit, buf: np.ndarray, off: np.ndarray):
    """``fragments``, a long row piece by piece: pieces overlap by length - 1 units."""
    if len(buf) <= 4 * SLICE_UNITS:
        yield fragments(unit, *windows(unit, buf, off))
        return
    if unit.name == "byte":
        item, uoff = None, off
    else:
        s, e, uoff = A.words(buf, off)
        item = A.span_hashes(buf, s, e)
    for k in range(len(uoff) - 1):  # a slice of this size is one row
        a, b = int(uoff[k]), int(uoff[k + 1])
        for s in range(a, max(a + 1, b - unit.length + 1), SLICE_UNITS):
            e = min(b, s + SLICE_UNITS + unit.length - 1)
            hashes = _ByteWindows(buf[s:e]) if item is None else A.Windows(item[s:e])
            r, begin, size, anchor, content = fragments(unit, hashes, e - s, np.array([0, e - s]))
            yield r + k, begin + (s - a), size, anchor, content


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, th, text``: null ids are NO_ID, null texts empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return A.small_batches(docs).select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.hash(text).alias("th"), text.alias("text"))


def _occurrences(unit: Unit, batches):
    """Anchor, content, row's id and text hash, first unit, size and repetitions of all fragments.

    In periodic text equal fragments follow each other, each where the windows of the one before
    end; such a row stands for ``reps`` of them, so a filler that a text repeats is one row.
    """
    for batch in batches:
        ids, th = A.column(batch, "id").to_numpy(), A.column(batch, "th").to_numpy()
        for i, _, buf, off in A.sliced(A.column(batch, "text"), SLICE_UNITS):
            for r, at, size, anchor, content in _chunks(unit, buf, off):
                new = np.ones(len(r), bool)
                new[1:] = (r[1:] != r[:-1]) | (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]) | (at[1:] != at[:-1] + size[:-1] - unit.length + 1)
                f = np.flatnonzero(new)
                yield anchor[f], content[f], ids[i + r[f]], th[i + r[f]], at[f], size[f], np.diff(np.append(f, len(r)))


def hot_anchors(keys: DataFrame, unit: Unit, *, sample_docs: int = 2000, least: int = 12) -> np.ndarray:
    """Anchors that occur ``least`` times or more in a sample of about ``sample_docs`` documents,
    drawn by hash; sorted.  They are only dealt out otherwise: the answer doesn't depend on them.
    There are fewer than the sample's fragments over ``least``."""

    def run(batches):
        for anchor, *_, reps in _occurrences(unit, batches):
            yield pa.RecordBatch.from_pydict({"ah": anchor.view(np.int64), "reps": reps.astype(np.int32)})

    share = min(1.0, sample_docs / max(1, keys.count()))
    some = keys.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # rows, not repetitions: a filler that one text repeats is one row
    rows = some.mapInArrow(A.trimmed(run), "ah bigint, reps int").groupBy("ah").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("ah").collect()
    return np.sort(np.array([r["ah"] for r in rows], np.int64))


def occurrences(keys: DataFrame, unit: Unit, hot: np.ndarray, parts: int) -> DataFrame:
    """All fragments of all documents: ``part, hot, ah, fh, id, th, at, size, reps``.  An anchor has one
    part, a hot one as many as it has documents."""
    sent = keys.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        known = sent.value
        for anchor, content, ids, th, at, size, reps in _occurrences(unit, batches):
            ah = anchor.view(np.int64)
            k = np.minimum(np.searchsorted(known, ah), max(0, len(known) - 1))
            is_hot = known[k] == ah if len(known) else np.zeros(len(ah), bool)
            spread = np.where(is_hot, A.mix(ids.view(np.uint64) + A.U(1)), A.U(0))
            part = (A.mix(anchor ^ spread) % A.U(parts)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"part": part, "hot": is_hot, "ah": ah, "fh": content.view(np.int64), "id": ids, "th": th, "at": at.astype(np.int32), "size": size.astype(np.int32), "reps": reps.astype(np.int32)})

    return keys.mapInArrow(A.trimmed(run), "part int, hot boolean, ah bigint, fh bigint, id bigint, th int, at int, size int, reps int")


def id_filter(ids: DataFrame) -> "np.ndarray":
    """A bitmap of the hashes of the ids, of FILTER_BITS: 4 MB, whatever the number of ids."""

    def run(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[_slots(A.column(batch, "id").to_numpy())] = True
        packed = np.packbits(bits, bitorder="little").reshape(-1, 4096)
        some = np.flatnonzero(packed.any(axis=1))
        for k in range(0, len(some), 64):
            yield pa.RecordBatch.from_pydict({"k": some[k : k + 64].astype(np.int32), "bits": pa.array([packed[x].tobytes() for x in some[k : k + 64]], pa.binary())})

    def add(batches):
        at, bits = None, None
        for batch in batches:
            for k, b in zip(A.column(batch, "k").to_pylist(), A.column(batch, "bits").to_pylist()):
                x = np.frombuffer(b, np.uint8)
                if k == at:
                    bits = bits | x
                    continue
                if at is not None:
                    yield pa.RecordBatch.from_pydict({"k": pa.array([at], pa.int32()), "bits": [bits.tobytes()]})
                at, bits = k, x
        if at is not None:
            yield pa.RecordBatch.from_pydict({"k": pa.array([at], pa.int32()), "bits": [bits.tobytes()]})

    schema = "k int, bits binary"
    parts = ids.select("id").mapInArrow(A.trimmed(run), schema).repartition("k").sortWithinPartitions("k").mapInArrow(add, schema).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        out[r["k"] * 4096 : (r["k"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _slots(ids: np.ndarray) -> np.ndarray:
    return (A.mix(ids.view(np.uint64) + A.U(0x632BE59BD9B4E019)) % A.U(FILTER_BITS)).astype(np.int64)


def in_filter(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = _slots(ids)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def only(keys: DataFrame, ids: DataFrame | None = None, bits=None) -> DataFrame:
    """The rows of ``keys`` whose id may be among ``ids`` (all that are, and few others), or is in the
    broadcast filter."""
    sent = bits or keys.sparkSession.sparkContext.broadcast(id_filter(ids))

    def run(batches):
        for batch in batches:
            hit = np.flatnonzero(in_filter(sent.value, A.column(batch, "id").to_numpy()))
            for i in range(0, len(hit), 256):
                yield batch.take(pa.array(hit[i : i + 256]))

    return keys.mapInArrow(A.trimmed(run), keys.schema)


def pieces(keys: DataFrame, wanted: DataFrame, unit: Unit) -> DataFrame:
    """``wanted`` (with id, th, at, size) and the text of each of its fragments."""
    by_doc = wanted.groupBy("id", "th").agg(F.collect_list(F.struct(*[c for c in wanted.columns if c not in ("id", "th")])).alias("want"))
    joined = only(keys, wanted.select("id")).dropDuplicates(["id", "th"]).join(by_doc, ["id", "th"]).select("text", "want")
    names = [f.name for f in wanted.schema if f.name not in ("id", "th")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema if f.name in names) + ", piece binary"

    def run(batches):
        for batch in batches:
            want = A.column(batch, "want")
            flat = pa.RecordBatch.from_struct_array(want.flatten())
            woff = np.concatenate([[0], np.cumsum(want.value_lengths().to_numpy())])
            at, size = A.column(flat, "at").to_numpy().astype(np.int64), A.column(flat, "size").to_numpy().astype(np.int64)
            for i, j, buf, off in A.sliced(A.column(batch, "text")):
                s, e, uoff = unit.split(buf, off)
                w = np.arange(woff[i], woff[j])
                row = np.repeat(np.arange(j - i), np.diff(woff[i : j + 1]))
                first = uoff[row] + at[w]
                a = s[first]
                b = first + size[w] if e is None else e[first + size[w] - 1]
                raw = buf.tobytes()
                part = flat.slice(int(woff[i]), len(w))
                yield pa.RecordBatch.from_arrays([*[A.column(part, n) for n in names], pa.array([raw[x:y] for x, y in zip(a.tolist(), b.tolist())], pa.binary())], [*names, "piece"])

    return joined.mapInArrow(A.trimmed(run), schema)


def _shards(batches, unit: Unit):
    """Whole anchors, gathered to shards of about ``shard_units`` units (rows come sorted by anchor)."""
    held, units = [], 0
    for batch in batches:
        ah = A.column(batch, "ah").to_numpy()
        cut = np.flatnonzero(ah[1:] != ah[:-1]) + 1
        size = A.column(batch, "size").to_numpy()
        total = np.cumsum(size)
        begin = 0
        if held and len(ah) and ah[0] != held[-1][1] and units > unit.shard_units:
            yield pa.Table.from_batches([b for b, _ in held]).combine_chunks()
            held, units = [], 0
        for c in cut.tolist():
            if units + total[c - 1] - (total[begin - 1] if begin else 0) > unit.shard_units:
                held.append((batch.slice(begin, c - begin), ah[c - 1]))
                yield pa.Table.from_batches([b for b, _ in held]).combine_chunks()
                held, units, begin = [], 0, c
        if len(ah) > begin:
            held.append((batch.slice(begin), ah[-1]))
            units += int(total[-1] - (total[begin - 1] if begin else 0))
    if held:
        yield pa.Table.from_batches([b for b, _ in held]).combine_chunks()


@dataclass(frozen=True)
class Shard:
    """Fragments joined by the symbol 0; other symbols count from 1."""

    text: np.ndarray
    begin: np.ndarray  # of each fragment in the text
    size: np.ndarray  # of each fragment, in units
    n: np.ndarray  # how often each fragment occurs
    low: np.ndarray  # the first and last document that hold it
    high: np.ndarray
    frag: np.ndarray  # of each window: its fragment, its place in it, its position in the text
    place: np.ndarray
    position: np.ndarray
    owner: np.ndarray  # of each position: the fragment of the window that begins there, or the one before


def _dense(unit: Unit, items: np.ndarray) -> np.ndarray:
    """Symbols from 1: as few as there are, so as few levels of the index."""
    if unit.name == "byte":
        seen = np.zeros(256, bool)
        seen[items] = True
        return np.cumsum(seen, dtype=np.int32)[items]
    return np.unique(items, return_inverse=True)[1].astype(np.int32) + 1


def _shard(unit: Unit, part: pa.RecordBatch) -> Shard:
    buf, off = A.utf8(A.column(part, "piece").cast(pa.large_binary()).view(pa.large_string()))
    if unit.name == "byte":
        symbols, uoff = _dense(unit, buf), off
    else:
        s, e, uoff = A.words(buf, off)
        symbols = _dense(unit, A.span_hashes(buf, s, e))
    n = np.diff(uoff)
    text = np.zeros(len(symbols) + len(n), np.int32)
    begin = uoff[:-1] + np.arange(len(n))
    text[np.arange(len(symbols)) + np.repeat(np.arange(len(n)), n)] = symbols
    count = np.maximum(n - unit.length + 1, 0)
    frag = np.repeat(np.arange(len(n)), count)
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return Shard(text, begin, n, *(A.column(part, c).to_numpy() for c in ("n", "low", "high")), frag, place, begin[frag] + place, np.repeat(np.arange(len(n)), n + 1))


def _chain_shard(unit: Unit, items: np.ndarray, units: np.ndarray, chain: np.ndarray, shift: np.ndarray, size: np.ndarray, n, low, high) -> Shard:
    """A shard of chains: ``units`` of each, and each fragment's chain and place in it."""
    text = np.zeros(len(items) + len(units), np.int32)
    text[np.arange(len(items)) + np.repeat(np.arange(len(units)), units)] = _dense(unit, items)
    begin = (np.cumsum(units) - units + np.arange(len(units)))[chain] + shift
    count = size - unit.length + 1
    frag = np.repeat(np.arange(len(size)), count)
    place = np.arange(len(frag)) - np.repeat(np.cumsum(count) - count, count)
    owner = np.zeros(len(text), np.int64)
    owner[begin[frag] + place] = frag
    return Shard(text, begin, size, n, low, high, frag, place, begin[frag] + place, np.maximum.accumulate(owner))


def _runs(shard: Shard, find: Callable, ah: np.ndarray, fh: np.ndarray):
    """``ah, fh, later, first, last`` of the runs of windows for which ``find`` holds."""
    for later, hit in find(shard):
        frag, place = shard.frag[hit], shard.place[hit]
        new = np.ones(len(frag), bool)
        new[1:] = (frag[1:] != frag[:-1]) | (place[1:] != place[:-1] + 1)
        f = np.flatnonzero(new)
        if len(f):
            last = np.append(f[1:], len(frag)) - 1
            yield pa.RecordBatch.from_pydict({"ah": ah[frag[f]], "fh": fh[frag[f]], "later": np.full(len(f), later), "first": place[f].astype(np.int32), "last": place[last].astype(np.int32)})


RUNS = "ah bigint, fh bigint, later boolean, first int, last int"


def search_chains(unit: Unit, find: Callable, keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """``search`` for classes that are alone at their anchors (``wanted``: ``pieces``' columns).

    They share no window with another class, so any shard will do: that of their documents' tasks.
    Fragments that follow each other in a document are one chain there, whose text is taken once.
    """
    names = ("ah", "fh", "n", "low", "high", "at", "size")
    by_doc = wanted.groupBy("id", "th").agg(F.collect_list(F.struct(*names)).alias("want"))
    joined = only(keys, wanted.select("id")).dropDuplicates(["id", "th"]).join(by_doc, ["id", "th"]).select("text", "want")

    def flush(held):
        items, units, shift, size, *cols = (np.concatenate([h[k] for h in held]) for k in (0, 1, 3, 4, 5, 6, 7, 8, 9))
        before = np.cumsum([0, *(len(h[1]) for h in held)])
        chain = np.concatenate([h[2] + b for h, b in zip(held, before)])
        ends = np.cumsum(units)
        shard = (ends - 1) // unit.shard_units  # of each chain; one long text makes several
        for k in np.unique(shard).tolist():
            a, b = (int(x) for x in np.searchsorted(shard, [k, k + 1]))
            f = slice(*(int(x) for x in np.searchsorted(chain, [a, b])))
            ah, fh, n, low, high = (c[f] for c in cols)
            yield from _runs(_chain_shard(unit, items[ends[a] - units[a] : ends[b - 1]], units[a:b], chain[f] - a, shift[f], size[f], n, low, high), find, ah, fh)

    def run(batches):
        held, total = [], 0
        for batch in batches:
            want = A.column(batch, "want")
            flat = pa.RecordBatch.from_struct_array(want.flatten())
            woff = np.concatenate([[0], np.cumsum(want.value_lengths().to_numpy())])
            cols = {c: A.column(flat, c).to_numpy().astype(np.int64) for c in names}
            for i, j, buf, off in A.sliced(A.column(batch, "text"), SLICE_UNITS):
                s, e, uoff = unit.split(buf, off)
                w = np.arange(woff[i], woff[j])
                row = np.repeat(np.arange(j - i), np.diff(woff[i : j + 1]))
                order = np.lexsort((cols["at"][w], row))
                w, row = w[order], row[order]
                at, size = cols["at"][w], cols["size"][w]
                new = np.ones(len(w), bool)
                new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + size[:-1] - unit.length + 1) | (at[1:] >> 15 != at[:-1] >> 15)
                f = np.flatnonzero(new)
                chain, last = np.cumsum(new) - 1, np.append(f[1:], len(w)) - 1
                begin = uoff[row[f]] + at[f]
                units = uoff[row[last]] + at[last] + size[last] - begin
                items = A.gather(buf if e is None else A.span_hashes(buf, s, e), begin, units)
                held.append((items, units, chain, at - at[f][chain], size, *(cols[c][w] for c in ("ah", "fh", "n", "low", "high"))))
                total += len(items)
                if total > unit.shard_units:
                    yield from flush(held)
                    held, total = [], 0
        if held:
            yield from flush(held)

    return joined.mapInArrow(A.trimmed(run), RUNS)




def search(unit: Unit, find: Callable, wanted: DataFrame) -> DataFrame:
    """``ah, fh, later, first, last``: runs of windows of a class for which ``find`` holds.  It gives the
    windows' verdicts for all documents of a class (or its first), and for the later ones if they differ."""

    def run(batches):
        for table_ in _shards(batches, unit):
            part = table_.to_batches()[0]
            shard = _shard(unit, part)
            ah, fh = A.column(part, "ah").to_numpy(), A.column(part, "fh").to_numpy()
            yield from _runs(shard, find, ah, fh)

    n = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return wanted.repartition(n, "ah").sortWithinPartitions("ah").mapInArrow(A.trimmed(run), RUNS)


def part_rows(unit: Unit, wanted: DataFrame) -> DataFrame:
    """The classes in parts of at most ``PART`` windows, by their distance from the anchor: ``key, sh, ah,
    fh, n, low, high, shift, size, piece``.

    Windows that are equal lie at the same distance from their anchors, so in parts of one number, and
    have in common what all windows of such a part hold: ``key`` is the hash of anchor, number and that.
    ``sh`` is that of the part's content, ``shift`` its place in the class's fragment.
    """
    core = unit.length - PART + 1

    def run(batches):
        for batch in batches:
            piece = A.column(batch, "piece").cast(pa.large_binary()).view(pa.large_string())
            for i, k, buf, off in A.sliced(piece, SLICE_UNITS):
                s, e, _ = unit.split(buf, off)
                hashes, _, uoff = windows(unit, buf, off)
                ah = A.column(batch, "ah").to_numpy()[i:k]
                size = np.diff(uoff)
                grams = hashes.of(unit.gram, 11)
                row = A.rows_of(uoff)[: len(grams)]
                at = np.flatnonzero((grams == ah.view(np.uint64)[row]) & (np.arange(len(grams)) + unit.gram <= uoff[1:][row]))
                _, first = np.unique(row[at], return_index=True)
                anchor = at[first] - uoff[:-1]  # the first such gram, in each fragment
                # windows begin 0 to anchor units before it; parts are counted from the anchor
                high, low = anchor // PART, (anchor - (size - unit.length)) // PART
                count = high - low + 1
                f = np.repeat(np.arange(k - i), count)
                number = low[f] + np.arange(len(f)) - np.repeat(np.cumsum(count) - count, count)
                begin = np.maximum(0, anchor[f] - PART * number - PART + 1)
                last = np.minimum(size[f] - unit.length, anchor[f] - PART * number)
                base = uoff[:-1][f]
                inner = hashes.at(core, base + anchor[f] - PART * number, 31)
                key = A.mix(A.fold(A.fold(ah.view(np.uint64)[f], number.astype(np.uint64)), inner))
                units = last - begin + unit.length
                content = A.mix(A.fold(A.fold(hashes.at(unit.length, base + begin, 37), hashes.at(unit.length, base + last, 37)), units.astype(np.uint64)))
                raw = buf.tobytes()
                x = s[base + begin]
                y = base + begin + units if e is None else e[base + begin + units - 1]
                cols = {c: A.column(batch, c).to_numpy()[i:k][f] for c in ("ah", "fh", "n", "low", "high")}
                yield pa.RecordBatch.from_pydict({
                    "key": key.view(np.int64), "sh": content.view(np.int64), **cols, "shift": begin.astype(np.int32), "size": units.astype(np.int32),
                    "piece": pa.array([raw[u:v] for u, v in zip(x.tolist(), y.tolist())], pa.binary()),
                })

    return wanted.mapInArrow(A.trimmed(run), "key bigint, sh bigint, ah bigint, fh bigint, n bigint, low bigint, high bigint, shift int, size int, piece binary")


def window_rows(unit: Unit, wanted: DataFrame) -> DataFrame:
    """``ah, fh, n, low, place, wh``: every window of the classes, by hash."""

    def run(batches):
        for batch in batches:
            piece = A.column(batch, "piece").cast(pa.large_binary()).view(pa.large_string())
            for i, _, buf, off in A.sliced(piece, SLICE_UNITS):
                hashes, _, uoff = windows(unit, buf, off)
                wh = hashes.of(unit.length, 23)
                n = np.maximum(np.diff(uoff) - unit.length + 1, 0)
                frag = np.repeat(np.arange(len(n)), n)
                place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                cols = {c: A.column(batch, c).to_numpy()[i:][frag] for c in ("ah", "fh", "n", "low")}
                yield pa.RecordBatch.from_pydict({**cols, "place": place.astype(np.int32), "wh": wh[uoff[:-1][frag] + place].view(np.int64)})

    return wanted.mapInArrow(A.trimmed(run), "ah bigint, fh bigint, n bigint, low bigint, place int, wh bigint")


#: so many anchors are broadcast (1 MB), more are joined by a shuffle
BROADCAST_ANCHORS = 1 << 17


def _with_size(classes: DataFrame, unit: Unit) -> DataFrame:
    """``classes`` and whether their anchor has more of them than go into a shard: counted map-side
    first, and the few such anchors come back by a broadcast, so none is gathered."""
    large = classes.groupBy("ah").agg(F.count("*").alias("nc")).where(F.col("nc") > unit.most_classes).select("ah", F.lit(True).alias("large"))
    large = table(large, "large")
    few = large.count() <= BROADCAST_ANCHORS
    return classes.join(F.broadcast(large) if few else large, "ah", "left").withColumn("large", F.coalesce("large", F.lit(False)))


def search_parts(unit: Unit, find: Callable, wanted: DataFrame, by_count: bool) -> DataFrame:
    """``search`` for classes whose anchors have too many for a shard.

    They are cut into parts, few of which have anything in common with another; parts are searched like
    fragments, under their key for an anchor.  Only a key that still has too many parts (one text of
    nearly a window's length before or after very many different ones) is counted window by window.
    """
    parts = table(part_rows(unit, wanted), "parts")
    found = parts.groupBy(F.col("key").alias("ah"), F.col("sh").alias("fh")).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.first("size").alias("size"), F.first("piece").alias("piece"))
    several = found.groupBy("ah").agg(F.sum("n").alias("all"), F.min("low").alias("least"), F.max("high").alias("most")).where("all > 1" if by_count else "least < most").select("ah")
    classes = table(_with_size(found.join(several, "ah"), unit), "part_classes")
    runs = search(unit, find, classes.where("NOT large").drop("large"))
    large = classes.where("large")
    rows = window_rows(unit, large.select("ah", "fh", "n", "low", "piece"))
    sums = rows.groupBy("ah", "wh").agg(F.sum("n").alias("all"), F.min("low").alias("lowest")).where("all > 1")
    hits = rows.join(sums, ["ah", "wh"]).where(F.lit(by_count) | (F.col("lowest") < F.col("low")))
    hits = hits.withColumn("run", F.col("place") - F.row_number().over(Window.partitionBy("ah", "fh").orderBy("place")))
    hits = hits.groupBy("ah", "fh", "run").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    runs = runs.unionByName(hits.select("ah", "fh", F.lit(False).alias("later"), "first", "last"))
    if not by_count:
        runs = runs.unionByName(large.where("low < high").select("ah", "fh", F.lit(True).alias("later"), F.lit(0).alias("first"), (F.col("size") - unit.length).alias("last")))
    # back to the classes that the parts are of; a part's first document is not that of all of them
    back = parts.select(F.col("key"), F.col("sh"), "ah", "fh", F.col("low").alias("own"), F.col("high").alias("own_high"), "shift")
    runs = runs.join(classes.select("ah", "fh", F.col("low").alias("part_low")), ["ah", "fh"]).select(F.col("ah").alias("key"), F.col("fh").alias("sh"), "later", "first", "last", "part_low")
    out = runs.join(back, ["key", "sh"])
    place = [(F.col("first") + F.col("shift")).alias("first"), (F.col("last") + F.col("shift")).alias("last")]
    if by_count:
        return out.select("ah", "fh", "later", *place)
    # a class whose first document comes after the part's first is a later one of the part's, all of it
    whole = out.where("later AND own > part_low").select("ah", "fh", F.explode(F.array(F.lit(False), F.lit(True))).alias("later"), *place)
    return out.where("own = part_low").select("ah", "fh", "later", *place).unionByName(whole)


def covered_ranges(docs: DataFrame, unit: Unit, find: Callable, by_count: bool, *, id_col: str, text_col: str) -> DataFrame:
    """``id, th, ranges``: unit ranges (start, end) of the windows that count as repeats.

    ``by_count``: a window repeats if it occurs twice or more (``low`` is not used); otherwise if
    a document of smaller id holds it.
    """
    keys = keyed(docs, id_col, text_col)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy("part", "ah")  # as dealt: no further shuffle
    many = occurrences(keys, unit, hot_anchors(keys, unit), n).repartitionById(n, "part").withColumn("tot", F.sum("reps").over(w))
    many = many.withColumn("single", F.min("fh").over(w) == F.max("fh").over(w)).where("tot > 1 OR hot")
    many = table(many.select("hot", "single", "ah", "fh", "id", "th", "at", "size", "reps"), "fragments")
    classes = many.groupBy("ah", "fh").agg(
        F.sum("reps").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.min(F.struct("id", "th", "at", "size")).alias("rep"),
        F.first("single").alias("single"), F.first("hot").alias("hot"),
    )
    classes = table(classes, "classes")
    # hot anchors were looked at in parts: what the parts don't know of each other, for a few thousand anchors at most
    whole_hot = classes.where("hot").groupBy("ah").agg((F.count("*") == 1).alias("one"))
    classes = classes.join(F.broadcast(whole_hot), "ah", "left").withColumn("single", F.when(F.col("hot"), F.col("one")).otherwise(F.col("single"))).drop("one", "hot")
    place = ["ah", "fh", "n", "low", "high", "rep.*"]
    wanted = _with_size(classes.where("NOT single"), unit).select(*place, "large")
    wanted = table(pieces(keys, wanted, unit), "pieces")
    found = search(unit, find, wanted.where("NOT large").select("ah", "fh", "n", "low", "high", "size", "piece"))
    # a class alone at its anchor repeats as a whole, if at all; the index says so of it too
    alone = classes.where("single AND n > 1" if by_count else "single AND low < high").select(*place)
    found = found.unionByName(search_chains(unit, find, keys, alone))
    large = wanted.where("large").select("ah", "fh", "n", "low", "high", "piece")
    if not large.isEmpty():
        found = found.unionByName(search_parts(unit, find, large, by_count))
    found = table(found, "runs")
    # back to the documents: equal fragments in a row overlap by more than a window's length, so their ranges are one
    more = (F.col("reps") - 1) * (F.col("size") - unit.length + 1)
    part = found.join(many, ["ah", "fh"])
    if not by_count:  # the first document of a class, or the others
        part = part.join(classes.where("low < high").select("ah", "fh", "low"), ["ah", "fh"], "left").where(F.col("later") == F.coalesce(F.col("id") > F.col("low"), F.lit(False)))
    part = part.select("id", "th", (F.col("at") + F.col("first")).alias("start"), (F.col("at") + more + F.col("last") + unit.length).alias("end"))
    ranges = part.groupBy("id", "th").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    return table(ranges, "ranges")


def with_ranges(docs: DataFrame, ranges: DataFrame, run: Callable, schema: str, *, id_col: str, text_col: str) -> DataFrame:
    """``run(batch with id, text, ranges)`` over all documents; those without ranges are not shuffled."""
    keys = keyed(docs, id_col, text_col)
    bits = keys.sparkSession.sparkContext.broadcast(id_filter(ranges.select("id")))

    def direct(batches):
        for batch in batches:
            rest = np.flatnonzero(~in_filter(bits.value, A.column(batch, "id").to_numpy()))
            for i in range(0, len(rest), 256):
                part = batch.take(pa.array(rest[i : i + 256]))
                empty = pa.array([[]] * len(part), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield from run(pa.RecordBatch.from_arrays([A.column(part, "id"), A.column(part, "text"), empty], ["id", "text", "ranges"]))

    def joined(batches):
        for batch in batches:
            yield from run(batch)

    hit = only(keys, ranges.select("id")).join(ranges, ["id", "th"], "left").select("id", "text", "ranges")
    return keys.mapInArrow(A.trimmed(direct), schema).unionByName(hit.mapInArrow(A.trimmed(joined), schema))


def cover(batch: pa.RecordBatch, i: int, j: int, uoff: np.ndarray) -> np.ndarray:
    """Which units of the rows i to j lie in any of their ranges."""
    ranges = A.column(batch, "ranges").slice(i, j - i)
    length = ranges.value_lengths().fill_null(0).to_numpy()
    flat = ranges.flatten()
    row = np.repeat(np.arange(j - i), length)
    s, e = (uoff[row] + flat.field(k).to_numpy() for k in (0, 1))
    return A.covered(int(uoff[-1]), s.astype(np.int64), e.astype(np.int64))

"""Repeated byte strings across documents, by bucket-pointer refinement.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id. So the suffixes of all texts are to be sorted, but
only to depth ``LENGTH``, and only where more than one document meets.

1. *Initial buckets.* A window of ``LENGTH`` bytes belongs to the bucket of its
   least ``Q``-gram (by a 64-bit hash): equal windows have equal buckets.
   Neighbouring windows with the same least Q-gram form a run, up to ``RUN``
   windows long, named by (g: hash of the Q-gram, f: hash of the run's bytes).
   Each piece of text sends a run's name once, with its smallest id; about 6
   names a hundred bytes go through the shuffle, not the suffixes.
2. *Classes.* Runs of one name are equal, so all but those of the smallest
   document are covered whole. A bucket with runs of several names and documents
   stays open: its runs may share some windows.
3. *Refinement.* One run of each open class is sent with its bytes to its
   bucket's task. There suffixes start in buckets by their first 8 bytes, and
   buckets of more than one member are sorted by the bucket pointers of the
   suffixes 8 bytes on, which gives depth 16; the new pointers are used again to
   reach 32 and then ``LENGTH``. This compares bytes, not hashes. Windows that
   end up in one bucket are equal; those of larger ids are covered.
4. *Cut.* Covered windows go back to their documents, whose bytes are marked.

A bucket that holds a great part of all runs (a very common line between varying
neighbours) would not fit one task. Such buckets are found by counting the runs
of every ``SAMPLE``-th document; the count decides where runs are sorted, never
whether. Their runs are dealt by (g, f), and in the refinement each of their
windows is a string of its own, dealt by the hashes of the Q-grams at both its
ends, equal windows of a piece being combined before the shuffle.

Defined cases: an empty table gives no rows; a null or empty text, or one of
fewer than ``LENGTH`` bytes, loses nothing; equal texts with different ids leave
the smallest id's; rows that share an id are one document and remove nothing
from each other; a null id is neither smaller nor larger than another, so its
row keeps all and removes nothing.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm import common, word_hash
from gavel.llm.common import by_value, slices, staged, text_of
from gavel.llm.word_hash import _bytes_of, _named, _sums, _tables, blend

by_value(sys.modules[__name__])
by_value(common)
by_value(word_hash)

LENGTH, Q = 50, 20
WIDTH = LENGTH - Q + 1  # Q-grams of a window
RUN = 32  # windows of a run at most: bits of a mask
PIECE = 1 << 20  # bytes of text that are cut into runs at once
GROUP = 1 << 25  # bytes of run names that one task sorts at once
OPEN_GROUP = 1 << 21  # bytes of open runs that one task refines at once
SAMPLE = 256


def _names(b, first, last):
    _lower, numbers, powers, inverse = _tables(len(b))
    return _named(_sums(numbers, powers, b), inverse, first, last)


def runs(b: np.ndarray, off: np.ndarray):
    """(g, f, text, start, windows) of the runs of texts ``off`` in bytes ``b``."""
    none = np.zeros(0, dtype=np.int64)
    n = len(b) - LENGTH + 1
    if n <= 0:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    _lower, numbers, powers, inverse = _tables(len(b))
    total = _sums(numbers, powers, b)
    at = np.arange(len(b) - Q + 1)
    least = _named(total, inverse, at, at + Q)
    del at
    size = 1
    while size * 2 <= WIDTH:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:n], least[WIDTH - size : WIDTH - size + n])
    # windows inside one text
    inside = np.ones(n, dtype=bool)
    for end in off[1:-1]:
        inside[max(0, end - LENGTH + 1) : end] = False
    text_start = np.zeros(n, dtype=bool)
    text_start[off[:-1][off[:-1] < n]] = True
    begins = np.ones(n, dtype=bool)
    begins[1:] = (least[1:] != least[:-1]) | ~inside[:-1] | text_start[1:]
    start = np.flatnonzero(inside & begins)
    stop = np.flatnonzero(inside & np.concatenate([begins[1:] | ~inside[1:], [True]])) + 1
    # long runs (periodic text) in pieces
    pieces = -(-(stop - start) // RUN)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start, stop = np.repeat(start, pieces) + nth * RUN, np.repeat(stop, pieces)
    windows = np.minimum(stop - start, RUN)
    f = _named(total, inverse, start, start + windows + LENGTH - 1)
    return least[start], f, np.searchsorted(off, start, side="right") - 1, start, windows


def _first_of(*keys):
    """Order by the keys (the last counts least), and where a new combination
    of all but the last begins."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys[:-1]:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, new


def _dealt(g, f, hot, parts: int):
    """Task of a run: by its bucket; by its name where the bucket is hot."""
    split = np.isin(g, hot)
    return (blend(g + np.where(split, f, np.uint64(0))) % np.uint64(parts)).astype(np.int32)


def _signed(x):
    return pa.array(x.view(np.int64))


def run_names(docs: DataFrame, hot: np.ndarray, parts: int) -> DataFrame:
    """Runs of all documents (columns id, text) by the task they are dealt to:
    part, names (g, f, id of several runs, packed). Copies within a piece of
    text are covered already; they go to negative parts, one a piece."""
    def cut(batches):
        for batch in batches:
            for piece in slices(batch, "text", PIECE):
                ids = np.asarray(piece.column(0), dtype=np.int64)
                g, f, text, _start, _windows = runs(*_bytes_of(piece.column(1)))
                owner = ids[text]
                order, new = _first_of(g, f, owner)
                g, f, owner = g[order], f[order], owner[order]
                least = owner[new][np.cumsum(new) - 1] if len(new) else owner
                same = np.concatenate([[False], (owner[1:] == owner[:-1]) & ~new[1:]])[: len(owner)]
                part = _dealt(g, f, hot, parts)
                if len(part):
                    part[owner > least] = -1 - int(blend(g[:1] ^ f[-1:])[0] % np.uint64(parts))
                use = np.flatnonzero(new | ((owner > least) & ~same))
                use = use[np.lexsort((owner[use], part[use]))]
                at = np.flatnonzero(np.concatenate([[True], part[use][1:] != part[use][:-1]])) if len(use) else use
                ends = [*at[1:], len(use)][: len(at)]
                packed = [np.concatenate([x[use[s:e]].view(np.int64) for x in (g, f, owner)]).tobytes() for s, e in zip(at, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part[use[at]], type=pa.int32()), pa.array(packed, type=pa.binary())], names=["part", "names"])

    return docs.select("id", "text").mapInArrow(cut, "part int, names binary")


def _unpacked(blobs):
    parts = [np.frombuffer(x.as_buffer(), dtype=np.int64).reshape(3, -1) for x in blobs]
    g, f, ids = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), dtype=np.int64)
    return g.view(np.uint64), f.view(np.uint64), ids


def classes(names: DataFrame, hot: np.ndarray) -> DataFrame:
    """id, g, f, open: runs that are covered whole (open false), and a run of
    each class of the buckets that stay open."""
    kind = "id long, g long, f long, open boolean"

    def rows(ids, g, f, opened):
        return [pa.array(ids), _signed(g), _signed(f), pa.array(opened)]

    def resolve(key, table):
        g, f, ids = _unpacked(table.column("names"))
        if key[0].as_py() < 0:
            return pa.Table.from_arrays(rows(ids, g, f, np.zeros(len(ids), dtype=bool)), names=["id", "g", "f", "open"])
        order, new = _first_of(g, f, ids)
        g, f, ids = g[order], f[order], ids[order]
        least = ids[new][np.cumsum(new) - 1]
        covered = ids > least
        # buckets: several classes, whose least ids differ
        cg, cid = g[new], ids[new]
        begin = np.concatenate([[True], cg[1:] != cg[:-1]])
        at = np.flatnonzero(begin)
        differ = np.minimum.reduceat(cid, at) != np.maximum.reduceat(cid, at)
        opened = np.zeros(len(ids), dtype=bool)
        opened[new] = differ[np.cumsum(begin) - 1] | np.isin(cg, hot)
        use = covered | opened
        return pa.Table.from_arrays(rows(ids[use], g[use], f[use], opened[use]), names=["id", "g", "f", "open"])

    return names.groupBy("part").applyInArrow(resolve, kind)


def _lookup(text, g, f, of):
    """Index into ``of`` (its arrays text, g, f) of each run, or -1; the order
    of ``of`` by a 64-bit name, and those names."""
    a = blend(g + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ f
    b = blend(of[1] + of[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ of[2]
    order = np.argsort(b, kind="stable")
    at = np.searchsorted(b[order], a)
    found = np.full(len(a), -1)
    ok = at < len(b)
    hit = order[at[ok]] if len(b) else at[ok]
    ok[ok] = (of[0][hit] == text[ok]) & (of[1][hit] == g[ok]) & (of[2][hit] == f[ok])
    found[ok] = order[at[ok]]
    return found, order, b


def _flat(column):
    """(row, g, f, third field or None) of an array column of structs."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(lists.value_lengths().fill_null(0))
    fields = lists.flatten()
    values = [np.asarray(fields.field(i)) for i in range(fields.type.num_fields)]
    return np.repeat(np.arange(len(size)), size), values[0].view(np.uint64), values[1].view(np.uint64), *values[2:]


def open_strings(docs: DataFrame, opened: DataFrame, hot: np.ndarray, parts: int) -> DataFrame:
    """part, id, g, f, k (its first window in the run), bytes of the open runs."""
    def cut(batches):
        for batch in batches:
            for piece in slices(batch, "text", PIECE):
                ids = np.asarray(piece.column(0), dtype=np.int64)
                b, off = _bytes_of(piece.column(1))
                g, f, text, start, windows = runs(b, off)
                row, og, of = _flat(piece.column(2))
                found, _order, _b = _lookup(text, g, f, (row, og, of))
                use = found >= 0
                # one run of a name and document
                held = np.flatnonzero(use)
                held = held[np.unique(found[held], return_index=True)[1]]
                g, f, owner, start, windows = g[held], f[held], ids[text[held]], start[held], windows[held]
                part, k = _dealt(g, f, np.zeros(0, dtype=np.uint64), parts), np.zeros(len(g), dtype=np.int32)
                split = np.isin(g, hot)
                if split.any():
                    n = windows[split]
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    hg, hf, ho, hs = (np.repeat(x[split], n) for x in (g, f, owner, start))
                    hs = hs + nth
                    ends = _names(b, hs, hs + Q) + blend(_names(b, hs + LENGTH - Q, hs + LENGTH))
                    g, f, owner, start, windows, k = (np.concatenate([x[~split], y]) for x, y in ((g, hg), (f, hf), (owner, ho), (start, hs), (windows, np.ones(len(hs), dtype=np.int64)), (k, nth.astype(np.int32))))
                    part = np.concatenate([part[~split], (blend(hg + ends) % np.uint64(parts)).astype(np.int32)])
                text_bytes = [b[s : s + w + LENGTH - 1].tobytes() for s, w in zip(start, windows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part, type=pa.int32()), pa.array(owner), _signed(g), _signed(f), pa.array(k, type=pa.int32()), pa.array(text_bytes, type=pa.binary())], names=["part", "id", "g", "f", "k", "bytes"])

    held = opened.groupBy("id").agg(F.collect_list(F.struct("g", "f")).alias("names"))
    rows = docs.filter("id IS NOT NULL").join(held, "id").select("id", "text", "names")
    return rows.mapInArrow(cut, "part int, id long, g long, f long, k int, bytes binary")


def equal_windows(b: np.ndarray, off: np.ndarray):
    """(start, bucket) of all windows of the strings ``off`` in ``b``: windows
    are in one bucket if and only if their bytes are equal. Bucket pointers are
    refined from depth 8 to 16, 32 and ``LENGTH``."""
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(b))  # bytes to the string's end
    at = np.flatnonzero(left >= 8)
    key = np.zeros(len(at), dtype=np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | b[at + i]
    pointer = np.zeros(len(b), dtype=np.int64)
    pointer[at], depth = _pointers(key, np.zeros(len(at), dtype=np.int64)), 8
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        at = at[left[at] >= depth + step]
        shared = np.bincount(pointer[at], minlength=len(b) + 1)[pointer[at]] > 1
        # a bucket of one suffix keeps its pointer; others are sorted by the pointers ``step`` bytes on
        many = at[shared]
        new = pointer.copy()
        if len(many):
            pair = (pointer[many].astype(np.uint64) << np.uint64(32)) | pointer[many + step].astype(np.uint64)
            new[many] = _pointers(pair, pointer[many])
        pointer, depth = new, depth + step
    return at, pointer[at]


def _pointers(key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Pointers of the suffixes sorted by (bucket, key), keys that begin with
    the bucket: the bucket's pointer plus the place of the first equal key in it.
    A bucket owns as many pointers as it has members, so none is given twice."""
    order = np.argsort(key, kind="stable")
    k, old, place = key[order], bucket[order], np.arange(len(key))
    equal = np.maximum.accumulate(np.where(np.concatenate([[True], k[1:] != k[:-1]]), place, 0))
    begin = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), place, 0))
    out = np.empty(len(key), dtype=np.int64)
    out[order] = old + equal - begin
    return out


def refine(strings: DataFrame) -> DataFrame:
    """id, g, f, mask: covered windows of the open runs, a bit each."""
    def sort(key, table):
        ids, g, f = (np.asarray(table.column(c).combine_chunks()) for c in ("id", "g", "f"))
        k = np.asarray(table.column("k").combine_chunks()).astype(np.int64)
        b, off = _bytes_of(table.column("bytes").combine_chunks())
        at, bucket = equal_windows(b, off)
        string = np.searchsorted(off, at, side="right") - 1
        owner = ids[string]
        order, new = _first_of(bucket, owner)
        least = owner[order][new][np.cumsum(new) - 1] if len(order) else owner
        hit = order[owner[order] > least]
        bit = np.left_shift(np.int64(1), at[hit] - off[string[hit]] + k[string[hit]])
        mask = np.zeros(len(ids), dtype=np.int64)
        np.bitwise_or.at(mask, string[hit], bit)
        use = mask != 0
        return pa.Table.from_arrays([pa.array(x[use]) for x in (ids, g, f, mask)], names=["id", "g", "f", "mask"])

    return strings.groupBy("part").applyInArrow(sort, "id long, g long, f long, mask long")


def cut_out(docs: DataFrame, covered: DataFrame) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (the bytes left) of every row."""
    def cut(batches):
        for batch in batches:
            for piece in slices(batch, "text", PIECE):
                b, off = _bytes_of(piece.column(1))
                row, cg, cf, mask = _flat(piece.column(2))
                gone = np.zeros(len(b) + 1, dtype=np.int64)
                if len(row):
                    g, f, text, start, windows = runs(b, off)
                    found, order, name = _lookup(text, g, f, (row, cg, cf))
                    # windows of one run may come in several rows
                    name = name[order]
                    begin = np.concatenate([[True], name[1:] != name[:-1]])
                    whole = np.bitwise_or.reduceat(mask[order], np.flatnonzero(begin))[np.cumsum(begin) - 1]
                    bits = np.zeros(len(mask), dtype=np.int64)
                    bits[order] = whole
                    held = np.flatnonzero(found >= 0)
                    for w in range(RUN):
                        hit = held[(bits[found[held]] >> w & 1).astype(bool) & (windows[held] > w)]
                        np.add.at(gone, start[hit] + w, 1)
                        np.add.at(gone, start[hit] + w + LENGTH, -1)
                lost = np.cumsum(gone[:-1]) > 0
                upto = np.concatenate([[0], np.cumsum(lost)])
                first = lost & ~np.concatenate([[False], lost[:-1]])[: len(lost)]
                first[off[:-1][off[:-1] < len(b)]] |= lost[off[:-1][off[:-1] < len(b)]]
                spans = np.concatenate([[0], np.cumsum(first)])
                kept = [b[s:e][~lost[s:e]].tobytes() for s, e in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(off)), pa.array(upto[off[1:]] - upto[off[:-1]]), pa.array(spans[off[1:]] - spans[off[:-1]]), pa.array(kept, type=pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    held = covered.groupBy("id").agg(F.collect_list(F.struct("g", "f", "mask")).alias("windows"))
    none = F.lit(None).cast(held.schema["windows"].dataType).alias("windows")
    rows = docs.filter("id IS NOT NULL").join(held, "id", "left").select("id", "text", "windows")
    rows = rows.unionByName(docs.filter("id IS NULL").select("id", "text", none))
    return rows.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def hot_buckets(docs: DataFrame) -> np.ndarray:
    """Buckets whose runs in every SAMPLE-th document stand for more than GROUP
    bytes of names: at most one in ``GROUP / (24 * SAMPLE)`` of the runs there."""
    def counted(batches):
        for batch in batches:
            for piece in slices(batch, "text", PIECE):
                g, n = np.unique(runs(*_bytes_of(piece.column(0)))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(g), pa.array(n)], names=["g", "n"])

    some = docs.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(counted, "g long, n long")
    many = some.groupBy("g").agg(F.sum("n").alias("n")).filter(F.col("n") > GROUP // (24 * SAMPLE))
    return np.array([r["g"] for r in many.select("g").collect()], dtype=np.int64).view(np.uint64)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (bytes) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    known = rows.filter("id IS NOT NULL")
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    hot = hot_buckets(known)
    parts = max(4 * n_parts, 2 * size // GROUP)  # 24 bytes of names for 16 bytes of text
    met = staged(classes(run_names(known, hot, parts), hot), "runs")
    opened = met.filter("open").select("id", "g", "f")
    parts = max(4 * n_parts, opened.count() * 2 * (LENGTH + RUN) // OPEN_GROUP)
    refined = staged(refine(open_strings(known, opened, hot, parts)), "open-runs")
    whole = met.filter("NOT open").select("id", "g", "f", F.lit((1 << RUN) - 1).cast("long").alias("mask"))
    return cut_out(rows, whole.unionByName(refined))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """cut_repeats with the SHA-256 of the bytes left instead of them."""
    return cut_repeats(docs, id_col, text_col).select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

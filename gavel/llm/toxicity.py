"""Toxicity by class-conditional Kneser-Ney models of word pairs.

Each class c (toxic, ordinary) has an interpolated Kneser-Ney model of the words
of a text in their order, repeats included; the first word follows the empty
word::

    P(w | v, c) = max(n(c, v w) - D2(c), 0) / n(c, v) + D2(c) * N(c, v .) / n(c, v) * P(w | c)
    P(w | c)    = max(N(c, . w) - D1(c), 0) / N(c, . .) + D1(c) * W(c) / N(c, . .) * P(w)

n counts pairs, N(c, v .) different words after v, N(c, . w) different words
before w (the continuation counts), N(c, . .) different pairs, W(c) words with a
continuation; after an unknown v, P(w | v, c) is P(w | c). The discounts are
n1 / (n1 + 2 n2) of the counts of each order. P(w) is shared by the classes: their
continuation counts, plus a uniform part for unseen words.

Every labelled row of folds 1 to 4 (crc32 of the id mod 5) counts. Texts are
packed into runs of about ``PACK`` words, the words as 64-bit hashes (two of a
billion different words share one with a chance of 3 %, and then only those
share counts). A pack sends its different pairs, with its counts of them, to
their hash range; the range adds up and sends the sums back (``summed_back``).
Words and their continuation counts go the same way. The tables grow with the
corpus and stay on the executors; no task holds more than a pack or a range.

A text's score sums log P(w | v, toxic) - log P(w | v, ordinary) over its words,
each weighted by z^4 / (z^4 + s^2): nothing is left out, and ratios that are
sampling noise fade. z is the evidence of documents (a word that one document
repeats is one piece of it): how far the classes' numbers of documents with w are
from the classes' sizes, or those with v w from those with w, in standard errors,
the larger. A logistic curve of the sum a word (length-normalised), the sum over the
root of the number of words, and the length class gives 0..1. The shrinkage s (of
``SHRINK``) and the curve are fitted on the labelled rows of folds 1 to 4, each
scored by counts without its own fold.

Defined cases: a null or empty text scores as the base rate of its length
class; no labelled rows, or one class only, gives that rate for every text;
repeated labels of one id count once (the largest).
"""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm import common
from gavel.llm.common import by_value, discard, id_crc, release_memory, release_shuffles, staged, text_of

by_value(sys.modules[__name__])
by_value(common)

PACK = 3 << 19
#: Words a hash range, and ranges at least.
RANGE, RANGES = 3 << 19, 16
#: More than RANGES ranges go in so many rounds, whose shuffles do not lie on disk at
#: the same time.
ROUNDS = 6
SHRINK = (0.0, 4.0, 16.0, 64.0)
BINS, LENGTHS = 2000, 24
FOLDS = (1, 2, 3, 4)
#: Kinds of a labelled document: class (toxic, ordinary) and fold.
KINDS = 2 * len(FOLDS)
#: Rows of a pair's statistics: documents by kind, and its repeats within them.
PAIR_STATS = 2 * KINDS
#: Rows of a word's statistics. As a first word: pairs by kind, different pairs by
#: class, those of one fold only by kind; as a second word: the latter two. Then
#: its documents by kind.
AFTER, SECOND, HOLDING = KINDS, 2 * KINDS + 2, 3 * KINDS + 4
WORD_STATS = HOLDING + KINDS
ASKED = "pack long, range int, keys binary, numbers binary"
REPLY = "pack long, range int, keys long, numbers binary, tally array<long>"


def word_runs(text: Column) -> Column:
    """The words (runs of letters and digits, lower-cased) in their order, after
    the empty word; another empty one may follow."""
    return F.split(F.concat(F.lit(" "), F.lower(text)), "[^\\p{L}\\p{N}]+")


def _planes(x, width: int) -> bytes:
    """Numbers as byte planes: high bytes are mostly zero and compress away."""
    return np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _numbers(blob, width: int):
    return np.ascontiguousarray(np.frombuffer(blob, dtype=np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def _small(blob: bytes) -> bytes:
    return len(blob).to_bytes(8, "little") + pa.compress(blob, codec="zstd", asbytes=True)


def _whole(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _pack(key: int, held: list) -> pa.RecordBatch:
    ids = pa.concat_arrays([x for x, _ in held])
    lists = [x for _, x in held]
    size = np.concatenate([np.asarray(pc.list_value_length(x)) for x in lists]).astype(np.int64)
    coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    at = np.asarray(coded.indices).astype(np.int64)
    # what is empty after the last word is none
    last = np.cumsum(size) - 1
    last = last[(size > 1) & (at[last] == at[0])]
    at, size = np.delete(at, last), (size - np.bincount(np.repeat(np.arange(len(size)), size)[last], minlength=len(size))).astype(np.int32)
    # frequent words first, so that places are small
    often = np.argsort(-np.bincount(at, minlength=len(coded.dictionary)), kind="stable")
    place = np.empty(len(often), dtype=np.int64)
    place[often] = np.arange(len(often))
    hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), one(ids), one(pa.array(size)), one(pa.array(hashes[often].view(np.int64))), pa.array([_small(_planes(place[at], 4))], pa.binary())], names=["key", "ids", "sizes", "words", "places"])


def packs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, ids, sizes, words, places: runs of documents of about PACK words (one
    document at least). ``places`` are the places of all words in ``words``."""
    src = docs.select(F.col(id_col).alias("id"), word_runs(text_of(text_col)).alias("words"))

    def run(batches):
        key, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            size = np.cumsum(np.asarray(pc.list_value_length(batch.column(1)), dtype=np.int64))
            lo = 0
            while lo < batch.num_rows:
                base = size[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(size, base + PACK - n, side="right")))
                held.append((batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)))
                n, lo = n + int(size[hi - 1] - base), hi
                if n >= PACK or hi < batch.num_rows:
                    yield _pack(key, held)
                    key, held, n = key + 1, [], 0
        if held:
            yield _pack(key, held)
        held = []
        release_memory()

    return src.mapInArrow(run, f"key long, ids array<{src.schema['id'].dataType.simpleString()}>, sizes array<int>, words array<long>, places binary")


def said_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """label_id, kind of the labelled ids outside fold 0."""
    said = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    fold = (id_crc("label_id") % 5).cast("int")
    return said.withColumn("fold", fold).filter("fold != 0").select("label_id", (F.when(F.col("toxic") == 1, 0).otherwise(len(FOLDS)) + F.col("fold") - 1).alias("kind"))


def marked(packed: DataFrame, said: DataFrame) -> DataFrame:
    """The packs with the kinds of their documents (-1: not labelled)."""
    ids = packed.select("key", F.posexplode("ids").alias("doc", "id"))
    # both sides grow with the corpus: a sort-merge join at every size
    marks = ids.join(said.hint("merge"), F.col("id") == F.col("label_id")).select(F.col("key").alias("pack"), "doc", "kind")

    def run(pack, marks):
        kind = np.full(len(pack.column("sizes")[0]), -1, dtype=np.int32)
        kind[marks.column("doc").to_numpy()] = marks.column("kind").to_numpy()
        return pack.append_column("kinds", pa.array([kind], pa.list_(pa.int32())))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema) + ", kinds array<int>"
    return packed.groupBy("key").cogroup(marks.groupBy("pack")).applyInArrow(run, kinds)


class Pairs:
    """The word pairs of a pack: the document and the pair of every word but the
    empty ones, and hash, first and second word (places) of the different pairs,
    by hash."""

    def __init__(self, pack):
        flat = lambda c: np.asarray(pack.column(c).combine_chunks().flatten())
        self.words, self.kind = flat("words").astype(np.int64).view(np.uint64), flat("kinds").astype(np.int64)
        self.size = flat("sizes").astype(np.int64)
        at = _numbers(_whole(pack.column("places")[0].as_py()), 4).astype(np.int64)
        begins = np.zeros(len(at), dtype=bool)
        begins[np.cumsum(self.size) - self.size] = True
        second = np.flatnonzero(~begins)
        self.doc = np.repeat(np.arange(len(self.size)), self.size - 1)
        a, b = at[second - 1], at[second]
        mixed = self.words[a] * np.uint64(0x9E3779B97F4A7C15) + self.words[b]
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        self.keys, first, pair = np.unique(mixed ^ (mixed >> np.uint64(31)), return_index=True, return_inverse=True)
        self.pair, self.first, self.second = pair.ravel(), a[first], b[first]


    def within(self, ranges: int, some: range):
        """Without the pairs of other ranges."""
        lo, hi = np.searchsorted(_range_of(self.keys, ranges), (some.start, some.stop))
        held = (self.pair >= lo) & (self.pair < hi)
        self.keys, self.doc, self.pair = self.keys[lo:hi], self.doc[held], self.pair[held] - lo
        return self


def _range_of(keys, ranges: int):
    return ((keys >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)


def _sparse(code, n) -> bytes:
    """Numbers n by place * 256 + col."""
    return _small(_planes(np.diff(code >> 8, prepend=0), 4) + (code & 255).astype(np.uint8).tobytes() + _planes(n, 8))


def _dense(blob: bytes) -> tuple:
    """place, col, n."""
    x = np.frombuffer(_whole(blob), dtype=np.uint8)
    rows = len(x) // 13
    return np.cumsum(_numbers(x[: 4 * rows], 4).astype(np.int64)), x[4 * rows : 5 * rows].astype(np.int64), _numbers(x[5 * rows :], 8).astype(np.int64)


def _asked(key: int, keys, code, n, ranges: int) -> list:
    """A pack's ascending keys and their numbers (by place * 256 + col), cut into
    hash ranges: the columns of ASKED."""
    bounds = np.searchsorted(_range_of(keys, ranges), np.arange(ranges + 1))
    inner = np.searchsorted(code, bounds << 8)
    rows = [(key, r, _small(_planes(np.diff(keys[lo:hi], prepend=np.uint64(0)), 8)), _sparse(code[i:j] - (lo << 8), n[i:j])) for r, (lo, hi, i, j) in enumerate(zip(bounds[:-1], bounds[1:], inner[:-1], inner[1:], strict=True)) if hi > lo]
    return [pa.array([x[i] for x in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))]


def summed_back(asked: DataFrame, cols: int, tally) -> DataFrame:
    """For every pack and range: the sums over all packs of the numbers of the
    pack's keys; col ``cols`` marks a key in the first pack that has it. ``keys`` is
    their number. A range's first row holds ``tally`` of its sums (cols x keys)."""

    def run(table):
        table = table.sort_by("pack")
        keys = [np.cumsum(_numbers(_whole(x.as_py()), 8), dtype=np.uint64) for x in table.column("keys")]
        end = np.cumsum([len(x) for x in keys])
        known, first, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        which, total = which.ravel(), np.zeros(cols * len(known), dtype=np.int64)
        for i, hi in enumerate(end):
            place, col, n = _dense(table.column("numbers")[i].as_py())
            np.add.at(total, col * len(known) + which[hi - len(keys[i]) :][place], n)
        total = total.reshape(cols, -1)
        own = np.zeros(len(which), dtype=bool)
        own[first[total.any(axis=0)]] = True
        rows = []
        for i, hi in enumerate(end):
            lo = hi - len(keys[i])
            mine = np.concatenate([total[:, which[lo:hi]], own[None, lo:hi]]).T
            place, col = np.nonzero(mine)
            rows.append((len(keys[i]), _sparse(place << 8 | col, mine[place, col]), [] if i else tally(total)))
        back = [pa.array([x[i] for x in rows], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.list_(pa.int64())))]
        release_memory()
        return pa.Table.from_arrays([table.column("pack"), table.column("range"), *back], names=["pack", "range", "keys", "numbers", "tally"])

    return asked.groupBy("range").applyInArrow(run, REPLY)


def _answer(back, cols: int, n: int):
    """cols + 1 x keys: what came back to a pack for its n keys."""
    back = back.sort_by("range")
    parts = [_dense(x.as_py()) for x in back.column("numbers")]
    small = all(value.max(initial=0) < 1 << 26 for *_, value in parts)
    found, at = np.zeros((cols + 1, n), dtype=np.int32 if small else np.int64), 0
    for size, (place, col, value) in zip(back.column("keys").to_pylist(), parts, strict=True):
        found[col, at + place] = value
        at += size
    return found


def _without(counts, c: int, out: int):
    """Sums over the folds but ``out`` (0: none) of counts by kind."""
    return sum(counts[c * len(FOLDS) + k - 1] for k in FOLDS if k != out)


def _different(stats, row: int, c: int, out: int):
    """Different pairs of class c without fold ``out``: all but those of it only."""
    return stats[row + c] - (stats[row + 2 + c * len(FOLDS) + out - 1] if out else 0)


def pair_tally(total) -> list:
    """For every left-out fold and class: pairs that occur, once, twice."""
    counts = total[:KINDS] + total[KINDS:]
    n = [_without(counts, c, out) for out in (0, *FOLDS) for c in (0, 1)]
    return [int(np.count_nonzero(hit)) for x in n for hit in (x > 0, x == 1, x == 2)]


def word_tally(total) -> list:
    """The same of continuation counts, and the words that have one."""
    n = [_different(total, SECOND, c, out) for out in (0, *FOLDS) for c in (0, 1)]
    return [int(np.count_nonzero(hit)) for x in n for hit in (x > 0, x == 1, x == 2)] + [int(np.count_nonzero(total[SECOND] + total[SECOND + 1]))]


def pairs_asked(packed: DataFrame, ranges: int, some: range) -> DataFrame:
    """The different pairs of every pack in ``some`` of the ranges, and its labelled
    documents' counts."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                release_memory()
                pack = pa.Table.from_batches([batch.slice(i, 1)])
                p = Pairs(pack).within(ranges, some)
                said = p.kind[p.doc] >= 0
                held, n = np.unique(p.doc[said] * len(p.keys) + p.pair[said], return_counts=True)
                code, which = np.unique(held % len(p.keys) << 8 | p.kind[held // len(p.keys)], return_inverse=True)
                docs = np.bincount(which, minlength=len(code))
                more = np.bincount(which, weights=n, minlength=len(code)).astype(np.int64) - docs
                code, n = np.concatenate([code, code[more > 0] + KINDS]), np.concatenate([docs, more[more > 0]])
                order = np.argsort(code, kind="stable")
                code, n = code[order], n[order]
                yield pa.RecordBatch.from_arrays(_asked(pack.column("key")[0].as_py(), p.keys, code, n, ranges), names=["pack", "range", "keys", "numbers"])

    return packed.mapInArrow(run, ASKED)


def words_asked(packed: DataFrame, pairs: DataFrame, ranges: int) -> DataFrame:
    """The words of every pack, and the statistics that its own pairs give them."""

    def run(pack, back):
        release_memory()
        p = Pairs(pack)
        found = _answer(back, PAIR_STATS, len(p.keys))
        own = np.flatnonzero(found[PAIR_STATS])
        found, sides = found[:KINDS, own] + found[KINDS:PAIR_STATS, own], (p.first[own], p.second[own])
        stats = np.zeros((WORD_STATS, len(p.words)), dtype=np.int64)
        sums = lambda side, x: np.bincount(sides[side], weights=x, minlength=len(p.words)).astype(np.int64)
        for c in (0, 1):
            n = _without(found, c, 0)
            for side, row in ((0, AFTER), (1, SECOND)):
                stats[row + c] = sums(side, n > 0)
            for k in range(c * len(FOLDS), (c + 1) * len(FOLDS)):
                stats[k] = sums(0, found[k])
                for side, row in ((0, AFTER), (1, SECOND)):
                    stats[row + 2 + k] = sums(side, (n > 0) & (n == found[k]))
        said = p.kind[p.doc] >= 0
        held = np.unique(p.doc[said] * len(p.words) + p.second[p.pair[said]])
        np.add.at(stats, (HOLDING + p.kind[held // len(p.words)], held % len(p.words)), 1)
        order = np.argsort(p.words)
        place, col = np.nonzero(stats[:, order].T)
        return pa.Table.from_arrays(_asked(pack.column("key")[0].as_py(), p.words[order], place << 8 | col, stats[col, order[place]], ranges), names=["pack", "range", "keys", "numbers"])

    return packed.groupBy("key").cogroup(pairs.groupBy("pack")).applyInArrow(run, ASKED)


def class_totals(packed: DataFrame, pairs: DataFrame, words: DataFrame) -> dict:
    """The tallies of all ranges: (order, left-out fold, class) -> occurring, once,
    twice; the words with a continuation; order 0: labelled documents."""
    n = {r["kind"]: r["n"] for r in packed.select(F.explode("kinds").alias("kind")).filter("kind >= 0").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # KINDS rows
    totals = {(0, out, c): _without([n.get(k, 0) for k in range(KINDS)], c, out) for out in (0, *FOLDS) for c in (0, 1)}
    for order, back in ((2, pairs), (1, words)):
        got = {r["i"]: r["n"] for r in back.select(F.posexplode("tally").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()}  # 31 rows
        for j, (out, c) in enumerate((out, c) for out in (0, *FOLDS) for c in (0, 1)):
            totals[order, out, c] = tuple(got.get(3 * j + i, 0) for i in range(3))
        totals["words"] = got.get(30, 0)
    return totals


def _discount(tallies: tuple) -> float:
    return tallies[1] / (tallies[1] + 2 * tallies[2]) if tallies[1] else 0.5


def log_ratios(found, first, second, totals: dict, out: int):
    """log P(w | v, toxic) - log P(w | v, ordinary) of pairs v w without fold ``out``.
    ``found``: statistics of the pairs; ``first``, ``second``: of their words."""
    before = [_different(second, SECOND, c, out) for c in (0, 1)]
    # one place more for the words never seen
    shared = (before[0] + before[1] + 0.5) / (totals[2, out, 0][0] + totals[2, out, 1][0] + 0.5 * (totals["words"] + 1))
    ratio = 0.0
    for c, sign in ((0, 1), (1, -1)):
        drop, different = _discount(totals[1, out, c]), totals[2, out, c][0]
        word = (before[c] - np.minimum(before[c], drop) + drop * totals[1, out, c][0] * shared) / different
        drop = _discount(totals[2, out, c])
        n, after = _without(found[:KINDS] + found[KINDS:PAIR_STATS], c, out), _without(first, c, out)
        pair = (n - np.minimum(n, drop) + drop * _different(first, AFTER, c, out) * word) / np.maximum(after, 1)
        ratio = ratio + sign * np.log(np.where(after > 0, pair, word))
    return ratio


def _evidence(docs: list, share: list):
    """z^4 of the classes' numbers of documents against their expected shares, with
    one document more that is split by them."""
    a, b = docs[0] + share[0], docs[1] + share[1]
    ratio = np.log(a / b) - np.log(share[0] / share[1])
    return (ratio * ratio / (1 / a + 1 / b)) ** 2


def fit_curve(a, label, weight) -> np.ndarray:
    """Logistic weights of the columns of ``a``, the first of ones, by Newton's
    method on weighted rows, with a small ridge."""
    w = np.zeros(a.shape[1])
    ridge = np.array([1e-6, *[1e-3] * (a.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (label - p)) - ridge * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def weights(found, first, second, totals: dict, out: int) -> list:
    """Shrunk log ratios of pairs, one array a value of SHRINK."""
    docs = [totals[0, out, c] for c in (0, 1)]
    if not all(totals[2, out, c][0] and docs[c] for c in (0, 1)):
        return [np.zeros(found.shape[1])] * len(SHRINK)
    share = [x / sum(docs) for x in docs]
    word = [_without(second[HOLDING:], c, out) for c in (0, 1)]
    own = [(x + part) / (word[0] + word[1] + 1) for x, part in zip(word, share, strict=True)]
    z4 = np.maximum(_evidence(word, share), _evidence([_without(found, c, out) for c in (0, 1)], own))
    ratio = log_ratios(found, first, second, totals, out)
    return [ratio * z4 / (z4 + s * s) if s else ratio for s in SHRINK]


def scored(packed: DataFrame, pairs: DataFrame, words: DataFrame, totals: dict) -> DataFrame:
    """id, words, kind, whole and crossed (sums of weights by SHRINK, from all counts
    and from those without a labelled document's fold) of every whole text."""
    back = pairs.drop("tally").withColumn("single", F.lit(False)).unionByName(words.drop("tally").withColumn("single", F.lit(True)))
    kind = packed.schema["ids"].dataType.elementType.simpleString()

    def run(pack, back):
        release_memory()
        p = Pairs(pack)
        ids = pack.column("ids").combine_chunks().flatten()
        found = _answer(back.filter(pc.invert(back.column("single"))), PAIR_STATS, len(p.keys))
        stats = np.empty((WORD_STATS, len(p.words)), dtype=np.int64)
        stats[:, np.argsort(p.words)] = _answer(back.filter(back.column("single")), WORD_STATS, len(p.words))[:WORD_STATS]

        def sums(out, at):
            """Sums of the documents whose words are at ``at``."""
            used, pair = np.unique(p.pair[at], return_inverse=True)
            got = np.zeros((len(SHRINK), len(p.size)))
            step = 1 << 16
            held = np.empty((len(SHRINK), len(used)))
            for lo in range(0, len(used), step):
                some = used[lo : lo + step]
                held[:, lo : lo + step] = weights(found[:, some].astype(np.int64), stats[:, p.first[some]], stats[:, p.second[some]], totals, out)
            for i in range(len(SHRINK)):
                got[i] = np.bincount(p.doc[at], weights=held[i][pair.ravel()], minlength=len(p.size))
            return got.T

        whole = sums(0, np.arange(len(p.pair)))
        crossed, fold = whole.copy(), np.where(p.kind < 0, 0, p.kind % len(FOLDS) + 1)
        for k in FOLDS:
            if (fold == k).any():
                crossed[fold == k] = sums(k, np.flatnonzero(fold[p.doc] == k))[fold == k]
        rows = pa.array(np.arange(len(p.size) + 1, dtype=np.int32) * len(SHRINK))
        return pa.Table.from_arrays([ids, pa.array(p.size - 1), pa.array(p.kind), *[pa.ListArray.from_arrays(rows, pa.array(x.ravel())) for x in (whole, crossed)]], names=["id", "words", "kind", "whole", "crossed"])

    return packed.groupBy("key").cogroup(back.groupBy("pack")).applyInArrow(run, f"id {kind}, words long, kind long, whole array<double>, crossed array<double>")


def ratio_sums(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``scored`` of all documents by the models of the labelled ones."""
    bare = staged(packs(docs, id_col, text_col), "toxic-packs")
    packed = staged(marked(bare, said_labels(labels, id_col, label_col)), "toxic-marked")
    discard(bare)
    n = packed.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    ranges = max(RANGES, -(-n // RANGE))
    rounds = ROUNDS if ranges > RANGES else 1
    spark = docs.sparkSession

    def in_rounds(name: str, one) -> tuple[DataFrame, list]:
        tables = []
        for i in range(rounds):
            tables.append(staged(one(i), name))
            release_shuffles(spark)
        return reduce(DataFrame.unionByName, tables), tables

    def of_round(i: int, *tables) -> list:
        return [t.filter(F.pmod(F.xxhash64(key), F.lit(rounds)) == i) for t, key in zip(tables, ("key", "pack", "pack"), strict=False)]

    pairs, held = in_rounds("toxic-pairs", lambda i: summed_back(pairs_asked(packed, ranges, range(ranges * i // rounds, ranges * (i + 1) // rounds)), PAIR_STATS, pair_tally))
    asked, parts = in_rounds("toxic-asked", lambda i: words_asked(*of_round(i, packed, pairs), ranges))
    words = staged(summed_back(asked, WORD_STATS, word_tally), "toxic-words")
    discard(*parts)
    totals = class_totals(packed, pairs, words)
    sums, _ = in_rounds("toxic-sums", lambda i: scored(*of_round(i, packed, pairs, words), totals))
    discard(packed, words, *held)
    return sums


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id, held_out, score, predicted of every row."""
    sums = ratio_sums(docs, labels, id_col, text_col, label_col)
    words = F.greatest("words", F.lit(1)).cast("double")
    size = F.least(F.log2(F.col("words") + F.lit(1.0)), F.lit(float(LENGTHS - 1)))
    rows = sums.filter("kind >= 0").select(size.alias("size"), words.alias("words"), (F.col("kind") < len(FOLDS)).cast("int").alias("toxic"), F.posexplode("crossed").alias("s", "total"))
    mean, root = F.col("total") / F.col("words"), F.col("total") / F.sqrt("words")
    bins = rows.groupBy("s", F.round(F.least(F.greatest(root, F.lit(-20.0)), F.lit(20.0)) * (BINS / 40.0)).cast("int").alias("bin"), F.round("size").cast("int").alias("class")).agg(F.avg(mean).alias("mean"), F.avg(root).alias("root"), F.avg("size").alias("size"), F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).toPandas()  # SHRINK x BINS x LENGTHS rows at most
    best, w = 0, np.zeros(4)
    least = np.inf
    for s, part in bins.groupby("s"):
        part = part.sort_values(["bin", "class"])
        a = np.column_stack([np.ones(len(part)), *[part[c].to_numpy(float) for c in ("mean", "root", "size")]])
        pos, n = (part[c].to_numpy(float) for c in ("toxic", "n"))
        got = fit_curve(np.r_[a, a], np.r_[np.ones(len(a)), np.zeros(len(a))], np.r_[pos, n - pos])
        y = np.clip(a @ got, -30, 30)
        loss = (pos * np.log1p(np.exp(-y)) + (n - pos) * np.log1p(np.exp(y))).sum()
        if loss < least:
            least, best, w = loss, int(s), got
    total = F.element_at("whole", best + 1)
    logit = F.lit(float(w[0]))
    for weight, x in zip(w[1:], (total / words, total / F.sqrt(words), size), strict=True):
        logit = logit + F.lit(float(weight)) * x
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0))))
    return sums.select(F.col("id").alias(id_col), (id_crc("id") % 5 == 0).alias("held_out"), p.alias("score"), (p >= 0.5).cast("int").alias("predicted"))

"""Token-id files with Simple-8b word-aligned coding.

A file set is a Parquet folder whose rows are blocks; Spark's committer makes
the write whole or absent, and any store Spark reaches will do. Rows are range
partitioned and sorted by document id, so part, block and document numbers
follow ascending ids. A block holds whole documents (about ``BLOCK`` ids, or one
longer document) and these fields:

- ``part``, ``block``, ``before`` (ids of earlier blocks of the part), ``n_ids``;
- ``docs`` and ``lens`` (document ids and their numbers of ids);
- ``words``: little-endian 64-bit words. The top 4 bits select how the low 60
  bits are divided: ``BITS[s]`` bits for each of ``COUNTS[s]`` ids, first id
  lowest. Selector 15 is the escape: the next word is one raw 64-bit id;
- ``lanes``: the first word of every lane of ``LANE`` ids, so that lanes are
  coded and decoded side by side.

Defined cases: a null or empty text has only the end id; null ids come first;
rows with the same id follow the hash of their text; an empty table writes an
empty file set.
"""

from __future__ import annotations

import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavel.llm import byte_bpe, common, encode, word_hash
from gavel.llm.byte_bpe import byte_characters
from gavel.llm.common import by_value, slices, text_of, worker_memory
from gavel.llm.encode import CHUNK, Pieces, encode_texts, lower_words, ragged
from gavel.session import shared_path

by_value(sys.modules[__name__])
by_value(common)
by_value(encode)
by_value(word_hash)
by_value(byte_bpe)

#: Fixed values of the code: ids in a word and bits of an id, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
ESCAPE = 15
LANE = 512
BLOCK = 1 << 16
#: Pieces that the word tokenizer's normaliser and splitter leave unchanged.
PLAIN = "[a-zà-öø-ÿ]+"


def pack(ids) -> tuple[np.ndarray, np.ndarray]:
    """Words and lane starts of an array of ids."""
    ids = np.asarray(ids).astype(np.uint64)
    n = len(ids)
    lanes = -(-n // LANE)
    if not lanes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    grid = np.zeros((lanes, LANE + 60), dtype=np.uint64)  # the margin reads as zeros
    whole, rest = divmod(n, LANE)
    grid[:whole, :LANE] = ids[: whole * LANE].reshape(-1, LANE)
    grid[whole:, :rest] = ids[whole * LANE :]
    own = grid[:, :LANE]
    need = np.frexp(np.minimum(own, np.uint64(1 << 52)).astype(np.float64))[1].astype(np.uint8)
    if own.max() >= 1 << 52:
        need[own >= np.uint64(1 << 52)] = 60
        need[own >= np.uint64(1 << 60)] = 64
    # widest[c][lane, i]: bits that ids i .. i+c-1 of a lane need
    widest = {1: need}
    for c in sorted(set(COUNTS.tolist()) - {1}):
        a = max(widest)
        out, at = widest[a].copy(), a
        while at < c:
            b = max(x for x in widest if x <= max(c - at, 1))
            np.maximum(out[:, :-at], widest[b][:, at:], out=out[:, :-at])
            at += b
        widest[c] = out
    choice = np.full((lanes, LANE), ESCAPE, dtype=np.uint8)
    for s in range(len(COUNTS) - 1, -1, -1):
        choice[widest[int(COUNTS[s])] <= BITS[s]] = s
    choice = choice.reshape(-1)
    step = np.ones(16, dtype=np.int64)
    step[: len(COUNTS)] = COUNTS
    at, end = np.arange(lanes) * LANE, np.minimum(np.arange(1, lanes + 1) * LANE, n)
    head = np.zeros(lanes * LANE, dtype=bool)
    while len(at):  # all lanes advance together, one word a turn
        head[at] = True
        at = at + step[choice[at]]
        on = at < end
        at, end = at[on], end[on]
    at = np.flatnonzero(head)
    lane = at // LANE
    sel = choice[at].astype(np.int64)
    wide = 1 + (sel == ESCAPE)
    place = np.cumsum(wide) - wide
    words = np.zeros(int(wide.sum()), dtype=np.uint64)
    flat = grid.reshape(-1)
    of_grid = at + lane * 60
    for s in range(len(COUNTS)):
        of = np.flatnonzero(sel == s)
        if len(of):
            word = np.full(len(of), s << 60, dtype=np.uint64)
            for j in range(int(COUNTS[s])):
                word |= flat[of_grid[of] + j] << np.uint64(j * BITS[s])
            words[place[of]] = word
    of = np.flatnonzero(sel == ESCAPE)
    words[place[of]] = np.uint64(ESCAPE << 60)
    words[place[of] + 1] = flat[of_grid[of]]
    return words, place[np.searchsorted(lane, np.arange(lanes))]


def unpack(words, lanes, n: int) -> np.ndarray:
    """The n ids (unsigned 64-bit) of packed words."""
    words, lanes = np.asarray(words, dtype=np.uint64), np.asarray(lanes, dtype=np.int64)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    if (sel == ESCAPE).any():
        # walk the lanes side by side: a raw word may look like an escape
        at, end = lanes.copy(), np.append(lanes[1:], len(words))
        while len(at):
            esc = sel[at] == ESCAPE
            raw[at[esc] + 1] = True
            at = at + 1 + esc
            on = at < end
            at, end = at[on], end[on]
    heads = np.flatnonzero(~raw)
    sel = sel[heads]
    count = np.ones(16, dtype=np.int64)
    count[: len(COUNTS)] = COUNTS
    took = count[sel]
    lane = np.searchsorted(lanes, heads, side="right") - 1
    before = np.cumsum(took) - took
    inside = before - before[np.searchsorted(heads, lanes)][lane]
    width = LANE + 60
    out = np.zeros((len(lanes), width), dtype=np.uint64).reshape(-1)
    to = lane * width + inside
    for s in range(len(COUNTS)):
        of = np.flatnonzero(sel == s)
        if len(of):
            c = np.arange(COUNTS[s])
            mask = np.uint64((1 << int(BITS[s])) - 1)
            out[to[of][:, None] + c] = (words[heads[of]][:, None] >> (c.astype(np.uint64) * np.uint64(BITS[s]))) & mask
    of = np.flatnonzero(sel == ESCAPE)
    out[to[of]] = words[heads[of] + 1]
    return out.reshape(len(lanes), width)[:, :LANE].reshape(-1)[:n]


def special_pattern(tok) -> str:
    """Matches texts that hold the string of an added token, in any case."""
    import re

    return "|".join("(?i:" + re.escape(t.content) + ")" for t in tok.get_added_tokens_decoder().values())


def _worker(path: str, split_special: bool) -> tuple[Pieces, str]:
    memory = worker_memory()
    key = f"{path} {split_special}"
    if key not in memory:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = split_special
        memory[key] = Pieces(tok, PLAIN, byte_characters()), special_pattern(tok)
    return memory[key]


BLOCKS = "part int, block int, before long, n_ids long, docs array<long>, lens array<long>, words binary, lanes binary"


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", split_special: bool = False) -> None:
    """Encode every whole text, append ``end_id``, write the file set. The string
    of a special token within a text gives that token's id, as in the library's
    plain call; with ``split_special`` it is ordinary text."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = src.repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h").select("id", "t")

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        memo, special = _worker(tokenizer_path, split_special)
        part, block, before = TaskContext.get().partitionId(), 0, 0
        held: list = []  # (document ids, lens, ids) not yet written

        def flush():
            nonlocal block, before, held
            ids = np.concatenate([x[2] for x in held])
            words, lanes = pack(ids)
            row = {"part": part, "block": block, "before": before, "n_ids": len(ids), "docs": [d for x in held for d in x[0]], "lens": np.concatenate([x[1] for x in held]).tolist(), "words": words.astype("<u8").tobytes(), "lanes": lanes.astype("<i8").tobytes()}
            block, before, held = block + 1, before + len(ids), []
            return row

        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("words", pa.binary()), ("lanes", pa.binary())])
        for batch in batches:
            for piece in slices(batch, "t", CHUNK):
                flat, lens = encode_texts(memo, piece.column(1), lambda t: lower_words(t, special))
                ends = np.cumsum(lens + 1)
                ids = np.full(int(ends[-1]) if len(ends) else 0, end_id, dtype=np.uint64)
                ids[ragged(ends - lens - 1, lens)] = flat
                names, a = piece.column(0).to_pylist(), 0
                rows = []
                while a < len(lens):
                    room = BLOCK - sum(len(x[2]) for x in held)
                    base = int(ends[a] - lens[a] - 1)
                    b = max(a + 1, int(np.searchsorted(ends, base + room, side="right")))
                    held.append((names[a:b], lens[a:b] + 1, ids[base : int(ends[b - 1])]))
                    if sum(len(x[2]) for x in held) >= BLOCK or b < len(lens):
                        rows.append(flush())
                    a = b
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([flush()], schema=schema)

    src.mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``, the ids in all earlier blocks."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a part: as many as the writing job had tasks
    first = sizes.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("part_start"))
    return blocks.join(F.broadcast(first), "part").withColumn("start", F.col("part_start") + F.col("before")).drop("part_start")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (array of long) of every document."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["lanes"], "<i8"), row["n_ids"]).astype(np.int64)
                at = np.concatenate([[0], np.cumsum(row["lens"], dtype=np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(row["docs"], pa.int64()), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    return spark.read.schema(BLOCKS).parquet(path).select("docs", "lens", "n_ids", "words", "lanes").mapInArrow(run, "doc_id long, ids array<long>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""

    def run(batches):
        import zlib

        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["lanes"], "<i8"), row["n_ids"])
                raw = memoryview(ids.astype("<u4").tobytes())
                lens = np.asarray(row["lens"], dtype=np.int64)
                at = np.concatenate([[0], np.cumsum(lens)])
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(row["docs"], pa.int64()), pa.array(row["start"] + at[:-1]), pa.array(lens), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_blocks(spark, path).select("docs", "lens", "n_ids", "words", "lanes", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_path(spark: SparkSession) -> str:
    return shared_path(spark, "llm", f"token-files-{uuid.uuid4().hex}")

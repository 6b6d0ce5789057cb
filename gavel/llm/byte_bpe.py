"""Byte-level BPE encoding and decoding with the ``tokenizers`` library.

A rank file is turned into a byte-level BPE model: bytes map to printable
characters, and every split of a token into two tokens is a merge with the
token's rank; a piece that is itself a token is not merged further. Texts
are read as Arrow batches. Decoding reverses the byte table; bytes of a
character may be split over tokens, so offsets are counted in characters from
the byte lengths.

Defined cases: a null or empty text has no ids and decodes to no bytes;
repeated rows are encoded alike; extra columns may have any name (they travel
in the struct ``row``).
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from gavel.llm import common, encode, word_hash
from gavel.llm.common import by_value, slices, text_of, worker_memory
from gavel.llm.encode import CHUNK, Pieces, before_spaces, encode_texts, ragged

by_value(sys.modules[__name__])
by_value(common)
by_value(encode)
by_value(word_hash)


def byte_characters() -> list[str]:
    """The byte table of byte-level BPE: printable Latin-1 bytes stand for
    themselves, the others for the characters from 256 on."""
    plain = {b for lo, hi in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(lo), ord(hi) + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def build(ranks: dict[bytes, int], pattern: str):
    """A ``tokenizers`` model equal to merging by lowest rank."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    char = byte_characters()
    name = {t: "".join(char[b] for b in t) for t in ranks}
    merges = [(name[t[:i]], name[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    tok = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok


class Table:
    """Bytes of each id, flat."""

    def __init__(self, ranks: dict[bytes, int]):
        top = max(ranks.values(), default=-1) + 1
        by_id = [b""] * top
        for t, r in ranks.items():
            by_id[r] = t
        self.size = np.fromiter(map(len, by_id), dtype=np.int64, count=top)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)

    def decode(self, ids) -> np.ndarray:
        return self.bytes[ragged(self.start[ids], self.size[ids])]

    def offsets(self, ids) -> np.ndarray:
        """Start of each id of one text, in characters. An id that starts
        within a character starts where that character does."""
        data = self.decode(ids)
        head = np.cumsum((data & 0xC0) != 0x80)
        first = np.cumsum(self.size[ids]) - self.size[ids]
        return (head[first] - 1).astype(np.int32) if len(ids) else np.zeros(0, dtype=np.int32)


def _worker(path: str, pattern: str):
    memory = worker_memory()
    if (path, pattern) not in memory:
        ranks = read_ranks(path)
        memory[path, pattern] = Pieces(build(ranks, pattern)), Table(ranks)
    return memory[path, pattern]


def encode_column(rows: DataFrame, path: str, pattern: str, text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``row`` (the input row), ``ids`` (array of int) and, if asked for,
    ``offsets`` (character start of each id) of every whole text."""
    return _encoded(rows, path, pattern, text_col, offsets, False)


def _encoded(rows, path, pattern, text_col, offsets, digest, id_col=None):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if id_col is None:  # the text travels within its row only
        whole = list(rows.columns)
        src = rows.select(F.struct(*[F.col(f"`{c}`") for c in whole]).alias("row"))
    else:
        whole, src = None, rows.select(F.col(id_col).alias("row"), text_of(text_col).alias("t"))
    fields = [StructField("row", src.schema["row"].dataType)]
    if digest:
        fields += [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    else:
        fields += [StructField("ids", ArrayType(IntegerType()))] + ([StructField("offsets", ArrayType(IntegerType()))] if offsets else [])
    names = [f.name for f in fields]

    def run(batches):
        import hashlib

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        memo, table = _worker(path, pattern)
        for batch in batches:
            if whole:
                text = batch.column(0).field(whole.index(text_col)).fill_null("")
                batch = pa.RecordBatch.from_arrays([batch.column(0), text], names=["row", "t"])
            for part in slices(batch, "t", CHUNK):
                flat, lens = encode_texts(memo, part.column(1), before_spaces)
                cut = np.concatenate([[0], np.cumsum(lens)])
                if digest:
                    raw = memoryview(flat.astype("<u4").tobytes())
                    data = memoryview(table.decode(flat).tobytes())
                    size = np.concatenate([[0], np.cumsum(table.size[flat])])[cut]
                    cols = [pa.array(lens), pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(cut, cut[1:])], pa.string()), pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(size, size[1:])], pa.string())]
                else:
                    at = pa.array(cut.astype(np.int32))
                    cols = [pa.ListArray.from_arrays(at, pa.array(flat.astype(np.int32)))]
                    if offsets:
                        cols.append(pa.ListArray.from_arrays(at, pa.array(np.concatenate([table.offsets(flat[a:b]) for a, b in zip(cut, cut[1:])] or [np.zeros(0, np.int32)]))))
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=names)

    return src.mapInArrow(run, StructType(fields))


def decode_column(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``row``, ``bytes`` and ``text`` (broken characters become U+FFFD) of an
    array of ids."""
    kept = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    src = rows.select(kept.alias("row"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    schema = StructType([StructField("row", src.schema["row"].dataType), StructField("bytes", BinaryType()), StructField("text", StringType())])

    def run(batches):
        table = Table(read_ranks(path))
        for batch in batches:
            lists = batch.column(1)
            data = [table.decode(np.asarray(x.values, dtype=np.int64)).tobytes() for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), pa.array([d.decode("utf-8", "replace") for d in data], pa.string())], names=["row", "bytes", "text"])

    return src.mapInArrow(run, schema)


def digests(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every whole text: it is
    encoded, and the ids are decoded again."""
    return _encoded(rows, path, pattern, text_col, False, True, id_col).withColumnRenamed("row", id_col)

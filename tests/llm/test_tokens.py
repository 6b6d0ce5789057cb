"""Byte BPE, token files and Simple-8b against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gavel.llm import byte_bpe, encode, token_files
from gavel.llm.queries import BYTE_RANKS, END_ID, QUERIES, WORD_TOKENIZER, split_pattern, vocabulary


def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=byte_bpe.read_ranks(vocabulary(BYTE_RANKS)), special_tokens={})


def word_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(WORD_TOKENIZER))


SPECIAL = ["<|endoftext|> x", "a<|startoftext|>b. C", "A <|ENDOFTEXT|>. b", "x <|EndOfText|><|endoftext|>", "<|endoftext |>"]


def random_texts(n, seed):
    r = random.Random(seed)
    odd = list("aabbcedtinosr  \n\t'sS.,!?0123456éüßñ中文日😀́‍\xa0　\x85\x1c\x0b\x0c​İΣ")
    return ["".join(r.choice(odd) for _ in range(r.randrange(50))) for _ in range(n)] + SPECIAL + ["", " ", "  ", "a "]


def split_ids(flat, lens):
    end = np.cumsum(lens)
    return [flat[e - n : e].tolist() for e, n in zip(end, lens)]


def test_pieces_give_the_ids_of_whole_texts():
    texts = random_texts(4000, 5)
    ranks = byte_bpe.read_ranks(vocabulary(BYTE_RANKS))
    memo = encode.Pieces(byte_bpe.build(ranks, split_pattern()))
    enc = tiktoken_encoding()
    assert split_ids(*encode.encode_texts(memo, pa.array(texts), encode.before_spaces)) == [enc.encode_ordinary(t) for t in texts]
    tok = word_tokenizer()
    memo = encode.Pieces(tok, token_files.PLAIN, byte_bpe.byte_characters())
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from memory
        assert split_ids(*encode.encode_texts(memo, pa.array(texts), lambda t: encode.lower_words(t, token_files.special_pattern(tok)))) == want


def test_long_pieces_are_not_remembered():
    texts = [f"{i}  " + "word " * 200 for i in range(50)]  # double spaces: texts that are not cut
    memo = encode.Pieces(byte_bpe.build(byte_bpe.read_ranks(vocabulary(BYTE_RANKS)), split_pattern()))
    for _ in range(2):
        assert split_ids(*encode.encode_texts(memo, pa.array(texts), encode.before_spaces)) == [tiktoken_encoding().encode_ordinary(t) for t in texts]
    assert len(memo.names) == 0 and memo.held == 0


def test_special_strings_in_token_files(spark):
    docs = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    for split in (False, True):
        path, tok = token_files.new_path(spark), word_tokenizer()
        tok.encode_special_tokens = split
        token_files.write(docs, path, vocabulary(WORD_TOKENIZER), END_ID, split_special=split)
        back = {r.doc_id: list(r.ids) for r in token_files.read_ids(spark, path).collect()}
        assert back == {i: tok.encode(t, add_special_tokens=False).ids + [END_ID] for i, t in enumerate(SPECIAL)}


def test_byte_bpe_query_on_every_text(spark, sf_small):
    got = {r.doc_id: r for r in QUERIES["op4_byte_bpe"](spark, sf_small).collect()}
    enc = tiktoken_encoding()
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = enc.encode_ordinary(r.text or "")
        g = got[r.doc_id]
        assert g.n_tokens == len(ids) and g.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_offsets_and_decoding(odd_documents, no_documents):
    path, pattern = vocabulary(BYTE_RANKS), split_pattern()
    coded = byte_bpe.encode_column(odd_documents, path, pattern, offsets=True)
    for r in coded.collect():
        text = r.row.text or ""
        assert len(r.ids) == len(r.offsets) and list(r.offsets) == sorted(r.offsets)
        assert not text or r.offsets[0] == 0 and max(r.offsets) < len(text)
    back = byte_bpe.decode_column(coded.select("row.text", "ids"), path).collect()
    assert all(r.text == (r.row.text or "") for r in back)
    assert byte_bpe.encode_column(no_documents, path, pattern).count() == 0
    # ids that end within a character
    table = byte_bpe.Table(byte_bpe.read_ranks(path))
    ids = np.array(tiktoken_encoding().encode_ordinary("x😀y"))
    assert table.offsets(ids).tolist()[-1] == 2 and table.decode(ids).tobytes().decode() == "x😀y"


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 511, 512, 513, 4000])
def test_simple8b_round_trip(n):
    r = np.random.default_rng(n)
    for ids in (np.zeros(n), r.integers(0, 2, n), r.integers(0, 50_000, n), r.integers(0, 1 << 62, n), r.integers(0, 1 << 40, n) >> r.integers(0, 40, n), np.where(r.random(n) < 0.05, (1 << 63) - 1, 3)):
        ids = ids.astype(np.uint64)
        words, lanes = token_files.pack(ids)
        assert (token_files.unpack(words, lanes, n) == ids).all()
        if n and ids.max() < 2:
            assert len(words) <= -(-n // 512) * 9


def test_token_files_hold_every_id(spark, sf_small):
    got = QUERIES["op9_token_files"](spark, sf_small).orderBy("doc_id").collect()
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    tok, start = word_tokenizer(), 0
    assert len(got) == len(rows)
    for r, g in zip(rows, got):
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [END_ID]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_on_odd_rows(spark, odd_documents, no_documents):
    path = token_files.new_path(spark)
    token_files.write(odd_documents, path, vocabulary(WORD_TOKENIZER), END_ID)
    back = token_files.read_ids(spark, path).collect()
    tok = word_tokenizer()
    want = sorted((-1 if r.doc_id is None else r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids + [END_ID]) for r in odd_documents.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in back) == want
    starts = token_files.digests(spark, path).orderBy("start").collect()
    assert starts[0].doc_id is None and [r.start for r in starts] == np.concatenate([[0], np.cumsum([r.n_tokens for r in starts])[:-1]]).tolist()
    empty = token_files.new_path(spark)
    token_files.write(no_documents, empty, vocabulary(WORD_TOKENIZER), END_ID)
    assert token_files.digests(spark, empty).count() == 0

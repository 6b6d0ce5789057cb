"""The corpus pipeline on the smallest tables: what each stage keeps, by brute force."""

import itertools

import corpus_pipeline
import pytest
import tiktoken
from pyspark.sql import functions as F

from gavel.llm import byte_bpe, mixing
from gavel.llm.common import read_table
from gavel.llm.queries import BYTE_RANKS, split_pattern, vocabulary

from .test_dedup import LOW, shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage, on the given table and some odd rows."""
    docs = read_table(spark, SF, "documents")
    top = docs.orderBy("doc_id").first().asDict()
    odd = [{**top, "doc_id": 10_000 + i, "text": t, "lang": None, "source": None} for i, t in enumerate([None, "", "123 !!", top["text"].upper(), top["text"] + " tail"])]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_language_stage_keeps_texts_with_letters(stages):
    kept = {r.doc_id for r in stages[1].collect()}
    assert kept == {r.doc_id for r in stages[0].collect() if r.text and any(c.isalpha() for c in r.text)}


def test_exact_stage_keeps_the_largest_id(stages):
    best = {}
    for r in stages[1].collect():
        key = r.text.translate(LOW)
        best[key] = max(best.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(best.values())


def test_near_stage_keeps_the_smallest_id_of_a_component(stages):
    rows = [(r.doc_id, shingles(r.text)) for r in stages[2].collect()]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(i for i in root if find(i) == i)


def test_mixing_stage_repeats_rows_as_decided(spark, stages):
    want = {r.doc_id: r.repetitions for r in mixing.mix(stages[3]).collect() if r.repetitions}
    got = {r.doc_id: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert got == want


def test_last_stage_has_the_ids_of_the_whole_texts(stages):
    enc = tiktoken.Encoding("t", pat_str=split_pattern(), mergeable_ranks=byte_bpe.read_ranks(vocabulary(BYTE_RANKS)), special_tokens={})
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count() and all(r.ids == enc.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in rows)


def test_stages_keep_the_columns_and_empty_tables(spark, stages):
    for frame in stages[1:5]:
        assert frame.columns == stages[0].columns
    none = stages[0].filter(F.lit(False))
    for _name, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
        assert none.count() == 0

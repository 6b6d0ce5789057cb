"""Operators 11 to 13 against brute force, with odd rows and hot groups."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest

from gavel.llm import filter_audit, importance, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars int, rank string, part string"
LABELS = "doc_id long, quality int, toxic int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, "x", "y") for i, t, lang in rows], DOCS)


WORDS = "Alpha beta gamma delta été straße naïve x1 22 omega the of and to a in".split()


def _prose(rng, n):
    return "".join(w + str(rng.choice([" ", " ", " ", ", ", "\n", ".\r\n"])) for w in rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    rows = [(i, _prose(rng, int(rng.integers(1, 120))), str(rng.choice(["en", "de"]))) for i in range(60)]
    line = _prose(rng, 30).replace("\n", " ")
    rows += [(100 + i, f"{_prose(rng, 5)}\n{line}\n{_prose(rng, 5)}", None) for i in range(25)]
    rows += [(200, None, "en"), (201, "", None), (202, " \n\n ", ""), (203, "one", "fr"), (None, line, "en"), (None, line, "en"), (204, rows[3][1], "en"), (204, rows[3][1], "en"), (205, "a" * 5000, "de"), (206, "ab " * 9000, "de"), (207, "A#B" * 100, "de")]
    return rows


# importance resampling


def _features(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def _resampled(rows, target):
    def bucket(f):
        return zlib.crc32(f.encode()) % 10000

    raw, want = (Counter(bucket(f) for t in ts for f in _features(t)[1]) for ts in ([t for _, t, _ in rows], target))
    n_raw, n_want = sum(raw.values()), sum(want.values())
    out = []
    for i, t, _ in rows:
        n, fs = _features(t)
        gain = sum(math.floor(1000 * math.log((want[b] + 1) * (n_raw + 10000) / ((raw[b] + 1) * (n_want + 10000)))) for b in map(bucket, fs))
        weight = gain // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20])
    may = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(may[: 25 * len(may) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


@pytest.mark.parametrize("hot_at", [None, 1, 1000])
def test_importance_equals_brute_force(spark, texts, hot_at):
    """Whatever lines count as hot: with one partition a quarter of all lines,
    with a thousand partitions every line that occurs twice."""
    target = ["alpha beta gamma\nété of the", None, "", "Straße x1 omega"] * 3
    if hot_at:
        spark.conf.set("spark.sql.shuffle.partitions", str(hot_at))
    try:
        got = importance.resample(_docs(spark, texts), spark.createDataFrame([(t,) for t in target], "text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(map(tuple, got), key=str) == _resampled(texts, target)


def test_importance_without_rows_or_target(spark, texts):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(_docs(spark, []), none).count() == 0
    got = importance.resample(_docs(spark, texts), none).collect()
    assert sorted(map(tuple, got), key=str) == _resampled(texts, [])


def test_crc_of_long_words():
    import pyarrow as pa

    words = ["a" * n for n in (1, 63, 64, 65, 66, 1000)] + ["ü" * 40, "0"]
    found, off = importance.text_features(pa.array(words), 1 << 31, False)
    assert found.tolist() == [zlib.crc32(w.encode()) % (1 << 31) for w in words] and off.tolist() == list(range(9))


# filter audit


def test_shapley_map_is_the_mean_over_orders():
    rng = np.random.default_rng(1)
    v = [0, *map(int, rng.integers(0, 1000, 31))]
    for i, row in enumerate(filter_audit.shapley_map(5)):
        mean = Fraction(0)
        for order in permutations(range(5)):
            before = sum(1 << f for f in order[: order.index(i)])
            mean += Fraction(v[before | 1 << i] - v[before], 120)
        assert sum(c * x for c, x in zip(row, v, strict=True)) == mean


def _audited(rows, labels):
    good, toxic = ({i for i, *q in labels if i is not None and q[k] == 1} for k in (0, 1))
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), copy]
        docs.append((lang or "", {x for x, f in zip("ABCDE", fails, strict=True) if f}, i in good, i in toxic))
    out, shapley = [], Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for k, f in enumerate(order):
                hit = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = [d for d in docs if d[0] == part and f in d[1]]
                shapley[part, f] += len(hit)
                out.append([part, order, k + 1, len(left), len(hit), len(failing) - len(hit), sum(d[1] == {f} for d in failing), sum(d[2] for d in hit), sum(d[3] for d in hit)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_equals_simulation(spark, texts):
    labels = [(3, 1, 0), (3, 0, None), (204, 1, 1), (None, 1, 1), (100, 0, 1), (999, 1, 1), (101, None, None)]
    got = filter_audit.audit(_docs(spark, texts), spark.createDataFrame(labels, LABELS)).collect()
    assert sorted(map(tuple, got)) == _audited(texts, labels)


def test_audit_without_rows(spark):
    assert filter_audit.audit(_docs(spark, []), spark.createDataFrame([], LABELS)).count() == 0


# suffix dedup


def _cut(rows):
    first = {}
    for i, t, _ in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49 if i is not None else 0):
            first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    out = []
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49 if i is not None else 0):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def passages():
    rng = np.random.default_rng(9)
    shared = [_prose(rng, 40) for _ in range(3)]
    rows = []
    for i in range(40):
        p = shared[i % 3].encode()
        at = int(rng.integers(0, 30))
        piece = p[at : at + int(rng.integers(40, 200))].decode(errors="ignore")
        rows.append((i, f"{rng.integers(10**9)}{_prose(rng, 30)}{piece}{_prose(rng, 3)}{rng.integers(10**9)}", "en"))
    rows += [(50, "z" * 49, ""), (51, "z" * 50, ""), (52, "z" * 51, ""), (53, "z" * 400, ""), (54, "z" * 300 + "y" + "z" * 300, ""), (55, "xyz" * 100, ""), (56, "yzx" * 90, "")]
    rows += [(60, None, ""), (61, "", ""), (62, rows[0][1], ""), (63, rows[0][1], ""), (63, rows[0][1], ""), (None, rows[0][1], ""), (-1, rows[5][1] + "tail", ""), (64, rows[7][1] * 40, "")]
    return rows


def _hot(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1)
    monkeypatch.setattr(suffix_dedup, "GROUP", 48)


@pytest.mark.parametrize("case", ["plain", "all buckets hot", "small pieces"])
def test_cut_equals_brute_force(spark, passages, case, monkeypatch):
    if case == "all buckets hot":
        _hot(monkeypatch)
    if case == "small pieces":
        monkeypatch.setattr(suffix_dedup, "PIECE", 100)
        monkeypatch.setattr(suffix_dedup, "OPEN_GROUP", 500)
    got = suffix_dedup.remove_repeats(_docs(spark, passages)).collect()
    assert sorted(map(tuple, got), key=str) == _cut(passages)


def test_hot_buckets_are_found(spark, passages, monkeypatch):
    assert len(suffix_dedup.hot_buckets(_docs(spark, passages).selectExpr("doc_id id", "coalesce(text, '') text"))) == 0
    _hot(monkeypatch)
    assert len(suffix_dedup.hot_buckets(_docs(spark, passages).selectExpr("doc_id id", "coalesce(text, '') text"))) > 5


def test_nothing_to_cut(spark):
    assert suffix_dedup.remove_repeats(_docs(spark, [])).count() == 0
    got = suffix_dedup.remove_repeats(_docs(spark, [(None, None, None), (1, "short", None)])).collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in sorted(got, key=str)] == [(5, 0, 0), (0, 0, 0)]


def test_equal_windows_compare_bytes():
    rng = np.random.default_rng(2)
    strings = [bytes(rng.integers(97, 99, int(rng.integers(50, 90))).astype(np.uint8)) for _ in range(50)] + [b"a" * 90, b"a" * 70, b"ab" * 40]
    b = np.frombuffer(b"".join(strings), dtype=np.uint8)
    at, bucket = suffix_dedup.equal_windows(b, np.cumsum([0, *map(len, strings)]))
    named = {}
    for p, k in zip(at.tolist(), bucket.tolist(), strict=True):
        named.setdefault(b[p : p + 50].tobytes(), set()).add(k)
    assert all(len(k) == 1 for k in named.values()) and len(set.union(*named.values())) == len(named)

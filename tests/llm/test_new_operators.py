"""Encoding, filter audit and importance resampling against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trajekt.llm import bpe, filters, resampling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
TRICKY = [
    "it's don't '90s --'tis x'y.z 'S 'll", "a  b   c\n\n\nd\t\te \n f", " lead and trail  ", " no　break s x", "café,déjà 你好世界123abc!?",
    "x<|endoftext|>y  <|endoftext|> z<|endoftext|>", "<|endoftext|>", "(<|endoftext|>)<|endo", "\u0085a\x1cb\x00c᠎d", "A1b2C3 3.14e-5 #tag @you $9,99", "\U0001f600\U0001f468‍\U0001f469 é ١٢", "'", "''s", "a'", "1'2", "-'-", "\n", "   ",
]


def corpus():
    rng = np.random.default_rng(9)
    vocabulary = [f"word{i}ß" if i % 9 == 0 else f"word{i}" for i in range(300)]
    say = lambda n: " ".join(vocabulary[i] for i in rng.integers(0, 300, n))
    texts = [None, "", " \t", "one", *TRICKY, say(250), say(250), "SAME Text " * 3, "SAME Text " * 3, say(20), say(19), say(4000), "same same " * 120]
    texts += [say(220), say(220) + " a#b", say(210).upper(), say(30), say(25)] * 3 + [say(12) for _ in range(40)] + [say(int(n)) for n in rng.integers(20, 60, 60)]
    return [(i, t, "en", None if i % 11 == 0 else f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, equal ids with other texts, and columns named like results and helpers."""
    rows = [(None, "a b c"), (None, None), (7, "same text here"), (7, "same text here"), (7, "other"), (8, "a\nb"), (9, "same text here")]
    return spark.createDataFrame([(i, t, "en", "s", 3, 1, 2, "k", 0.5, "p") for i, t in rows], SCHEMA + ", n_tokens int, mask int, ids string, score double, part string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def round_trip(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


def test_words_keep_the_ids_of_the_text(tokenizer):
    special = bpe.special_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(3)
    signs = ["a", "Z", "9", "'", "s", "t", ".", "-", "#", " ", " ", "\n", "\t", " ", "　", "é", "世", "١", "\U0001f600", "́", "<|endoftext|>", "\x1f", "\x85", "​", "'re", "|", "_"]
    texts = TRICKY + ["".join(rng.choice(signs, rng.integers(1, 25))) for _ in range(5000)]
    for text in texts:
        words = bpe.words_of(text, special)
        assert "".join(words) == text
        parts = [i for w in words for i in tokenizer.encode(w, add_special_tokens=False).ids]
        assert parts == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_encode_and_decode(docs, tokenizer, monkeypatch):
    rows = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs)).collect()}
    assert len(rows) == len(corpus())
    for i, text, *_ in corpus():
        ids, back = round_trip(tokenizer, text)
        r = rows[i]
        assert (r["n_tokens"], list(r["ids"]), r["decoded"]) == (len(ids), ids, back)
        assert r["ids_sha256"] == sha(np.array(ids, "<u4").tobytes())


def test_encode_in_many_chunks(spark, docs, tokenizer):
    """Small chunks and rows of positions give what large ones give, also where one word fills many of them."""
    long = spark.createDataFrame([(1000, "ab1" * 200_000, "en", None, 0), (1001, "x" * 50 + " end", "en", None, 0)], SCHEMA)
    small = lambda d: _with_sizes(bpe.encode, d, 500, 64)
    got = {r["doc_id"]: r["ids_sha256"] for r in small(docs.unionByName(long)).collect()}
    for i, text, *_ in [*corpus(), (1000, "ab1" * 200_000), (1001, "x" * 50 + " end")]:
        assert got[i] == sha(np.array(round_trip(tokenizer, text)[0], "<u4").tobytes())


def _with_sizes(encode, docs, chunk, row):
    """encode() with the sizes of chunks set in the workers, by a wrapper that its functions go through."""
    old = bpe._word_rows, bpe._position_rows

    def sized(make):
        def made(*args):
            run = make(*args)

            def inner(batches):
                from trajekt.llm import bpe as own

                own.CHUNK_BYTES, own.ROW_WORDS = chunk, row
                yield from run(batches)

            return inner

        return made

    bpe._word_rows, bpe._position_rows = map(sized, old)
    try:
        return encode(docs)
    finally:
        bpe._word_rows, bpe._position_rows = old


def test_decode_of_any_ids(spark, tokenizer):
    """Split characters become U+FFFD as in the tokenizer; unknown and null ids give nothing."""
    rng = np.random.default_rng(4)
    lists = [rng.integers(0, 50257, rng.integers(0, 12)).tolist() for _ in range(300)]
    frame = spark.createDataFrame([(i, ids, "mine") for i, ids in enumerate(lists)] + [(1000, None, "x"), (1001, [50257, 31373, None, -4], "x")], "doc_id int, ids array<int>, decoded string")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(frame).collect()}
    assert got[1000] == "" and got[1001] == "hello"
    assert all(got[i] == tokenizer.decode(ids, skip_special_tokens=False) for i, ids in enumerate(lists))


def test_odd_rows_and_empty_tables_encode(odd, empty, tokenizer):
    got = sorted((r["doc_id"] or -1, r["decoded"], r["n_tokens"]) for r in bpe.decode(bpe.encode(odd)).collect())
    want = [(-1, "a b c", 3), (-1, "", 0), (7, "same text here", 3), (7, "same text here", 3), (7, "other", 1), (8, "a\nb", 3), (9, "same text here", 3)]
    assert got == sorted(want)
    assert bpe.decode(bpe.encode(empty)).count() == 0


def test_changed_input_is_an_error(spark):
    wrong = bpe._joined(pa.int64())
    places = pa.table({"doc_ids": [[1]], "sizes": [[1]], "packed": [bpe.packed(np.array([0]))]})
    for at in ([1], []):
        with pytest.raises(RuntimeError):
            wrong(places, pa.table({"words": pa.array([len(at)], pa.int32()), "ids": pa.array([0], pa.int32()), "packed": [bpe.packed(np.array(at), np.array(at) * 0)]}))


def audited(rows, labels):
    """Every order played out document by document."""
    marks = {}
    for i, q, t in labels:
        good, toxic = marks.get(i, (0, 0))
        marks[i] = (max(good, int(q == 1)), max(toxic, int(t == 1)))
    smallest = {}
    for i, t, *_ in rows:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    table = []
    for i, t, source in rows:
        t = t or ""
        w = SPACED.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > smallest[t]}
        table.append((source or "", {k for k, v in fails.items() if v}, *marks.get(i, (0, 0))))
    out = {}
    for part in {r[0] for r in table}:
        own = [r for r in table if r[0] == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = list(range(len(own)))
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in own[k][1]]
                failing = sum(f in r[1] for r in own)
                left = [k for k in left if k not in set(gone)]
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in own), sum(own[k][2] for k in gone), sum(own[k][3] for k in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_filter_audit(spark, docs):
    rows = [(i, t, s) for i, t, _, s, _ in corpus()]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, len(rows), 2)] + [(4, 1, None), (None, 1, 1), (10_000, 1, 1)]
    frame = filters.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in frame.collect()}
    assert got == audited(rows, labels)
    assert len(got) == 600 * len({s or "" for *_, s in rows})


def test_filter_audit_of_odd_rows(spark, odd, empty):
    """Rows of the smallest id of a text don't fail E, nor do null ids; repeated rows count each."""
    labels = spark.createDataFrame([(7, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in filters.audit(odd, labels).collect()}
    assert got == audited([(r["doc_id"], r["text"], r["source"]) for r in odd.collect()], [(7, 1, 1)])
    assert filters.audit(empty, labels).count() == 0
    assert filters.audit(odd, labels.limit(0)).count() == 600


def test_potentials_are_shapley_values(spark):
    """The grand potential minus the one without a filter is its share, for any game of five."""
    rng = np.random.default_rng(8)
    v = [0, *rng.integers(0, 1000, 31).tolist()]
    p = spark.range(1).select(filters.potentials(F.lit(v).cast("array<long>"), 5).alias("p")).first()["p"]
    for i in range(5):
        share = sum(v[sum(1 << j for j in o[: o.index(i) + 1])] - v[sum(1 << j for j in o[: o.index(i)])] for o in permutations(range(5)))
        assert 2 * (p[31] - p[31 - (1 << i)]) == share


def feature_list(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(rows, target):
    S, T = Counter(), Counter()
    found = [(i, *feature_list(t)) for i, t in rows]
    for _, _, f in found:
        S.update(f)
    for t in target:
        T.update(feature_list(t)[1])
    ns, nt = sum(S.values()), sum(T.values())
    gain = [math.floor(1000 * math.log((T[b] + 1) * (ns + 10000) / ((S[b] + 1) * (nt + 10000)))) for b in range(10000)]
    out, able = {}, []
    for i, w, f in found:
        h = int(sha(f"42:{'' if i is None else i}".encode())[:8], 16)
        weight = sum(gain[b] for b in f)
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if len(w) >= 20:
            able.append(i)
    for place, i in enumerate(sorted(able, key=lambda i: (-out[i][2], i))[: 5 * len(able) // 100], 1):
        out[i][3] = place
    return out


TARGET = ["word1 word2 WORD3", None, "", "café déjà word9", "word5 word6 word7 word8 " * 20]


def test_resampling(spark, docs):
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id int, text string")
    got = {r["doc_id"]: [r["n_features"], r["weight"], r["score"], r["rank"]] for r in resampling.resample(docs, target).collect()}
    want = resampled([(i, t) for i, t, *_ in corpus()], TARGET)
    assert got == want and sum(v[3] is not None for v in want.values()) >= 4


def test_resampling_ties_odd_rows_and_empty_tables(spark, odd, empty):
    target = spark.createDataFrame([(0, "a b")], "item_id int, text string")
    rows = resampling.resample(odd, target).collect()
    assert len(rows) == 7 and all(r["rank"] is None for r in rows)
    assert sorted(r["n_features"] for r in rows) == [0, 1, 3, 6, 6, 6, 6]
    assert resampling.resample(empty, target).count() == 0
    assert resampling.resample(odd, target.limit(0)).count() == 7
    same = spark.createDataFrame([(i, "w " * 30) for i in (5, 3, 3, None)] * 10, "doc_id long, text string")
    ranks = [(r["score"], -(r["doc_id"] or 10**9)) for r in sorted((r for r in resampling.resample(same, target, drawn=100).collect()), key=lambda r: r["rank"])]
    assert ranks == sorted(ranks, reverse=True) and len(ranks) == 40


def test_features_of_joined_texts():
    """Sentinels keep texts apart, a byte 0 in a text is no sentinel, and CRCs of long words are moved right."""
    crc = resampling.Crc()
    texts = ["a b", None, "c\x00d e", "", "x" * 70 + " " + "é" * 40 + " " + "y" * 5000, "Aİz"]
    owner, bucket, words = resampling.features(texts, crc)
    for k, t in enumerate(texts):
        w, f = feature_list(t)
        assert words[k] == len(w) and sorted(bucket[owner == k].tolist()) == sorted(f)
    assert [len(x) for x in resampling.features([], crc)] == [0, 0, 0]

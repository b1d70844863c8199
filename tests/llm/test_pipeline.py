"""The pipeline's stages and run() on small tables: what each keeps, null and empty texts, repeated rows, clashing columns, empty tables."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = COLUMNS + ", kept string, n_lines int, n_dropped int, predicted int, class_id long, __n int, size int, piece int"


def texts():
    rng = np.random.default_rng(6)
    calm = [f"quiet{i}" for i in range(200)]
    rude = [f"vile{i}" for i in range(30)]
    say = lambda words, n: " ".join(words[i] for i in rng.integers(0, len(words), n))
    out = [(None, None), ("", None), ("short", 0)]
    out += [(say(calm, 60), 0) for _ in range(60)] + [(say(rude, 30) + " " + say(calm, 20), 1) for _ in range(40)]
    base = say(calm, 150)
    out += [(base, 0), (base, 0), (base + " end", 0)]
    out += [(f"Shared Header Line\n{say(calm, 40)}", 0) for _ in range(12)]
    return out


def rows():
    return [(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, (t, _) in enumerate(texts())]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows(), COLUMNS).write.parquet(f"{place}/documents.parquet")
    labels = [(i, 1, toxic) for i, (_, toxic) in enumerate(texts()) if toxic is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return place


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="module")
def clashing(spark):
    """Columns named like results and helpers of the stages, a null id and a repeated row."""
    own = [*rows(), (None, "no id here", "en", "s1", 10), rows()[5]]
    return spark.createDataFrame([(*r, "mine", 99, 98, 97, 96, 95, 94, 93) for r in own], EXTRA)


MINE = ("kept", "n_lines", "n_dropped", "predicted", "class_id", "__n", "size", "piece")


def test_toxic_documents_go(spark, docs, folder):
    left = {r["doc_id"] for r in P.drop_toxic(spark, docs, folder).collect()}
    calm = [i for i, (_, toxic) in enumerate(texts()) if toxic == 0]
    rude = [i for i, (_, toxic) in enumerate(texts()) if toxic == 1]
    assert sum(i in left for i in calm) >= 0.95 * len(calm) and sum(i in left for i in rude) <= 0.2 * len(rude) and {0, 1} <= left


def test_shared_lines_go(spark, docs, folder):
    got = {r["doc_id"]: r for r in P.drop_common_lines(spark, docs, folder).collect()}
    assert len(got) == len(rows())
    for i, text, _, _, n in rows():
        want = text.removeprefix("Shared Header Line\n") if text else text
        assert (got[i]["text"], got[i]["n_chars"]) == (want, n if want == text else len(want))


def test_one_of_near_copies_stays(spark, docs, folder):
    left = {r["doc_id"] for r in P.keep_one_of_near_copies(spark, docs, folder).collect()}
    copies = [i for i, (t, _) in enumerate(texts()) if t and texts()[-13][0].split(" end")[0] in t]
    assert len(copies) == 3 and copies[0] in left and not set(copies[1:]) & left


def test_mix_takes_whole_and_cut_documents(spark, docs, folder):
    mixed = P.mix_sources(spark, docs, folder)
    assert mixed.columns == docs.columns
    words = lambda t: len((t or "").split())
    all_words = sum(words(t) for _, t, *_ in rows())
    assert abs(sum(words(r["text"]) for r in mixed.collect()) - 1.5 * all_words) <= 4
    taken = Counter(r["doc_id"] for r in mixed.collect())
    assert max(taken.values()) <= 2


def test_packing_places_every_token(spark, docs, folder):
    import public_tokenizers

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = P.pack_sequences(spark, docs, folder).collect()
    size = Counter()
    for r in found:
        size[r["doc_id"]] += r["length"]
    assert size == {i: len(encoder.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, *_ in rows()}


@pytest.mark.parametrize("stage", [s for s in P.STAGES[:-1]], ids=lambda s: s[0])
def test_stages_keep_columns_of_any_name(spark, clashing, folder, stage):
    out = stage[1](spark, clashing, folder)
    assert out.columns == clashing.columns
    got = out.collect()
    assert got and all([r[c] for c in MINE] == ["mine", 99, 98, 97, 96, 95, 94, 93] for r in got)
    assert any(r["doc_id"] is None for r in got)


@pytest.mark.parametrize("stage", P.STAGES, ids=lambda s: s[0])
def test_stages_of_an_empty_table(spark, clashing, folder, stage):
    assert stage[1](spark, clashing.limit(0), folder).count() == 0


def test_run_is_its_stages(spark, folder):
    """run() packs what the four filters leave: every document of its result passed them, and offsets are gapless."""
    found = P.run(spark, folder).collect()
    docs = spark.read.parquet(os.path.join(folder, "documents.parquet"))
    for _, stage in P.STAGES[:3]:
        docs = stage(spark, docs, folder)
    assert {r["doc_id"] for r in found} <= {r["doc_id"] for r in docs.collect()} and len({r["doc_id"] for r in found}) > 50
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_stage_leaves_no_cache_in_its_worker():
    import pyarrow as pa

    from trajekt.llm import packing

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words, some more words", None]})
    kept = [list(packing._pieces(None, 8, 0, False, 100, kept_on)([batch])) for kept_on in (True, False)]
    assert kept[0] == kept[1] and not packing._tokens

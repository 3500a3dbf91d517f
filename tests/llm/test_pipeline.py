"""Each stage of the corpus pipeline against a plain version, on what its predecessor kept."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as CP
from scenelake.llm import quality as QU
from scenelake.llm.token_files import public_tokenizer

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """The rows of documents and of each stage."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    out.append([r.asDict() for r in docs.collect()])
    for k, (name, stage) in enumerate(CP.STAGES):
        docs = CP.settle(stage(spark, docs, SF), name)
        out.append([r.asDict() for r in docs.collect()])
        if k + 1 < len(CP.STAGES):
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return out


def ids(rows):
    return Counter(r["doc_id"] for r in rows)


def test_names_and_order():
    assert [n for n, _ in CP.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_output"] and CP.ORACLE_SQL is None


def test_quality_stage(spark, kept):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    weights, feats = QU.train(docs, labels), QU.Featuriser()
    want = Counter()
    for r in kept[0]:
        at, x = feats((r["text"] or "").encode())
        if weights[at] @ x + weights[-1] >= 0:
            want[r["doc_id"]] += 1
    assert ids(kept[1]) == want and len(kept[1]) < len(kept[0])
    held = [r for r in labels.collect() if brute.crc(r.doc_id) % 3 == 1]
    assert np.mean([(r.doc_id in want) == bool(r.quality) for r in held]) > 0.9


def test_near_duplicate_stage(kept):
    docs = [(r["doc_id"], r["text"]) for r in kept[1]]
    want = {name if n else d for (d, _), (n, _, name) in zip(docs, brute.components(docs, 5))}
    assert ids(kept[2]) == Counter(want)


def test_decontamination_stage(spark, kept):
    items = [(r.item_id, r.text or "") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = Counter()
    for r in kept[2]:
        n, hit, _ = brute.hits(r["text"], items)
        if not (hit and 20 * hit >= n):
            want[r["doc_id"]] += 1
    assert ids(kept[3]) == want


def test_mixing_stage(kept):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in kept[3]]
    want = Counter()
    for r, (*_, taken) in zip(kept[3], brute.mix(rows)):
        want[r["doc_id"]] += taken
    assert ids(kept[4]) == +want


def test_token_stage(kept):
    import zlib

    from tokenizers import Tokenizer
    tok, at = Tokenizer.from_file(public_tokenizer()), 0
    text = {r["doc_id"]: r["text"] for r in kept[4]}
    order = sorted(kept[5], key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == sorted(r["doc_id"] for r in kept[4])
    for r in order:
        full = np.array([*tok.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(full), zlib.crc32(full.tobytes()))
        at += len(full)


def test_run_gives_the_last_stage(spark, kept):
    assert sorted(map(tuple, CP.run(spark, SF).collect())) == sorted(tuple(r.values()) for r in kept[5])

"""Stages of the pipeline that the tests of the operators don't run, against the libraries and brute force."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.util import documents


def test_last_stage_gives_ids_and_the_digest_of_what_they_decode_to(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, "Two words,\n\nthree  lines é 🙂"), (2, ""), (3, None), (4, "a " * 500)]
    got = {r.doc_id: r for r in corpus_pipeline.encode(spark, documents(spark, rows), "").collect()}
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (got[i].ids, got[i].n_tokens) == (ids, len(ids))
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert got[i].lang == "en"


def test_stages_are_named_in_order_and_keep_the_columns(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_duplicates", "decontamination", "bpe"]

"""The byte-level encoder and Python's cycle collector."""

import gc
import random

import public_tokenizers
import pyarrow as pa

from sievebook.llm import bpe


def test_collector_rests_while_texts_are_encoded():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdefghilmnoprstuvzéß", k=9)) for _ in range(8000))
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text])], names=["doc_id", "text"])
    bpe.codec(path, public_tokenizers.PATTERN)
    runs = []
    note = lambda phase, info: runs.append(info["generation"]) if phase == "start" else None
    work = bpe._coded(path, public_tokenizers.PATTERN)(iter([batch]))
    gc.callbacks.append(note)
    try:
        out = next(work)
        during = len(runs)
    finally:
        gc.callbacks.remove(note)
    assert out.num_rows == 1 and gc.isenabled()
    assert during <= 3, during

"""What the pipeline's Python workers hold at once, and that packing starts no more of them."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from seacast.llm import cutting, ordermin
from seacast.llm.tokens import Encoder

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows():
    """8 MB of texts of about 1,100 bytes."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    texts = [" ".join(rng.choices(words, k=180)) for _ in range(7600)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array([0] * len(texts), pa.int32())], ["doc_id", "text", "tag"])


def traced_mb(work):
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def test_packing_holds_a_megabyte_of_text_at_once(rows):
    encoder = Encoder(WORDS, False)
    list(cutting.Cutter(encoder, 1, 2048, False)([rows.slice(0, 1000)]))  # loads the vocabulary
    cutter = cutting.Cutter(encoder, 1, 2048, False)
    assert traced_mb(lambda: [b.num_rows for b in cutter([rows])]) < 25
    parts = pa.Table.from_batches(cutter([rows]))
    alone = pa.Table.from_batches([b for i in range(0, rows.num_rows, 500) for b in cutter([rows.slice(i, 500)])])
    assert parts.num_rows >= rows.num_rows and parts.combine_chunks() == alone.combine_chunks()


def test_profiles_hold_two_megabytes_of_text_at_once(rows):
    profiles = ordermin.Profiles(ordermin.SHINGLE, ordermin.SKETCHES)
    assert traced_mb(lambda: [b.num_rows for b in profiles([rows])]) < 45
    parts = pa.Table.from_batches(profiles([rows]))
    alone = pa.Table.from_batches([b for i in range(0, rows.num_rows, 500) for b in profiles([rows.slice(i, 500)])])
    assert parts.num_rows == rows.num_rows and parts.combine_chunks() == alone.combine_chunks()


def test_patterns_are_part_of_the_plan(spark):
    """Rows given as a list are an RDD of pickles, read by Python workers besides those that encode."""
    docs = spark.createDataFrame([(i, "some words " * (i % 40)) for i in range(200)], "doc_id long, text string")
    packed = cutting.pack(docs, WORDS, False, 1)
    assert "LogicalRDD" not in packed._jdf.queryExecution().analyzed().toString()
    got = packed.collect()
    assert len(got) == 200 and sum(r.length for r in got) == sum(r.doc_tokens for r in got)
    assert max(np.bincount([r.sequence_id for r in got], [r.length for r in got])) <= 2048

"""Each stage of the pipeline against its plain version, on the rows that the stage before it kept."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from seacast.llm import mixing
from seacast.session import stored
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "minhash near dedup", "mixing", "packing"]
    kept = stored(stages["quality rules"](spark, docs, SF))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    for r in kept.collect():
        n, chars, symbols, _, repeat = brute.quality(r.text)
        assert n >= 50 and 2 * repeat <= n and 10 * symbols <= n and 3 * n <= chars <= 10 * n

    one = stored(stages["exact dedup"](spark, kept, SF))
    first = {}
    for r in sorted(kept.collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted(first.values()) and len(first) < kept.count()

    near = stored(stages["minhash near dedup"](spark, one, SF))
    rows = sorted((r.doc_id, r.text) for r in one.collect())
    classes = brute.near_classes(rows)
    assert sorted(r.doc_id for r in near.collect()) == sorted({rows[c][0] for c in classes})

    mixed = stored(stages["mixing"](spark, near, SF))
    plan = {r.doc_id: r.taken for r in mixing.mix(near).collect() if r.taken}
    taken = Counter()
    for r in mixed.collect():
        taken[r.doc_id] += len(brute.words(r.text))
    assert mixed.columns == docs.columns and dict(taken) == plan

    packed = stages["packing"](spark, mixed, SF).collect()
    ends = defaultdict(int)
    for r in packed:
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r.doc_id for r in mixed.collect())


def test_run_ends_with_pieces(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns)

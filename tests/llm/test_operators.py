"""Each operator against its plain version, over nulls, empty and long texts, ties, repeated rows and clashing columns."""

import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from seacast.llm import chat, cutting, exthash, mixing, ordermin, quality, queries, suffixdup, superkmer, tokenfile, warc
from seacast.llm.tokens import Encoder
from seacast.session import scratch_path
from tests.llm import brute
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, KEEP_ID int, n_words string, size string, target string, tag string, spans string, text_id string, _w int, _norm int, start string, `a b.c` int"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "béta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.randrange(60)) for _ in range(n))


def fixture_rows():
    base, other, long = prose(1, 300), prose(2, 120), prose(3, 40000)
    edited = base.split()
    edited[100], edited[200] = "changed", "words"
    passage = prose(4, 70)
    rows = [
        (None, None), (1, None), (2, ""), (3, " \n\t "), (4, base), (5, base.replace(" ", "\n  ")), (6, " ".join(edited)), (7, base), (7, base),
        (None, base), (None, base), (8, other), (9, other + "\n" + passage), (10, prose(5, 80) + " " + passage + " " + prose(6, 50)), (11, long),
        (12, prose(7, 10) + " " + long[:30000]), (13, "la " * 700), (14, "x" * 1500), (15, "x" * 1499 + "y"), (16, "one two"), (17, "one two"),
        (18, "#*$%& | <> " * 30), (19, "same line here\n" * 40), (20, passage), (21, "é" * 400 + " z"), (22, "WORD!! " * 60), (23, "a b \x1c c  d"),
        (24, " ".join(map(str, range(12)))), (25, " ".join(map(str, range(13)))), (26, "0 " + " ".join(map(str, range(13)))), (27, prose(8, 2100)),
        (28, "<|endoftext|> and <|startoftext|>"),
    ]
    return rows


@pytest.fixture(scope="module")
def rows():
    return fixture_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    sources = [None, "b", "a", "ç"]
    data = [(d, t, "en", sources[i % 4], 1, "k", 2, "w", "s", "t", "g", "sp", "id", 3, 4, "st", 5) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(data, KINDS).repartition(3)


def multiset(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name]) is None


def test_quality_measures_and_verdict(docs, rows):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    measured = quality.with_measures(docs, names)
    assert multiset(measured, "doc_id", *names) == sorted(((d, *brute.quality(t)) for d, t in rows), key=repr)
    one, other = (quality.quality_cascade(docs, order=o) for o in (quality.BASE + quality.RULES, (quality.BASE + quality.RULES)[::-1]))
    assert multiset(one, "doc_id", "kept") == multiset(other, "doc_id", "kept")
    assert set(docs.columns) <= set(one.columns) | {"kept"} and len(one.columns) == len(docs.columns) + 1
    verdict = dict(multiset(one.where("doc_id IS NOT NULL"), "doc_id", "kept"))
    assert verdict[4] and verdict[8] and not any(verdict[d] for d in (1, 2, 3, 13, 14, 16, 18, 19, 22))
    assert quality.quality_cascade(docs, rules=[], order=[]).where("NOT kept").count() == 0


def test_quality_order_is_by_rejections_per_cost():
    r = [quality.Rule(n, "true") for n in "abc"]
    assert [x.name for x in quality.by_rejections_per_cost([(r[0], 1.0, 0.5), (r[1], 0.1, 0.2), (r[2], 1.0, 0.0)])] == ["b", "a", "c"]


@pytest.mark.parametrize("hash_of", [F.xxhash64, lambda c: F.length(c) % 3, lambda c: F.lit(0).cast("long")])
def test_exact_dedup(docs, rows, hash_of):
    found = exthash.one_row_per_key(exthash.exact_dedup(docs, hash_of=lambda c: hash_of(c).cast("long"), capacity=4))
    norm = lambda t: __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append(d)
    want = []
    for d, t in rows:
        ids = groups[norm(t)]
        want.append((d, min((x for x in ids if x is not None), default=None), len(ids), brute.sha(norm(t).encode())))
    assert multiset(found, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=repr)
    kept = multiset(found.where("kept"), "text_sha256", "doc_id")
    assert kept == sorted(((brute.sha(n.encode()), min((x for x in ids if x is not None), default=None)) for n, ids in groups.items()), key=repr)


def test_directory_buckets_split_and_cover(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h")).union(spark.createDataFrame([(5,)] * 1, "h bigint"))
    buckets = exthash.directory(keys, capacity=100).collect()
    assert sum(2.0 ** -b.depth for b in buckets) <= 1
    held = defaultdict(int)
    for (h,) in keys.collect():
        at = [(b.depth, b.prefix) for b in buckets if (h % (1 << 64)) >> (64 - b.depth) == b.prefix]
        assert len(at) == 1
        held[at[0]] += 1
    assert max(held.values()) <= 100 and len(held) == len(buckets)


def test_index_has_split_buckets_and_chains_by_bytes(spark):
    rows = [(i, f"text {i % 700}") for i in range(1500)] + [(5000 + i, "copy") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    few = lambda c: F.pmod(F.xxhash64(c), F.lit(90)) * F.lit(2**56) - F.lit(2**62)
    for hash_of in (F.xxhash64, lambda c: few(c).cast("long")):
        index, cells, bits = exthash.build_index(docs, hash_of=hash_of, capacity=16)
        table = index.collect()
        assert len(table) == 701 and sum(r.group_size for r in table) == len(rows)
        numbers = [r.cell for r in cells.collect()]  # a part of the range without hashes has no bucket
        assert bits > 1 and len(set(numbers)) == len(numbers) and max(numbers) < 2**bits and len({(r.prefix, r.depth) for r in table}) > 4
        assert all(r.prefix == ((r.h % (1 << 64)) >> (64 - r.depth) if r.depth else 0) for r in table)
        chains = defaultdict(list)
        for r in table:
            chains[r.h].append(r)
        assert all(sorted(r.chain_no for r in c) == list(range(1, len(c) + 1)) and {r.chain_len for r in c} == {len(c)} for c in chains.values())
        assert all((r.norm is None) == (r.chain_len == 1) for r in table)
        got = exthash.exact_dedup(docs, hash_of=hash_of, capacity=16).groupBy("text").agg(F.min("keep_id"), F.max("group_size"), F.sum(F.col("kept").cast("int"))).collect()
        first = {}
        for d, t in rows:
            first.setdefault(t, []).append(d)
        assert sorted(map(tuple, got)) == sorted((t, d[0], len(d), 1) for t, d in first.items())


def test_mixed_documents_give_each_row_its_own_share(spark):
    rows = [(1, f"w{i} x y", "a", i) for i in range(3)] + [(None, "p q", "a", 7)] * 4 + [(None, None, None, 8), (2, "", "b", 9), (3, "one two three four " * 5000, "b", 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _row0 int").repartition(3)
    for weights in ((5, 2, 1), (1, 50), (50, 1)):
        plan = mixing.mix(docs, weights=weights)
        mixed = mixing.mixed_documents(docs, weights=weights)
        assert mixed.columns == docs.columns
        made = Counter()
        for r in mixed.collect():
            made[r.doc_id, r.source] += len(brute.words(r.text))
        want = Counter()
        for r in plan.collect():
            want[r.doc_id, r.source] += r.taken
        assert made == +want
        by_source = Counter()
        for (_, source), n in made.items():
            by_source[source] += n
        assert all(by_source[r.source] == int(r.target) for r in plan.collect() if r.source_size)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(5)
    for n, letters, depth in [(1, 2, 8), (2, 1, 8), (400, 1, 200), (500, 2, 20), (3000, 3, 200), (2000, 256, 9)]:
        text = rng.integers(0, letters, n).astype(np.uint8)
        raw, order = text.tobytes(), suffixdup.suffix_array(text, depth)
        keys = [raw[i : i + depth] for i in order]
        assert sorted(order.tolist()) == list(range(n)) and keys == sorted(keys)
        if n > 1:
            assert suffixdup.same_prefix(text, order, depth).tolist() == [len(x) == depth and x == y for x, y in zip(keys, keys[1:])]


@pytest.mark.parametrize("buckets", [1, 5])
def test_suffix_dedup(docs, rows, buckets):
    found = suffixdup.suffix_dedup(docs, buckets=buckets)
    got = multiset(found.withColumn("sha", F.sha2("kept_bytes", 256)), "doc_id", "n_bytes", "n_removed", "n_spans", "sha")
    assert got == sorted(((d, *x) for (d, _), x in zip(rows, brute.repeated_bytes(rows))), key=repr)


def test_suffix_dedup_over_small_slices(spark, monkeypatch):
    monkeypatch.setattr(suffixdup, "SLICE", 2000)
    monkeypatch.setattr(suffixdup, "BLOCK", 1000)
    rng = random.Random(3)
    pool = ["".join(rng.choice("abc \n") for _ in range(rng.randrange(50, 700))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pool)[rng.randrange(40) :] for _ in range(rng.randrange(1, 5)))) for i in range(60)]
    got = multiset(suffixdup.suffix_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).withColumn("sha", F.sha2("kept_bytes", 256)), "doc_id", "n_bytes", "n_removed", "n_spans", "sha")
    assert got == sorted(((d, *x) for (d, _), x in zip(rows, brute.repeated_bytes(rows))), key=repr)


@pytest.mark.parametrize("buckets", [1, 5])
def test_substring_dedup(docs, rows, buckets):
    found = superkmer.substring_dedup(docs, buckets=buckets)
    got = multiset(found.withColumn("sha", F.sha2("kept_text", 256)), "doc_id", "n_words", "n_removed", "sha")
    assert got == sorted(((d, *x) for (d, _), x in zip(rows, brute.repeated_words(rows))), key=repr)


def test_substring_dedup_over_small_slices(spark, monkeypatch):
    monkeypatch.setattr(superkmer, "SLICE", 1500)
    rng = random.Random(4)
    rows = [(rng.randrange(40), " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 90)))) for i in range(80)]
    got = multiset(superkmer.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).withColumn("sha", F.sha2("kept_text", 256)), "doc_id", "n_words", "n_removed", "sha")
    assert got == sorted(((d, *x) for (d, _), x in zip(rows, brute.repeated_words(rows))), key=repr)


def passages(n, words, around):
    rng = random.Random(12)
    return [(d, " ".join([*(f"{rng.randrange(10**6)}" for _ in range(around)), *(f"common{i}" for i in range(words)), *(f"{rng.randrange(10**6)}" for _ in range(around))])) for d in range(n)]


def test_hot_anchor_is_dealt_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffixdup, "BLOCK", 20_000)
    rows = passages(600, 40, 25)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    table = pa.table({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows], "tag": pa.array([0] * len(rows), pa.int32())})
    most = {}
    for widths in ((0,), (32,), (8,), (1,)):
        hot = suffixdup.hot_keys(suffixdup.tagged(docs), suffixdup.Segments(200, 64).sizes, suffixdup.SLICE, suffixdup.BLOCK, widths) if widths[0] else None
        made = suffixdup.Segments(200, 64, hot)
        held, windows = defaultdict(int), 0
        for batch in made(table.to_batches()):
            for value in batch.column("value"):
                parts = suffixdup.unpack(value.as_buffer())
                for anchor, size in zip(np.frombuffer(parts[4], np.uint32).tolist(), np.frombuffer(parts[3], np.int32).tolist()):
                    held[anchor] += size
                    windows += size
        most[widths[0]] = max(held.values()) / windows  # the largest share of the windows that goes by one key
    assert most[1] <= most[8] < most[32] < most[0] / 3 and most[1] < 0.01
    assert suffixdup.repeated_spans(docs).count() <= 10 * len(rows)  # some 160 windows of each text repeat; runs of them stay together
    got = multiset(suffixdup.suffix_dedup(docs).withColumn("sha", F.sha2("kept_bytes", 256)), "doc_id", "n_bytes", "n_removed", "n_spans", "sha")
    assert got == sorted(((d, *x) for (d, _), x in zip(rows, brute.repeated_bytes(rows))), key=repr)


def test_hot_minimiser_is_dealt_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(superkmer, "HOT", 500)
    rows = passages(600, 20, 15)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    table = pa.table({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows], "tag": pa.array([0] * len(rows), pa.int32())})
    made = superkmer.SuperKmers(13, 3, 64, superkmer.hot_keys(superkmer.tagged(docs), superkmer.SuperKmers(13, 3, 64).sizes, superkmer.SLICE, superkmer.HOT, (1,)))
    held = [int(np.frombuffer(superkmer.unpack(v.as_buffer())[3], np.uint8).sum()) for b in made(table.to_batches()) for v in b.column("value")]
    assert max(held) <= 3 * sum(held) / 64
    got = multiset(superkmer.substring_dedup(docs).withColumn("sha", F.sha2("kept_text", 256)), "doc_id", "n_words", "n_removed", "sha")
    assert got == sorted(((d, *x) for (d, _), x in zip(rows, brute.repeated_words(rows))), key=repr)


def test_equal_hashes_of_different_windows_are_told_apart(monkeypatch):
    codes = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3, 9, 9, 9], np.int64)
    monkeypatch.setattr(superkmer, "mixed", lambda x: np.zeros(len(x), np.uint64))
    got = superkmer.Counted(3).repeated(codes, np.array([0, 3, 6, 9]), np.array([1, 2, 3, 4]))
    assert got.tolist() == [False, False, True, False]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return lambda name: Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_the_library(tokenizer, rows, name, spaces):
    odd = ["The, cat. sat!! ON: mat|x ABC.DEF É, é.ß, naïve;ñ", "it.s a.'s b,'t x.\u0301y E\u0301, ÉCOLE. Ω, İ.", "  a  b   c \n\n d\t\te ", "x y z    q", "don't we'll  'S\n'ss", "́ é ÉCOLE ΣΑΣ", "a\x00b  c", "\n", "1234 56,78 --  \r\n\r\nx \x0b", "trail  "]
    texts = [t for _, t in rows] + odd
    ids, offsets = Encoder(public_tokenizers.path(name), spaces)(pa.array(texts, pa.string()), 7)
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == [*tokenizer(name).encode(text or "", add_special_tokens=False).ids, 7]


def test_token_file_gives_any_range():
    rng = np.random.default_rng(2)
    for n, top in [(1, 200), (5000, 70_000), (3000, 1 << 32), (0, 9)]:
        ids = rng.integers(0, top, n).astype(np.uint32)
        starts = np.array([0, n // 3, n])
        file = tokenfile.TokenFile(io.BytesIO(tokenfile.encode(ids, [4, None], starts)))
        names, got = file.documents()
        assert names == [4, None] and got.tolist() == starts.tolist() and file.n_ids == n
        for a, b in [(0, n), (n // 2, n // 2 + min(n, 1)), (n // 3, n - n // 5), *[sorted(rng.integers(0, n + 1, 2).tolist()) for _ in range(30)]]:
            assert np.array_equal(file.ids(a, b), ids[a:b])


def test_token_files_round_trip(docs, rows, tokenizer, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_IDS", 3000)
    folder, manifest = tokenfile.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), True, 0)
    got = tokenfile.read_tokens(folder, manifest).orderBy("start").collect()
    assert manifest.count() > 5
    encode, at, want = tokenizer("byte_bpe_50k.json").encode, 0, defaultdict(list)
    for d, t in rows:
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[d].append((len(ids), zlib.crc32(ids.tobytes())))
    known = [r.doc_id for r in got]
    assert known == sorted(known, key=lambda d: (d is None, d))
    for r in got:
        assert r.start == at
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    assert not any(want.values())


def test_packing(docs, rows, tokenizer):
    got = cutting.pack(docs, public_tokenizers.path("word_bpe_49k.json"), False, 1, with_ids=True).collect()
    encode, left = tokenizer("word_bpe_49k.json").encode, defaultdict(list)
    for d, t in rows:
        left[d].append([*encode(t or "", add_special_tokens=False).ids, 1])
    pieces = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 2048 and zlib.crc32(r.ids) == r.ids_crc32
        assert any(len(x) == r.doc_tokens and x[r.start : r.start + r.length] == ids.tolist() for x in left[r.doc_id])
        pieces[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(x) for v in left.values() for x in v)
    for group in pieces.values():
        at = 0
        for offset, length in sorted(group):
            assert offset == at
            at += length
        assert at <= 2048


def test_plan_covers_the_histogram_with_little_waste():
    rng = np.random.default_rng(6)
    for scale in (1, 50):
        histogram = {int(s): int(n) * scale for s, n in zip(rng.choice(np.arange(1, 129), 60, replace=False), rng.integers(1, 40, 60))}
        made, total = cutting.plan(histogram, 128), sum(s * n for s, n in histogram.items())
        held = defaultdict(int)
        for pattern, times in made:
            assert sum(s * a for s, a in pattern.items()) <= 128
            for s, a in pattern.items():
                held[s] += a * times
        assert dict(held) == histogram
        sizes = np.array(sorted(histogram))
        least = cutting.column_generation(sizes, np.array([float(histogram[int(s)]) for s in sizes]), 128)[1].sum()
        assert total / 128 <= least + 1e-6 and sum(t for _, t in made) <= 1.01 * least + 6
    assert cutting.plan({}, 128) == []


def test_near_duplicates(docs, rows):
    got = ordermin.near_duplicates(docs)
    classes = brute.near_classes(rows)
    ids, sizes = defaultdict(list), defaultdict(int)
    for (d, _), c in zip(rows, classes):
        ids[c].append(d)
        sizes[c] += 1
    least = {c: min((x for x in v if x is not None), default=None) for c, v in ids.items()}
    assert multiset(got, "doc_id", "class_id", "class_size") == sorted(((d, least[c], sizes[c]) for (d, _), c in zip(rows, classes)), key=repr)
    assert sorted((r.doc_id for r in got.where("kept").collect()), key=repr) == sorted(least.values(), key=repr)
    kept = ordermin.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(least)


def test_near_duplicate_classes_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in table.collect())
    classes = brute.near_classes(rows)
    got = dict(multiset(ordermin.near_duplicates(table), "doc_id", "class_id"))
    assert got == {d: rows[c][0] for (d, _), c in zip(rows, classes)}


def near_family(seed, texts, edits):
    rng = random.Random(seed)
    base, rows = [f"w{i}" for i in range(100)], []
    for d in range(texts):
        w = list(base)
        for i in rng.sample(range(100), edits):
            w[i] = f"x{d}_{i}"
        rows.append((d, " ".join(w)))
    return rows


def test_near_duplicates_of_one_large_group_around_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(ordermin, "ROWS", 100)
    rows = near_family(1, 250, 2)
    classes = brute.near_classes(rows)
    assert 150 < len(set(classes)) < 240
    got = dict(multiset(ordermin.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")), "doc_id", "class_id"))
    assert got == {d: rows[c][0] for (d, _), c in zip(rows, classes)}


def test_common_shingles_are_counted_with_repeats():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint32) for _ in range(12)]
    # Different texts only: shingles that one text alone has do not count for it.
    rows, left, right = np.repeat(np.arange(12), [len(x) for x in texts]), np.arange(5), np.arange(5, 12)
    got = ordermin.overlaps(rows, np.concatenate(texts), left, right, 12)
    assert got.tolist() == [[sum((Counter(texts[a].tolist()) & Counter(texts[b].tolist())).values()) for b in right] for a in left]


def test_alignment_is_the_banded_one():
    rng = np.random.default_rng(9)
    for _ in range(60):
        a = rng.integers(0, rng.choice([3, 400]), rng.integers(1, 80)).astype(np.uint32)
        b = np.delete(a, rng.integers(0, len(a), rng.integers(0, 6))) if rng.random() < 0.7 else rng.permutation(a)
        n = brute.common(a.tolist(), b.tolist())
        want = n >= 0.8 * (len(a) + len(b) - n) - 1e-9
        assert ordermin.aligned(a, b, 0.8) == want


def test_components_of_long_chains(spark):
    names = [f"{i:04d}" for i in range(60)]
    edges = [(names[i], names[i + 1]) for i in range(40)] + [(names[59], names[i]) for i in range(45, 59)]
    got = {r.node: r.root for r in ordermin.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[n] for n in names[1:41]} == {"0000"} and {got[n] for n in names[46:]} == {"0045"}


def test_mix(docs, rows):
    got = mixing.mix(docs).collect()
    assert sorted((r.size for r in got)) == sorted(len(brute.words(t)) for _, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size
    total = sum(r.size for r in got)
    for group in by.values():
        assert sum(r.taken for r in group) == int(group[0].target) and group[0].source_size == sum(r.size for r in group)
        assert group[0].target <= 2 * group[0].source_size
    assert sum(g[0].target for g in by.values()) == pytest.approx(1.5 * total)
    assert multiset(mixing.mix(docs), "doc_id", "size", "taken") == multiset(mixing.mix(docs.repartition(7)), "doc_id", "size", "taken")


def test_mixed_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    plan = {r.doc_id: r for r in mixing.mix(table).collect()}
    made = mixing.mixed_documents(table)
    assert made.columns == table.columns
    taken = defaultdict(int)
    for r in made.collect():
        taken[r.doc_id] += len(brute.words(r.text))
    assert dict(taken) == {d: r.taken for d, r in plan.items() if r.taken}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x/{i}", "<p>" + prose(i, 30) + "</p>") for i in range(300)] + [(None, None, None), (5, "a b\r\nX: y", ""), (5, "http://x/5", "é" * 5000), (7, "u", None), (7, "u", None)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("file", F.lit("clash")).repartition(3)


def test_archive_round_trip_and_audit(spark, pages):
    audit, folder, copy = warc.audited_archive(spark, pages, (F.col("page_id") % 50 == 3) | F.col("page_id").isNull())
    found = audit.collect()
    assert len(found) == pages.count()
    for r in found:
        hit = r.page_id is None or r.page_id % 50 == 3
        assert (r.intact, r.left_damaged, r.right_damaged) == (not hit, False, hit)
    back = warc.read_records(audit.withColumn("folder", F.lit(folder)))
    want = sorted((r.page_id, brute.sha((r.html or "").encode())) if r.page_id is not None else (-1, brute.sha(b"")) for r in pages.collect())
    assert sorted((-1 if r.page_id is None else r.page_id, brute.sha(bytes(r.payload))) for r in back.collect()) == want


def test_audit_finds_missing_and_short_files(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    monkeypatch.setattr(warc, "FANOUT", 4)
    audit, folder, copy = warc.audited_archive(spark, pages)
    assert audit.where("NOT intact").count() == 0
    index = audit.drop("intact", "left_damaged", "right_damaged")
    names = sorted({r.file for r in index.collect()})
    fs, root = pyarrow.fs.FileSystem.from_uri(copy)
    fs.delete_file(f"{root}/{names[0]}")
    data = fs.open_input_file(f"{root}/{names[1]}").read()
    with fs.open_output_stream(f"{root}/{names[1]}", compression=None) as out:
        out.write(data[:-5])
    last = max(r.seq for r in index.collect() if r.file == names[1])
    bad = {(r.file, r.seq) for r in warc.audit(index, folder, copy).where("right_damaged").collect()}
    assert bad == {(r.file, r.seq) for r in index.collect() if r.file == names[0]} | {(names[1], last)}


def test_rotation(spark):
    rows = [
        (1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo <|im_end|>"), (1, 3, "cy", None), (1, None, "ann", "late"), (2, 0, "system", "alone"),
        (None, 0, None, "who"), (None, 1, " ", "me"), (None, 2, "ann", "you"), (3, 0, "ann", "same"), (3, 0, "ann", "same"),
    ]
    table = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumn("perspective", F.lit("clash")).withColumn("start", F.lit(1))
    texts, masks = defaultdict(str), defaultdict(list)
    for r in sorted(chat.rotate(table).collect(), key=lambda r: r.start):
        key = (r.conv_id, r.perspective)
        assert r.start == len(texts[key])
        texts[key] += r.piece
        if r.mask_start is not None:
            masks[key].append((r.mask_start, r.mask_end))
    assert set(texts) == {(1, "ann"), (1, "bob"), (1, "cy"), (None, "unknown"), (None, "ann"), (3, "ann")}
    assert texts[1, "bob"] == (
        "<|im_start|>system\nrules<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\nyo < |im_end|><|im_end|>\n"
        "<|im_start|>user name=cy\n<|im_end|>\n<|im_start|>user name=ann\nlate<|im_end|>\n"
    )
    assert [texts[1, "ann"][a:b] for a, b in masks[1, "ann"]] == ["hi<|im_end|>", "late<|im_end|>"]
    assert [texts[None, "unknown"][a:b] for a, b in masks[None, "unknown"]] == ["who<|im_end|>", "me<|im_end|>"]
    assert len(masks[3, "ann"]) == 2


def test_empty_tables(spark, docs, pages):
    none = docs.limit(0)
    token = public_tokenizers.path("word_bpe_49k.json")
    folder, manifest = tokenfile.write_tokens(none, token, False, 0)
    chats = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    made = [
        quality.quality_cascade(none), exthash.one_row_per_key(exthash.exact_dedup(none)), suffixdup.suffix_dedup(none), superkmer.substring_dedup(none),
        tokenfile.read_tokens(folder, manifest), cutting.pack(none, token, False, 1), ordermin.near_duplicates(none), ordermin.kept_documents(none),
        mixing.mix(none), mixing.mixed_documents(none), chat.rotate(chats), warc.audited_archive(spark, pages.limit(0))[0],
    ]
    assert [df.count() for df in made] == [0] * len(made)


def test_scratch_is_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_records_lost_or_wrong_in_both_replicas_are_damaged(spark, pages):
    index = warc.write_archive(pages, folder := scratch_path(spark, "warc"))
    lost = sorted(r.file for r in index.select("file").distinct().collect())[0]
    flips = index.where("page_id = 9").select("file", F.col("offset").alias("place"))
    left, right = (scratch_path(spark, "warc-copy") for _ in range(2))
    for copy in (left, right):
        warc.replicate(index, folder, copy, flips)
        fs, root = pyarrow.fs.FileSystem.from_uri(copy)
        fs.open_output_stream(f"{root}/{lost}", compression=None).close()
    for r in warc.audit(index, left, right).collect():
        hit = r.file == lost or r.page_id == 9
        assert (r.intact, r.left_damaged, r.right_damaged) == (not hit, hit, hit)

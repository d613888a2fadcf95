"""Cover-tree codes, phrase collocations and language models against plain versions."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from seacast.llm import charlm, covertree, cutting, phrases, queries, superkmer
from seacast.llm.blocks import Powers
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


# --- codes ---


def plain_codes(rows, parts, entries, rounds, scale):
    kept = [(i, lab, [math.floor(scale * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    width = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[list(cut(r[2], p)) for r in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, v: min(range(len(books[p])), key=lambda e: (dist(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, _, v in kept:
                groups[near(p, v)].append(cut(v, p))
            for e, members in groups.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for i, lab, v in kept:
        codes = [near(p, v) for p in range(parts)]
        out.append((i, lab, "".join(f"{c:02x}" for c in codes), sum(dist(cut(v, p), books[p][c]) for p, c in enumerate(codes))))
    return out, books


def vectors():
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)], i % 3 if i % 7 else None) for i in range(300)]
    rows += [(None, [0.1] * 8, 1), (4, [0.5] * 8, 2), (4, [0.5] * 8, 2), (900, None, 1), (901, [0.1] * 7 + [None], 1), (902, [0.1] * 7 + [float("nan")], 1), (903, [float("inf")] + [0.1] * 7, 1)]
    return rows + [(1000 + i, [0.25] * 8, 9) for i in range(150)]  # many equal vectors


def test_codes_are_those_of_plain_lloyd(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, entry int, code string").repartition(5)
    for parts, entries in ((4, 8), (1, 16), (8, 3)):
        coded, books = covertree.compress(df, parts=parts, entries=entries, rounds=4, scale=64)
        want, plain = plain_codes(rows, parts, entries, 4, 64)
        assert books.tolist() == plain
        got = covertree.with_group_error(coded).collect()
        assert sorted(((r.id, r.label, r.code, r.error) for r in got), key=repr) == sorted(want, key=repr)
        sums = Counter()
        for _, lab, _, error in want:
            sums[lab] += error
        assert all(r.label_error == sums[r.label] for r in got)


def test_codes_of_few_or_no_rows(spark):
    kind = "vec_id bigint, embedding array<float>, label string"
    none, books = covertree.compress(spark.createDataFrame([(1, None, "a")], kind))
    assert none.collect() == [] and none.columns == ["id", "label", "code", "error"] and books.size == 0
    one, books = covertree.compress(spark.createDataFrame([(1, [0.5] * 16, "a")], kind))
    assert [tuple(r) for r in one.collect()] == [(1, "a", "00" * 8, 0)] and books.shape == (8, 1, 2)
    for bad in ([(1, [0.5] * 16, "a"), (2, [0.5] * 8, "a")], [(1, [0.5] * 9, "a")]):
        with pytest.raises(ValueError, match="components"):
            covertree.compress(spark.createDataFrame(bad, kind))
    with pytest.raises(Exception, match="would not be exact"):
        covertree.compress(spark.createDataFrame([(1, [1e30] * 8, "a")], kind))


def test_cover_trees_hold_their_invariants_and_prune():
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.integers(-40, 40, (1500, 4)) + 4000 * rng.integers(-2, 3, (1500, 1)), np.zeros((50, 4), int)])
    tree, place = covertree.CoverTree.build(v)
    assert (tree.points[place] == v).all() and tree.weights.sum() == len(v)
    level = {0: 0}
    for k in range(len(tree.centre)):
        inside = tree.points[tree.start[k] : tree.end[k]]
        assert covertree.squared(inside, tree.points[tree.centre[k]]).max() == tree.reach[k]
        kids = range(tree.child[k], tree.child[k] + tree.children[k])
        level |= {c: level[k] + 1 for c in kids}
        assert not kids or [tree.start[kids[0]], *(tree.end[c] for c in kids)] == [*(tree.start[c] for c in kids), tree.end[k]]
        centres = tree.points[tree.centre[list(kids)]] if kids else []
        bound = int(tree.reach[0]) // 4 ** (level[k] + 1)
        assert all((covertree.squared(centres[i + 1 :], centres[i]) > bound).all() for i in range(len(centres)))
    entries = v[:: len(v) // 10]
    codes, exact = tree.assign(entries)
    assert (codes[place] == covertree.squared(v[:, None], entries[None]).argmin(axis=1)).all()
    assert exact < len(tree.points)
    middles = 4000 * np.arange(-2, 3)[:, None] * np.ones((1, 4), int)
    codes, exact = tree.assign(middles)  # one entry a cluster: no point is compared by itself
    assert exact == 0 and (codes[place] == covertree.squared(v[:, None], middles[None]).argmin(axis=1)).all()


# --- phrases ---


def plain_collocations(rows, least=10, share=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in often.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    inside[q] = max(inside[q], a)
        found = []
        for p, a in often.items():
            if len(p) == 2 and 100 * inside[p] >= share * a:
                continue
            score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def phrase_rows():
    rng = random.Random(11)
    vocabulary = ["The", "sea", "is", "École", "of", "salt", "wind\x0bfrom", "a b", "x\x1cy", "!", ".", ",", "\n", "\t", "and", "\r\n", "Ω"]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randrange(60))), rng.choice(["en", "fr", None, "und"])) for _ in range(120)]
    rows += [(None, "en"), ("", None), (" \t ", "en"), ("salt " * 30000 + "of the sea", "en"), ("lone", "de"), ("a b c " * 12, "es"), ("a b c", "es"), ("a b d. a b", "es")]
    return rows + [("copied text of the north sea. more", "fr")] * 40


def test_collocations_equal_plain_counting(spark):
    rows = phrase_rows()
    df = spark.createDataFrame([(t, g, i, "x", 1) for i, (t, g) in enumerate(rows)], "text string, lang string, doc_id int, phrase string, words int").repartition(4)
    want = plain_collocations(rows)
    assert sorted(tuple(r) for r in phrases.collocations(df).collect()) == want
    few = plain_collocations(rows, 3, 90, 5)
    assert sorted(tuple(r) for r in phrases.collocations(df, least=3, share=90, top=5, buckets=3).collect()) == few
    assert phrases.collocations(df.limit(0)).collect() == []


def test_equal_fingerprints_of_different_phrases_are_told_apart():
    rows = phrase_rows()
    want = Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall("[^ \t]+", piece)
            want.update((lang or "und", " ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    data = [(t or "").encode() for t, _ in rows]
    names = sorted({g or "und" for _, g in rows})
    one = phrases.Slice(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data]), np.array([names.index(g or "und") for _, g in rows], np.int32), names)
    for few in (None, np.uint64(3)):  # with four values of a fingerprint, nearly all collide
        real = phrases.mixed
        phrases.mixed = real if few is None else lambda x: real(x) & few
        try:
            _, at, n, count = one.distinct(3)
        finally:
            phrases.mixed = real
        text, sizes = one.phrases(at, n)
        ends = np.cumsum(sizes)
        got = Counter()
        for a, b, w, c in zip(ends - sizes, ends, at, count):
            got[names[one.lang[w]], text[a:b].decode()] += int(c)
        assert got == want


# --- languages ---


def plain_chars(text):
    return re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).lstrip(" ")


def plain_model(texts, order, chars):
    counts = {order: Counter()}
    for t in texts:
        s = "\n" * (order - 1) + plain_chars(t)
        counts[order].update(s[i - order + 1 : i + 1] for i in range(order - 1, len(s)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    total, kinds, discount = Counter(), Counter(), {}
    for k, table in counts.items():
        one, two = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
        discount[k] = one / (one + 2 * two) if one and two else 0.5
        for g, v in table.items():
            total[g[:-1], k] += v
            kinds[g[:-1], k] += 1

    def p(window):
        out = 1 / chars
        for k in range(1, order + 1):
            g = window[order - k :]
            t = total[g[:-1], k]
            if t:
                out = max(counts[k][g] - discount[k], 0) / t + discount[k] * kinds[g[:-1], k] / t * out
        return out

    return p


def plain_entropy(p, text, order):
    s = "\n" * (order - 1) + plain_chars(text)
    return sum(-math.log2(p(s[i - order + 1 : i + 1])) for i in range(order - 1, len(s))) / max(len(s) - order + 1, 1)


def language_rows(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    extra = [(None, None, "en"), (None, "un mot", "fr"), (1001, None, "de"), (1002, "", "en"), (1003, "12 34 !?", "es"), (1004, "the the of and", None), (1005, "K", "xx"), (1006, "İstanbul ǅ 日本", "xx"), (1007, "la " * 9000, "es")]
    return docs + extra + docs[:2]


@pytest.mark.parametrize("entries", [charlm.ENTRIES, 0])
def test_entropies_are_those_of_a_plain_model(spark, entries):
    rows, order = language_rows(spark), 3
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, place int").repartition(3)
    learn = [r for r in rows if r[1] is not None and r[2] is not None]
    langs = sorted({r[2] for r in learn if plain_chars(r[1])})
    chars = len({c for r in learn for c in plain_chars(r[1])}) + 1
    models = [plain_model([t for _, t, g in learn if g == lang], order, chars) for lang in langs]
    model = charlm.fit(df.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang"), order)
    got = charlm.entropies(df.select("place", "text"), model, langs, order, entries).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r.place][1] or ""
        assert (r.letters, r.chars) == (sum(c.isalpha() for c in text.lower()), len(plain_chars(text)))
        assert r.entropies == pytest.approx([plain_entropy(p, text, order) for p in models] if r.chars else [0.0] * len(langs), abs=1e-9)


def test_languages_are_predicted(spark):
    rows = language_rows(spark)
    df = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id bigint, text string, lang string, score double, size int")
    got = charlm.identify(df.drop("score"), F.lit(True), F.col("doc_id")).collect()
    assert len(got) == len(rows)
    learned = {r[2] for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    texts = defaultdict(list)
    for r in rows:
        texts[r[0], r[2]].append(r[1])
    for r in got:
        known = any(any(c.isalpha() for c in t or "") for t in texts[r.doc_id, r.lang])
        assert 0 <= r.score <= 1 and (r.lang_pred in learned if known else (r.lang_pred, r.score, r.entropy, r.rejected) == ("und", 0, None, False))
    none = charlm.identify(df.select("text", "lang"), F.lit(False), F.lit(1)).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)} and len(none) == len(rows)
    assert charlm.identify(df.limit(0), F.lit(True), F.lit(1)).collect() == []


def test_held_out_accuracy(spark):
    """Only rows that are not held out are learned from: changing the labels of held-out rows changes nothing."""
    got = queries.op13_language_id(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    both = got.merge(docs, on="doc_id")
    held = both[both.held_out]
    assert len(got) == len(docs) and (held.lang == held.lang_pred).mean() > 0.99


@pytest.mark.parametrize("name", ["op11_cover_tree_codes", "op12_phrases"])
def test_queries_equal_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) is None


# --- memory of a slice ---


def traced_mb(work):
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def test_powers_of_places_beyond_the_table():
    powers, n, rng = Powers(), 200_003, np.random.default_rng(1)
    values, codes, table = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 256, n).astype(np.uint8), rng.integers(0, 2**63, 256).astype(np.uint64)
    up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)])) for base in (Powers.BASE, pow(Powers.BASE, -1, 1 << 64)))
    assert (powers.prefix(values) == np.concatenate([[np.uint64(0)], np.cumsum(values * up[:n], dtype=np.uint64)])).all()
    assert (powers.down(np.arange(n + 1)) == down).all()
    places = np.concatenate([[0], np.sort(rng.integers(0, n + 1, 5000)), [n]])
    whole = np.concatenate([[np.uint64(0)], np.cumsum(table[codes] * up[:n], dtype=np.uint64)])
    assert (powers.prefix_at(table, codes, places) == whole[places]).all()
    assert len(powers.prefix_at(table, codes[:0], places[:0])) == 0


def test_slice_of_phrases_holds_no_numbers_for_each_byte():
    words = ["longword%d" % (i * i % 977) for i in range(100_000)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    one = lambda: phrases.Slice(data, np.array([len(data)]), np.zeros(1, np.int32), ["en"])
    assert traced_mb(lambda: one().distinct(1)) < 40
    key, at, n, count = one().distinct(1)
    assert sorted(count) == sorted(Counter(words).values()) and {words[i] for i in at} == set(words)


def test_windows_of_a_bucket_are_sorted_in_parts():
    rng = np.random.default_rng(2)
    codes, doc = rng.integers(0, 3, 300_000).astype(np.int32), np.sort(rng.integers(0, 500, 299_988))
    at, out = np.arange(len(doc), dtype=np.int32), []
    assert traced_mb(lambda: out.append(superkmer.Counted(13).repeated(codes, at, doc))) < 15
    first = {}
    plain = [first.setdefault(codes[i : i + 13].tobytes(), d) < d for i, d in zip(at.tolist(), doc.tolist())]
    assert out[0].tolist() == plain


def test_packing_encodes_a_few_megabytes_at_a_time():
    seen = []

    class Encoder:
        def __call__(self, texts, end_id):
            seen.append(pc.sum(pc.binary_length(texts)).as_py())
            return np.full(len(texts), end_id, np.uint32), np.arange(len(texts) + 1)

    rows = pa.record_batch({"doc_id": pa.array(range(2000)), "text": pa.array(["x" * 10_000] * 2000)})
    pieces = list(cutting.Cutter(Encoder(), 1, 2048, False)([rows]))
    assert sum(p.num_rows for p in pieces) == 2000 and sum(seen) == 20_000_000
    assert max(seen) < 4 << 20

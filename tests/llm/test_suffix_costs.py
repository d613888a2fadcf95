"""What the suffix arrays do once for many: scans of buckets, segments of a slice."""

import random

import numpy as np
import pyarrow as pa

from seacast.llm import suffixdup
from seacast.llm.blocks import POWERS


def test_buckets_of_first_bytes_are_induced_whole(monkeypatch):
    rng = np.random.default_rng(3)
    text = rng.integers(97, 122, 60_000).astype(np.uint8)
    text[500:540] = 110
    scans, plain = [], np.split
    monkeypatch.setattr(np, "split", lambda *a: (scans.append(1), plain(*a))[1])
    order = suffixdup.suffix_array(text, 60)
    raw = text.tobytes()
    keys = [raw[i : i + 60] for i in order.tolist()]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(text)))
    assert len(scans) < 25 * 8 + 40


def test_segments_are_the_runs_of_windows_with_one_anchor():
    rng = random.Random(11)
    for trial in range(60):
        texts = ["".join(rng.choice("ab" if trial % 3 else "abcdefgh") for _ in range(rng.choice([0, 39, 40, 41, 300]))) for _ in range(rng.randrange(8))]
        texts += ["ab" * 700, "c" * 1500] if trial % 5 == 0 else []
        made = suffixdup.Segments(40, 3)
        _, prefix, offsets = made.bytes(pa.chunked_array([pa.array(texts, pa.string())]))
        starts, sizes, anchors, _, spot, grams = made.runs(prefix, offsets)
        expected = []
        for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
            last = None
            for i in range(a, b - 39):
                low = min(grams[i : i + 17].tolist())
                if low == last and expected[-1][1] < suffixdup.RUN:
                    expected[-1][1] += 1
                else:
                    expected.append([i, 1, low])
                last = low
        assert [list(x) for x in zip(starts.tolist(), sizes.tolist(), anchors.tolist())] == expected
        assert all(p < 0 or grams[s + p] == low for s, p, low in zip(starts.tolist(), spot.tolist(), anchors.tolist()))


def test_inverse_powers_in_order_are_those_of_the_places():
    for n in (0, 1, 65_535, 65_536, 65_537, 200_000):
        assert np.array_equal(POWERS.downs(n), POWERS.down(np.arange(n)))

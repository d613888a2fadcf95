"""What the encoder does once for many: pieces of texts with white space."""

import random

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from seacast.llm import tokens

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_with_white_space_are_encoded_once(monkeypatch):
    seen = []
    plain = tokens.Encoder.encode_pieces
    monkeypatch.setattr(tokens.Encoder, "encode_pieces", lambda self, pieces: (seen.append(pieces.to_pylist()), plain(self, pieces))[1])
    encoder = tokens.Encoder(BYTES, True)
    for text in ["alpha beta, gamma. delta", " beta gamma; delta!", "alpha beta; " + "x" * 100, "x" * 100]:
        encoder(pa.array([text]), 0)
    assert sorted(seen[0]) == sorted(["alpha", " beta", ",", " gamma", ".", " delta"])
    assert sorted(seen[1]) == sorted([";", "!"])
    assert seen[2] == [" " + "x" * 100] and seen[3] == ["x" * 100]
    monkeypatch.setattr(tokens, "KEPT_PIECES", 3)
    few = tokens.Encoder(BYTES, True)
    few.kept = encoder.kept[0][:2], encoder.kept[1], encoder.kept[2][:2]
    few(pa.array(["one two three"]), 0)
    assert len(few.kept[0]) == 3


def test_cut_texts_have_the_ids_of_whole_ones():
    rng, library = random.Random(5), Tokenizer.from_file(BYTES)
    signs = [*"aZé÷×ÿΩ0'’.,!?;:|<>$ \n\t\r", "́", " ", "\x00", "\x1c", "<|endoftext|>", "'s", "'ll ", " a", ". ", "İ", "中", "😀"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts[7], texts[9] = None, ""
    encoder = tokens.Encoder(BYTES, True)
    for array in (pa.array(texts[:20]), pa.array(texts).slice(20), pa.array(texts[:3], pa.large_string()), pa.array([], pa.string()), pa.array([None], pa.string())):
        ids, offsets = encoder(array, 0)
        assert len(offsets) == len(array) + 1 and offsets[-1] == len(ids)
        for i, text in enumerate(array.to_pylist()):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_of_a_slice_share_its_bytes():
    whole = pa.array(["zero", "a b, c.d", "", " é.f"])
    for skipped in range(4):
        pieces, offsets = tokens.cut(whole.slice(skipped))
        lists = [pieces[a:b].to_pylist() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        assert lists == [["zero"], ["a", " b", ",", " c", ".d"], [], [" é", ".f"]][skipped:]
        assert pieces.buffers()[2].address == whole.buffers()[2].address

"""Token ids of many texts with the tokenizers library, each distinct piece encoded once per slice, common ones once."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from seacast.llm.blocks import ragged

#: White space outside ASCII, and the mark between pieces: texts with one of these are encoded whole.
_WHOLE = "[\x00\u0085\u00a0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Letters, in all versions of Unicode, and signs that never belong to the same pre-token as a letter before them.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIGN = "([" + _LETTER + "])([.,!?;:|#*$%&<>()])"
_SPECIAL = "<[|](start|end)oftext[|]>"
#: Whether a byte is ASCII white space, an ASCII letter, or a sign after which no word goes on and that no special token has.
_SPACES, _LETTERS, _STOPS = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b" \t\n\v\f\r", bytes(range(65, 91)) + bytes(range(97, 123)), b".,!?;:"))
#: Characters that the library encodes in one call, and common words whose ids a process keeps.
HELD, KEPT = 1 << 18, 300_000
#: Pieces with white space whose ids a process keeps, and bytes of the longest of them.
KEPT_PIECES, LONGEST = 1 << 20, 64


_WORKER: dict[tuple[str, bool], Encoder] = {}


def shared(path: str, spaces: bool) -> Encoder:
    """The encoder of this process for a vocabulary; only the last one used is kept."""
    if (path, spaces) not in _WORKER:
        _WORKER.clear()
        _WORKER[path, spaces] = Encoder(path, spaces)
    return _WORKER[path, spaces]


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pieces, offsets): the texts cut before white space that follows another character and before a stop that follows a
    letter, and where each text's pieces begin, with the end. The pieces share the bytes of the texts."""
    texts = texts.cast(pa.string())
    _, places, data = texts.buffers()
    ends = np.frombuffer(places, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[: ends[-1]] if data is not None else np.zeros(0, np.uint8)
    head = np.zeros(len(raw) + 1, bool)
    white = _SPACES[raw]
    head[1:-1] = white[1:] & ~white[:-1]
    stops = np.flatnonzero(_STOPS[raw[1:]]) + 1
    before = raw[stops - 1]
    # Bytes after 0xC3 are the letters from U+00C0 to U+00FF and two signs.
    letter = _LETTERS[before] | ((raw[stops - 2] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (stops > 1))
    head[stops[letter]] = True
    head[: ends[0]] = False
    head[ends] = True
    begins = np.flatnonzero(head).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(begins) - 1, [None, pa.py_buffer(begins), data]), np.searchsorted(begins, ends)


class Encoder:
    """Encodes texts by pieces: a run of ASCII white space and what follows it up to the next, without the stops after its last letter.

    No pre-token of the vocabularies used here spans the place between a character and white space
    after it or between a letter and a stop, so the ids of a text are those of its pieces one after the other. ``spaces=False`` is for
    vocabularies that drop white space and case and mark the ends of words with ``</w>``: their pieces
    are the words, in ASCII lower case, without the signs that follow a letter.
    """

    def __reduce__(self):
        """A task gets the encoder of its worker, which has loaded the vocabulary once."""
        return shared, (self.path, self.spaces)

    def __init__(self, path: str, spaces: bool):
        self.path, self.spaces, self.tokenizer = path, spaces, None
        self.kept = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of the texts, each encoded whole; the library's encodings of at most ``HELD`` characters (or one text) are there at once."""
        ids, sizes, first, held = [np.zeros(0, np.uint32)], [], 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= HELD or i + 1 == len(texts):
                for e in self.loaded().encode_batch_fast(texts[first : i + 1], add_special_tokens=False):
                    ids.append(np.array(e.ids, np.uint32))
                    sizes.append(len(ids[-1]))
                first, held = i + 1, 0
        return np.concatenate(ids), np.cumsum(np.array(sizes, np.int64))

    def loaded(self):
        if self.tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            self.bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
            self.ends_word = np.zeros(len(self.bytes), bool)
            self.ends_word[list(vocabulary.values())] = [t.endswith("</w>") for t in vocabulary]
        return self.tokenizer

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of distinct pieces. Where white space stays, a piece that begins with it may follow another in one
        string, and tokens are told apart by the bytes they stand for."""
        if not self.spaces:
            return self.encode_words(pieces)
        alone = pc.match_substring_regex(pieces, "^[^ \t\n\v\f\r]|[ \t\n\v\f\r]$|^$").to_numpy(zero_copy_only=False)
        order = np.argsort(~alone, kind="stable")
        sizes = pc.binary_length(pieces).to_numpy()[order]
        texts, n = pieces.take(pa.array(order)).to_pylist(), int(alone.sum())
        ids, _ = self.encode(texts[:n] + ["".join(texts[i : i + 1000]) for i in range(n, len(texts), 1000)])
        ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(sizes), side="left") + (sizes > 0)
        counts = np.diff(np.maximum.accumulate(np.where(sizes > 0, ends, 0)), prepend=0)
        starts, back = np.cumsum(counts) - counts, np.argsort(order)
        return ids[ragged(starts[back], counts[back])], np.cumsum(counts[back])

    def encode_words(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of distinct words. Words of letters alone have one end of word each, so many go into one string."""
        letters = pc.match_substring_regex(pieces, f"^[{_LETTER}]+$").to_numpy(zero_copy_only=False)
        order = np.argsort(letters, kind="stable")
        texts, n = pieces.take(pa.array(order)).to_pylist(), int((~letters).sum())
        ids, ends = self.encode(texts[:n])
        more, _ = self.encode([" ".join(texts[i : i + 1000]) for i in range(n, len(texts), 1000)])
        counts = np.concatenate([np.diff(ends, prepend=0), np.diff(np.flatnonzero(self.ends_word[more]) + 1, prepend=0)]).astype(np.int64)
        if len(counts) != len(pieces):
            raise ValueError("the vocabulary does not mark the ends of words")
        ids, starts, back = np.concatenate([ids, more]), np.cumsum(counts) - counts, np.argsort(order)
        return ids[ragged(starts[back], counts[back])], np.cumsum(counts[back])

    def known_pieces(self, coded: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, sizes) of the distinct pieces. Words that a slice has twice are kept for the next slices, up to
        ``KEPT`` of them, and are not encoded again; with white space all short pieces, up to ``KEPT_PIECES``."""
        pieces, (kept, ids, ends) = coded.dictionary, self.kept
        at = pc.fill_null(pc.index_in(pieces, value_set=kept), -1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero(at < 0)
        new, stops = self.encode_pieces(pieces.take(pa.array(fresh)))
        at[fresh] = len(ends) + np.arange(len(fresh))
        every, stops = np.concatenate([ids, new]), np.concatenate([ends, len(ids) + stops])
        sizes = np.diff(stops, prepend=0)
        most = KEPT_PIECES if self.spaces else KEPT
        if len(kept) < most:
            if self.spaces:
                again = pc.binary_length(pieces).to_numpy() <= LONGEST
            else:
                again = np.bincount(coded.indices.to_numpy(), minlength=len(pieces)) > 1
            often = fresh[again[fresh]][: most - len(kept)]
            own = at[often]
            added = every[ragged(stops[own] - sizes[own], sizes[own])]
            self.kept = pa.concat_arrays([kept, pieces.take(pa.array(often))]), np.concatenate([ids, added]), np.concatenate([ends, len(ids) + np.cumsum(sizes[own])])
        return every, (stops - sizes)[at], sizes[at]

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of each text and then ``end_id``; a null text has only that."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _WHOLE if self.spaces else f"{_WHOLE}|{_SPECIAL}")
        plain = pc.if_else(whole, "", texts)
        if self.spaces:
            pieces, first = cut(plain)
        else:
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.replace_substring_regex(plain, _SIGN, "\\1 \\2")))
            pieces, first = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = pieces.dictionary_encode()
        ids, starts, sizes = self.known_pieces(coded)
        at = coded.indices.to_numpy()
        piece_ids = ids[ragged(starts[at], sizes[at])] if len(at) else ids[:0]
        offsets = np.concatenate([[0], np.cumsum(sizes[at])])[first]
        rest = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if len(rest):
            more, stops = self.encode(texts.take(pa.array(rest)).to_pylist())
            counts = np.diff(offsets)
            counts[rest] = np.diff(stops, prepend=0)
            both = np.concatenate([piece_ids, more])
            begins = offsets[:-1].copy()
            begins[rest] = len(piece_ids) + stops - counts[rest]
            piece_ids, offsets = both[ragged(begins, counts)], np.concatenate([[0], np.cumsum(counts)])
        out = np.full(len(piece_ids) + len(texts), end_id, np.uint32)
        out[np.arange(len(piece_ids)) + np.repeat(np.arange(len(texts)), np.diff(offsets))] = piece_ids
        return out, offsets + np.arange(len(texts) + 1)

"""Tokenizer encoding over Arrow batches, by distinct pieces.

The tokenizers here never merge across certain spaces, so a text is cut there,
the distinct pieces of a batch are encoded once by the ``tokenizers`` library,
and the ids of a text are gathered from those of its pieces. The worker
remembers pieces of up to ``LONGEST`` bytes, ``REMEMBER`` bytes in all; longer
ones (whole texts that cannot be cut) are encoded in every batch. Whole texts are encoded, and the result
is that of encoding each text in one call.
"""

from __future__ import annotations

import sys
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gavel.llm import common, word_hash
from gavel.llm.common import by_value
from gavel.llm.word_hash import string_hashes

by_value(sys.modules[__name__])
by_value(common)
by_value(word_hash)

CHUNK = 2 << 20
REMEMBER, LONGEST = 16 << 20, 64


def ragged(starts, lens):
    """Indices starts[i] .. starts[i] + lens[i] - 1, one run after another."""
    lens = np.asarray(lens, dtype=np.int64)
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lens), lens) + np.arange(total)


class Pieces:
    """Ids of pieces, encoded once each. ``encode`` takes distinct strings.

    Known pieces are found by their hashes in a sorted array and then compared
    in full, so a batch needs Python objects for its new pieces only.

    ``plain`` may name a pattern of pieces that the tokenizer's normaliser and
    splitter leave as one unchanged byte-level word. Those go straight to the
    library's model, as the characters ``letters`` gives their bytes."""

    def __init__(self, tokenizer, plain: str = "", letters: list[str] | None = None):
        import re

        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.plain = re.compile(plain).fullmatch if plain else None
        self.letters = {b: c for b, c in enumerate(letters or [])} | {10: "\n"}
        self.clear()

    def clear(self):
        self.names, self.hashes, self.slots = pa.array([], pa.string()), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.ids, self.start = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        self.held = 0

    def ask(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces from the library."""
        out: list[list[int]] = [[]] * len(pieces)
        is_plain = np.fromiter((m is not None for m in map(self.plain, pieces)), dtype=bool, count=len(pieces)) if self.plain else np.zeros(len(pieces), dtype=bool)
        if is_plain.any():
            ask = self.model.tokenize
            mapped = "\n".join(compress(pieces, is_plain)).encode().decode("latin-1").translate(self.letters).split("\n")
            for i, p in zip(np.flatnonzero(is_plain).tolist(), mapped):
                out[i] = [t.id for t in ask(p)]
        rest = np.flatnonzero(~is_plain).tolist()
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def encode(self, pieces: pa.Array):
        """(flat ids, start, length) of each piece."""
        if self.held > REMEMBER:
            self.clear()
        h = string_hashes(pieces)
        at = np.searchsorted(self.hashes, h)
        hit = np.zeros(len(h), dtype=bool)
        slot = np.zeros(len(h), dtype=np.int64)
        if len(self.hashes):
            near = np.minimum(at, len(self.hashes) - 1)
            hit = self.hashes[near] == h
            slot[hit] = self.slots[near[hit]]
            same = np.asarray(pc.equal(pieces.filter(pa.array(hit)), self.names.take(pa.array(slot[hit]))))
            hit[np.flatnonzero(hit)[~same]] = False
        known, new = np.flatnonzero(hit), np.flatnonzero(~hit)
        first = self.start[slot[known]]
        length = np.zeros(len(h), dtype=np.int64)
        length[known] = self.start[slot[known] + 1] - first
        flat = [self.ids[ragged(first, length[known])]]
        if len(new):
            fresh = pieces.take(pa.array(new))
            got = self.ask(fresh.to_pylist())
            length[new] = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
            flat.append(np.fromiter(chain.from_iterable(got), dtype=np.uint32, count=int(length[new].sum())))
            self.remember(fresh, h[new], length[new], flat[-1])
        order = np.concatenate([known, new])
        start = np.zeros(len(h), dtype=np.int64)
        start[order] = np.cumsum(length[order]) - length[order]
        return np.concatenate(flat), start, length

    def remember(self, pieces: pa.Array, hashes, lens, flat):
        """Add the short ones of new pieces with their ids."""
        size = np.asarray(pc.binary_length(pieces))
        short = np.flatnonzero(size <= LONGEST)
        if not len(short):
            return
        ids = flat[ragged((np.cumsum(lens) - lens)[short], lens[short])]
        order = np.argsort(hashes[short], kind="stable")
        sorted_hashes = hashes[short][order]
        at = np.searchsorted(self.hashes, sorted_hashes)
        self.hashes, self.slots = np.insert(self.hashes, at, sorted_hashes), np.insert(self.slots, at, len(self.names) + order)
        self.names = pa.concat_arrays([self.names, pieces.take(pa.array(short))])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lens[short])])
        self.ids = np.concatenate([self.ids, ids])
        self.held += int(size[short].sum())


def encode_texts(memo: Pieces, texts: pa.Array, cut):
    """Flat ids and the number of ids of each text. ``cut`` turns the texts
    into a list array of pieces."""
    parts = cut(texts)
    first = np.asarray(parts.offsets).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    ids, start, length = memo.encode(coded.dictionary)
    which = np.asarray(coded.indices)
    lens = length[which]
    flat = ids[ragged(start[which], lens)]
    sums = np.concatenate([[0], np.cumsum(lens)])
    return flat, sums[first[1:] - first[0]] - sums[first[:-1] - first[0]]


def lower_words(texts: pa.Array, special: str = "") -> pa.Array:
    """For lower-casing tokenizers that drop white space and split letters from
    marks: cut at runs of space and \\t..\\r, and between a letter a-z and the
    stops after it. A-Z are lower-cased beforehand, so fewer pieces differ.
    Texts that match the pattern ``special`` stay whole and as they are."""
    odd = np.asarray(pc.match_substring_regex(texts, special)) if special else np.zeros(len(texts), dtype=bool)
    plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
    cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(plain), r"([a-z])([.,;:!?]+)", r"\1 \2"))
    if not odd.any():
        return cut
    off = np.asarray(cut.offsets).astype(np.int64) - cut.offsets[0].as_py()
    at = np.zeros(int(off[-1]), dtype=bool)
    at[off[:-1][odd]] = True  # the empty text is one empty piece
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pc.replace_with_mask(cut.flatten(), pa.array(at), texts.filter(pa.array(odd))))


def before_spaces(texts: pa.Array) -> pa.Array:
    """Cut before each single space that stands before a character which is not
    white space. Texts with a space before white space or at their end stay
    whole."""
    odd = np.asarray(pc.match_substring_regex(texts, r"[ ]([\s\v\x{1C}-\x{1F}\x{85}\p{Z}]|\z)"))
    cut = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
    off = np.asarray(cut.offsets).astype(np.int64)
    flat = cut.flatten()
    lead = np.ones(len(flat), dtype=bool)
    lead[off[:-1] - off[0]] = False
    flat = pc.if_else(pa.array(lead), pc.binary_join_element_wise("", flat, " "), flat)
    if odd.any():
        at = np.zeros(len(flat), dtype=bool)
        at[(off[:-1] - off[0])[odd]] = True
        flat = pc.replace_with_mask(flat, pa.array(at), texts.filter(pa.array(odd)))
    return pa.ListArray.from_arrays(pa.array((off - off[0]).astype(np.int32)), flat)

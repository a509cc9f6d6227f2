import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillgrove.llm import packing

ODD = ["", None, "a", "it's  we'll\n\nx\t y", "\x1c!\x1c ! \x85b c　　d", "<|endoftext|> 12½ Ⅷ²", "a <|endoftext|><|endoftext|> b<|endoftext|", "<|endoftext|>", "é" * 50, "word " * 5000, " \n ", "😀 a‍b", "x" * 3000]


def reference(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab's 1½!\n\t\x0b\x1c\x85 　é漢.-ſ<|", "<|endoftext|>"]), max_size=30).map("".join))
def test_units_are_the_tokenizers_ids(text):
    ids = np.frombuffer(packing.units("byte_bpe_50k.json").ids(text), "<u4").tolist()
    assert ids + [0] == reference([text])[0]


def test_pack(spark):
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate([*ODD, *ODD])], "doc_id long, text string, length string")
    rows = packing.pack(docs).collect()
    ids = reference([*ODD, *ODD])
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == list(range(len(ids)))
    for doc, own in by_doc.items():
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert k == 0 or r.length == 2048
            assert zlib.crc32(np.array(ids[doc][at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids[doc])
    for own in by_bin.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_plan_uses_every_piece_once(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=51)
    used = np.zeros(51, int)
    for filled, times in packing.best_two_fit(counts, 50):
        assert sum(filled) <= 50
        for x in filled:
            used[x] += times
    assert used.tolist() == counts.tolist()
    assert not lengths or sum(t for _, t in packing.best_two_fit(counts, 50)) <= -(-sum(lengths) * 11 // (50 * 9)) + 2


def plain_bins(lengths, capacity):
    """The same rule piece by piece: fill with the longest that fits, then two for the smallest if they fill more."""
    left, bins = sorted(lengths), []

    def longest(room, but=None):
        own = [x for k, x in enumerate(left) if x <= room and k != but]
        return max(own, default=0)

    while left:
        own, gap = [], capacity
        while x := longest(gap):
            left.remove(x)
            own.append(x)
            gap -= x
        if gap and len(own) > 1:
            small = own.pop()
            left = sorted([*left, small])
            best = [small]
            for k, x in enumerate(left):
                y = longest(gap + small - x, k) if x <= gap + small else 0
                if y and x + y > sum(best):
                    best = [x, y]
            for x in best:
                left.remove(x)
            own += best
        bins.append(sorted(own, reverse=True))
    return bins


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_bins_are_those_of_single_pieces(lengths):
    found = packing.best_two_fit(np.bincount(np.array(lengths, int), minlength=31), 30)
    assert all(sum(b) <= 30 for b in plain_bins(lengths, 30))
    assert abs(sum(n for _, n in found) - len(plain_bins(lengths, 30))) <= 1

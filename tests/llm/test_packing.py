import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import _bytes as B, packing
from tests.llm import corpus

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_word_encoder_equals_the_tokenizer():
    odd = ["Don't stop, A.B. l'été…. <|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y 12.5,7 ﬁ Ǆ á. É.!?", "a.'s b!?x 'S don'T", None, "", " x　y z", "日本語 text. Ünï", "é. ́ á", "a\x00b\x1cc"]
    texts = odd + corpus.texts(3, 80)
    column, t, encoder = pa.array(texts, pa.string()), tokenizer(), packing.WordEncoder(PATH)
    for _ in range(2):  # new words, then remembered ones
        got = []
        for _lo, _hi, data, offsets in B.text_slices(column, 3000):
            ids, begin = encoder.encode(data, offsets)
            got += [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)]
        assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_pack_documents_keeps_every_id(spark):
    rows = corpus.rows(1, 60) + [(900, "long words here " * 300), (901, "exactly " * 99)]
    t, capacity = tokenizer(), 100
    found = packing.pack_documents(corpus.frame(spark, rows), PATH, capacity=capacity, group_pieces=40, generations=5).collect()
    wanted = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), capacity)):
            piece = ids[a : a + capacity]
            wanted.append((i, k, a, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((key((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in found)) == sorted(map(key, wanted))
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in found)
    assert len(bins) <= 1.06 * -(-total // capacity) + 1


def test_empty_table(spark):
    assert packing.pack_documents(corpus.frame(spark, []), PATH).count() == 0


def test_islander_improves_or_keeps():
    lengths = np.random.default_rng(4).integers(300, 700, 300)
    x = packing.Islander(lengths, 1000, 5)
    x.begin()
    before = min(f[0] for f in x.found)
    x.evolve(80)
    cost, bins, fill = x.found[0]
    assert cost <= before and fill.max() <= 1000 and np.array_equal(np.bincount(bins, weights=lengths), fill)

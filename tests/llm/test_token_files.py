import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import _bytes as B, token_files as T
from tests.llm import corpus

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "Don't stop, A.B. l'été…. <|endoftext|> <|ENDOFTEXT|> x 12.5,7 ﬁ Ǆ á. É.!?", "a.'s b!?x 'S don'T we'll 'll i'd've  they're \n\n x\n y \t", None, "", "  x　y z", "日本語 text. Ünï'm", "é. ́ á '", "a\x00b\x1cc\x1d d\x85e  f",
    "'", "x'", "'s", "'l", "r'", "e's", "  ", " ", "\n", "a  b", "a \xa0b", "a\xa0\xa0b", "½ ²3 Ⅷ٣", "😀 a😀've", "'re're 's't", "'v", "el",
]


def test_encoder_equals_the_tokenizer():
    r = random.Random(1)
    texts = ODD + ["".join(r.choice("ab1!'  \n\tsテé 'lrevmdt　") for _ in range(r.randint(0, 30))) for _ in range(3000)]
    encoder = T.ByteEncoder(PATH)
    for limit in (50, 1 << 20):  # new pretokens, then remembered ones; with and without a special token in the slice
        for some in (texts, [x for x in texts if "<|endoftext|>" not in (x or "")]):
            got = []
            for _lo, _hi, data, offsets in B.text_slices(pa.array(some, pa.string()), limit):
                ids, begin = encoder.encode(data, offsets)
                got += [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)]
            assert got == [encoder.tokenizer.encode(x or "", add_special_tokens=False).ids for x in some]


@pytest.mark.parametrize("ids", [[], [7], [7, 7], [7] * 101, [1, 2] * 50 + [1], list(range(50)), [2**31 + 5, 3] * 20, [1, 1, 2] * 40])
def test_grammar_of_small_sequences(ids):
    ids = np.array(ids, np.uint32)
    g = T.Grammar.from_body(T.Grammar.of(ids).body())
    assert np.array_equal(g.ids(), ids)
    for a in range(len(ids)):
        assert np.array_equal(g.ids(a, min(len(ids), a + 7)), ids[a : a + 7])


def test_grammar_replaces_frequent_pairs():
    r = np.random.default_rng(3)
    words = [r.integers(0, 40_000, r.integers(2, 7)) for _ in range(50)]
    ids = np.concatenate([words[i] for i in r.integers(0, 50, 20_000)]).astype(np.uint32)
    for symbols in (1 << 16, 300):  # 16 and 32 bits
        g = T.Grammar.of(ids, symbols)
        assert g.sequence.dtype == (np.uint16 if symbols == 1 << 16 else np.uint32)
        assert np.array_equal(g.ids(), ids) and len(g.sequence) < len(ids) / 3
        t = len(g.terminals)
        size = [1] * t + g.sizes.tolist()
        for k, (a, b) in enumerate(zip(g.left.tolist(), g.right.tolist(), strict=True)):  # rules refer to what came before
            assert a < t + k and b < t + k and size[t + k] == size[a] + size[b]
        for a, b in ((0, 1), (70_000, 70_100), (12_345, 60_000), (len(ids) - 2, len(ids))):
            assert np.array_equal(g.ids(a, b), ids[a:b])


@pytest.mark.parametrize("shard_tokens", [50, 1 << 19])
def test_files_round_trip(spark, tmp_path, shard_tokens):
    rows = corpus.rows(2, 40) + [(500 + i, t) for i, t in enumerate(ODD)] + [(900, "a very long text " * 60_000)] + [(7, "the same row")] * 40
    path, tokenizer = str(tmp_path / "t"), T.ByteEncoder(PATH).tokenizer
    T.write_tokens(corpus.frame(spark, rows), PATH, path, shard_tokens=shard_tokens)
    got = T.read_tokens(spark, path).collect()
    ids = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
    key = lambda d, x: (-1 if d is None else d, x)
    assert sorted(key(r.doc_id, r.ids) for r in got) == sorted(key(d, ids(t)) for d, t in rows)
    at, flat = 0, []
    for r in sorted(got, key=lambda r: r.start):  # gapless, ascending
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at, flat = at + r.n_tokens, flat + r.ids
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    for a, n in ((0, 10), (at // 2, 5_000), (at - 3, 3), (at, 5)):
        found = sorted(T.read_range(spark, path, a, n).collect())
        assert [i for r in found for i in r.ids] == flat[a : a + n] and (not found or found[0].start == a)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    T.write_tokens(corpus.frame(spark, []), PATH, path)
    assert T.read_tokens(spark, path).count() == 0 and T.read_range(spark, path, 0, 5).count() == 0

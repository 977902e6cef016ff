"""What a Python worker holds in repeated_passages and packed_sequences does not depend on a slice's size or grow with the table's words."""

import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers

from lodestone.llm import _bytes as B, packing, substring_dedup


def test_hash_words_in_parts(monkeypatch):
    data = np.frombuffer((" ".join(f"w{i * 7919 % 100_003}" for i in range(60_000)) + " " + "x" * 5_000).encode(), np.uint8)
    starts, ends, _ = B.words(data, np.array([0, len(data)]))
    tracemalloc.start()
    want = B.hash_words(data, starts, ends)
    B._powers.clear()
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    B.hash_words(data, starts, ends)
    most = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert most < 8 << 20  # 34 MB when a slice was hashed at once
    for size in (1, 64, 1 << 12):
        monkeypatch.setattr(B, "HASH_BYTES", size)
        monkeypatch.setattr(B, "_powers", {})
        assert (B.hash_words(data, starts, ends) == want).all()
    one = B.hash_words(data, starts[-1:], ends[-1:])  # longer than a part
    assert one[0] == want[-1] and len(set(want.tolist())) == len(np.unique(want))


def test_chunk_places_are_small():
    text = " ".join(f"w{i * 7919 % 100_003}" for i in range(100_000))
    blob = substring_dedup._close([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])])
    chunk = substring_dedup.Chunk(blob, 13)
    chunk.nodes()
    assert {a.dtype for a in (chunk.starts, chunk.ends, chunk.at, chunk.order, chunk.of)} == {np.dtype(np.int32)}


def test_remembered_words_are_compact():
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(f"{chr(97 + i % 26)}{i}q" for i in range(k, k + 20_000)) for k in range(0, 100_000, 20_000)]
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        ids, begin = encoder.encode(data, np.array([0, len(data)]))
        assert ids.dtype == np.uint32 and begin.tolist() == [0, len(ids)]
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    held = sum(a.nbytes for a in (encoder.table, encoder.at, encoder.size, encoder.pool))
    assert encoder.count == 100_000 and held < 80 * encoder.count  # 107 before

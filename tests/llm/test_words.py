"""Words by arrays: the same words as a split of lower-case bytes, one id for each word."""

import numpy as np

from lexgrove.llm import blocks as B


def test_ids_of_words_without_objects(monkeypatch):
    rng = np.random.default_rng(3)
    pool = [b"a", b"A", b"Ab", b"aB", b"ba", b"\xc3\x89", b"\xc3\xa9", b"\xff\x00", b"\x1c", b"x" * 1024, b"X" * 1024, b"y" * 1025, b"Y" * 1025, b"z" * 5000, b"Z" * 4999 + b"\x00"]
    texts = [b"", b" ", b"\x0b\x0c"] + [rng.choice([b" ", b"\t", b"\r\n", b"  "]).join(pool[i] for i in rng.integers(0, len(pool), n)) for n in (1, 4, 5, 300)] + [b" a "]
    for size in (B.HASH_BYTES, 100):
        monkeypatch.setattr(B, "HASH_BYTES", size)
        ids, sizes = B.lower_words(texts)
        words = [w for t in texts for w in t.lower().split()]
        assert sizes.tolist() == [len(t.split()) for t in texts]
        found = dict(zip(words, ids.tolist(), strict=True))
        assert [found[w] for w in words] == ids.tolist() and len(set(found.values())) == len(found)
    assert not len(B.lower_words([])[0]) and not len(B.lower_words([b""])[0])


def test_keys_of_a_range_are_added():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    keys = [np.unique(rng.integers(0, 500, n).astype(np.uint64)) for n in (200, 1, 300)]
    table = pa.table({"keys": [B.pack_sorted(k) for k in keys], "counts": [B.pack(k + np.uint64(1)) for k in keys]})
    distinct, total, at, ends = B.added(table)
    together = np.concatenate(keys)
    wanted, place = np.unique(together, return_inverse=True)
    assert distinct.tolist() == wanted.tolist() and at.tolist() == place.tolist() and ends.tolist() == np.cumsum([len(k) for k in keys]).tolist()
    assert total.tolist() == [int((k + 1) * (together == k).sum()) for k in wanted.astype(int)]

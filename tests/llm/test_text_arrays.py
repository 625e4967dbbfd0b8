import re

import numpy as np
import pyarrow as pa

from tessera.llm.arrays import Words, slices

TEXTS = ["One two, one-two 3rd", None, "", "ÄPFEL Straße été 東京 x́y", "a" * 5000 + " b", "\n\n x"]


def test_words():
    w = Words(TEXTS)
    seen = {}
    for k, text in enumerate(TEXTS):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        mine = w.hash[w.doc == k]
        assert len(mine) == len(words)
        for word, h in zip(words, mine):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_grams_stay_within_a_text():
    w = Words(["a b c d", "c d", "a b c"])
    hashes, first = w.grams(3)
    assert w.doc[first].tolist() == [0, 0, 2] and hashes[0] == hashes[2] and len(np.unique(hashes)) == 2
    assert len(Words([]).grams(3)[0]) == 0


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 900, None, "y" * 900, "z"])], names=["text"])
    parts = list(slices(iter([batch, batch.slice(0, 0)]), "text", 1000))
    assert sum(p.num_rows for p in parts) == 4 and len(parts) > 1

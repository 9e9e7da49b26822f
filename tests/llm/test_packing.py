import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from marquee.llm import packing
from marquee.llm.queries import tokenizer

PATH = tokenizer("word_bpe_49k.json")
TEXTS = ["the and of it", None, "", "same text here", "same text here", "a b c\td́e\n\n Ünïcode don't <|endoftext|>", "a<|endoftext|>b <|startoftext|>", "<|endoftext|>", "x <|EndOfText|>", "a <|endoftext|> b", "long words and " * 9000, "the and of it is", "    x"]


def frame(spark, texts):
    rows = [(i, t, "clash", 5, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, row int, part int").repartition(3)


@pytest.mark.parametrize("texts", [TEXTS, TEXTS * 40, ["", None], []])
def test_every_id_lies_in_one_piece(spark, texts):
    tok = Tokenizer.from_file(PATH)
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    seqs = packing.pack(frame(spark, texts), PATH)
    got = packing.pieces(seqs).toPandas()
    for doc, rows in got.sort_values("start").groupby("doc_id"):
        at = 0
        for r in rows.itertuples():
            assert r.start == at and r.doc_tokens == len(want[doc])
            assert r.ids_crc32 == zlib.crc32(np.array(want[doc][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want[doc])
    assert got.doc_id.nunique() == len(texts)
    full = []
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]]
        full.append(rows.length.sum())
    assert all(n == packing.SIZE for n in full[:-1])


def test_hilbert_curve_visits_every_cell_by_unit_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = packing.hilbert_key(cells, bits)
        path = cells[np.argsort(keys)]
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()

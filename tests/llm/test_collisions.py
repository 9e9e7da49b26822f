"""Texts whose 64-bit hashes meet are told apart all the same."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from marquee.llm import common, hmm, packing, repair, sigtree
from marquee.llm.queries import tokenizer

#: Two words that met under an earlier hash without a key.
PAIR = ["mntyadvycukjnxyu", "adabpivcapsqukre"]


def built_pair():
    """Two runs of 16 bytes of one hash under the key (0, 0): the second block undoes what the first one changes."""
    first = [b"abcdefgh", b"hgfedcba"]
    h = [int(common.run_hashes(np.frombuffer(x + b"\0" * 8, np.uint8), np.array([0]), np.array([8]))[0]) + 8 * int(common.ODD[63]) for x in first]  # of 16 bytes
    second = [0x6161616161616161, (0x6161616161616161 + (h[0] - h[1]) * int(common.ODD[0])) % (1 << 64)]
    return [a + b.to_bytes(8, "little") for a, b in zip(first, second, strict=True)]


def test_a_key_parts_a_built_pair():
    u = np.frombuffer(b"".join(built_pair()), np.uint8)
    at, size = np.array([0, 16]), np.array([16, 16])
    a, b = common.run_hashes(u, at, size).tolist()
    assert a == b
    for key in ((1, 0), (12345, 1 << 63)):
        a, b = common.run_hashes(u, at, size, key).tolist()
        assert a != b


def test_bytes_decide(monkeypatch):
    runs = [b"", b"a", b"b" * 8, b"b" * 9, b"c" * 511, b"c" * 510 + b"d", b"c" * 700, b"c" * 699 + b"e"]
    u, size = np.frombuffer(b"".join(runs), np.uint8), np.array([len(r) for r in runs])
    at, eight = np.cumsum(size) - size, common.padded_words(u)
    for i, x in enumerate(runs):
        for j, y in enumerate(runs):
            if len(x) == len(y):
                assert common.same_runs(eight, at[[i]], eight, at[[j]], size[[i]]).tolist() == [x == y]
    monkeypatch.setattr(common, "run_hashes", lambda u, starts, size, *_: size.astype(np.uint64) % np.uint64(3))  # nearly all hashes meet
    texts = ["one two three one", "six ten six one two", "a bb ccc dddd", " ".join(PAIR), None, "mood food wood good"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        tok, encoder = Tokenizer.from_file(tokenizer(name)), common.TextEncoder(tokenizer(name), 12)
        for _ in range(2):
            got = [x.tolist() for _, ids, n in encoder(pa.array(texts)) for x in np.split(ids, np.cumsum(n)[:-1])]
            assert got == [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("words", [PAIR, [b.decode("latin-1").replace("\xa0", "x") for b in built_pair()]])
def test_operators_on_a_pair(spark, words):
    docs = spark.createDataFrame([(i, " ".join([w] * n)) for i, (w, n) in enumerate([(words[0], 1), (words[1], 1), (words[0], 6), (words[1], 6)])], "doc_id long, text string")
    for name, read in (("word_bpe_49k.json", lambda p: packing.pieces(packing.pack(docs, p))), ("byte_bpe_50k.json", lambda p: repair.read(repair.write(docs, p)))):
        tok = Tokenizer.from_file(tokenizer(name))
        want = {r.doc_id: zlib.crc32(np.array([*tok.encode(r.text, add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in docs.collect()}
        assert {r.doc_id: r.ids_crc32 for r in read(tokenizer(name)).collect()} == want
    members, _ = sigtree.join(docs)
    assert {r.doc_id: r.component_id for r in members.collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    told = {r.doc_id: r for r in hmm.score(docs, hmm.fold() == 1).collect()}
    train = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
    seen = {w for r in train for w in r.text.split()}
    assert all(told[r.doc_id].n_known == 1 + sum(w in seen for w in r.text.split()) for r in docs.collect())

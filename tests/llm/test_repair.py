import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marquee.llm import repair
from marquee.llm.common import TextEncoder, run_hashes
from marquee.llm.queries import tokenizer

PATH = tokenizer("byte_bpe_50k.json")
TEXTS = ["the and  of it", None, "", " ", "  two  spaces \n and\n\n lines \t tab  ", "same text", "same text", "Ünï code  x \x1c y don't <|endoftext|>", "a<|endoftext|>b  <|startoftext|>", "<|endoftext|>", "a <|endoftext|> b", "ab " * 30000, "a  　 b"]


def ids_of(texts):
    tok = Tokenizer.from_file(PATH)
    return [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


@pytest.mark.parametrize("texts", [TEXTS, TEXTS * 30, [None], []])
def test_files_give_back_every_id(spark, texts):
    rows = [(i * 3, t, "clash", 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string, start int").repartition(3)
    manifest = repair.write(docs, PATH, shard_ids=20_000)
    got = repair.read(manifest).orderBy("doc_id").collect()
    start, want = 0, []
    for i, ids in enumerate(ids_of(texts)):
        want.append((i * 3, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want


BITS = ["a", "I'd", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x0b", "\x1c", "\u00e9", "\u03a3", "\u00d7", "\u00f7", "'s", "'", "don't", "<|endoftext|>", "<|startoftext|>", "<|", "12", "\u00bd", "\u2014", "\u65e5\u672c", "\u0301", "\u0130", "\u00df", "Zz", ".", ",", "-", "(", "\U0001f642", "\r\n", "\u2028", "\u0085", "\u07ff", "\u0700", "w" * 600]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("limit", [10, 10**6])
def test_units_give_the_tokenizers_ids(name, limit):
    tok, rng = Tokenizer.from_file(tokenizer(name)), random.Random(4)
    texts = [*TEXTS, *("".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))) for _ in range(3000))]
    want = [[*e.ids, 2] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    encoder = TextEncoder(tokenizer(name), limit)
    for column in (pa.array(texts), pa.array([None, "before", *texts], pa.large_string()).slice(2)):
        got, at = [], 0
        for rows, ids, n in encoder(column, 2, most=700):
            assert rows.start == at
            at = rows.stop
            got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == want


def test_hashes_of_runs_differ():
    runs = [b"a", b"aa", b"a" * 8, b"a" * 9, b"a" * 16, b"a" * 17, b"b" * 600, b"b" * 601, b"b" * 599 + b"c", b"c" + b"b" * 599, b"\0", b"\0\0"]
    u, size = np.frombuffer(b"".join(runs), np.uint8), np.array([len(r) for r in runs])
    h = run_hashes(u, np.cumsum(size) - size, size)
    assert len(set(h.tolist())) == len(runs)
    assert (run_hashes(np.tile(u, 2), np.concatenate([np.cumsum(size) - size, len(u) + np.cumsum(size) - size]), np.tile(size, 2)) == np.tile(h, 2)).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=60), min_size=1, max_size=12))
def test_compression_is_undone(docs):
    ids = np.concatenate([np.array(d, np.uint32) for d in docs])
    last = np.zeros(len(ids), bool)
    last[np.cumsum([len(d) for d in docs]) - 1] = True
    sym, ends, rules = repair.compress(ids, last, base=4, rounds=5, least=2)
    data = b"".join(repair.file_bytes(list(range(len(docs))), sym, ends, rules, 4, len(ids)))
    shard = repair.Shard(data)
    assert shard.all_ids()[0].tolist() == ids.tolist()
    for i, d in enumerate(docs):
        assert shard.document(i).tolist() == d
        assert [shard.token(i, k) for k in range(len(d))] == d
    with pytest.raises(IndexError):
        shard.token(0, len(docs[0]))


def test_repeated_content_shrinks():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    sym, _, rules = repair.compress(ids, np.arange(len(ids)) == len(ids) - 1, base=50, rounds=8, least=2)
    assert len(sym) < len(ids) / 10 and re.match("RPG1", repair.MAGIC.decode())


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(1)
    passage = np.arange(1000, 1200)
    docs = [np.concatenate([np.minimum(rng.zipf(1.3, 300), 999), passage, np.minimum(rng.zipf(1.3, 300), 999)]) for _ in range(20)]
    ids, last = np.concatenate(docs).astype(np.uint32), np.zeros(20 * 800, bool)
    last[799::800] = True
    sym, ends, rules = repair.compress(ids, last, base=2000)
    code = sym[:-1].astype(np.int64) << 20 | sym[1:]
    assert np.unique(code[~ends[:-1]], return_counts=True)[1].max() < repair.LEAST and len(rules) < 0x10000 - 2000
    assert max(repair.expansions(rules, 2000)[2]) >= len(passage) and (repair.expand(sym, rules, 2000)[0] == ids).all()


def test_pairs_of_one_slot_are_all_counted(monkeypatch):
    monkeypatch.setattr(repair, "SLOTS", 1)
    ids = np.tile(np.arange(40, dtype=np.uint32), 50)
    at, rank, pairs = repair.frequent_pairs(ids, np.ones(len(ids), bool), 100, 7)
    assert len(pairs) == 40 and at.tolist() == list(range(len(ids) - 1))
    assert (pairs[rank] == (ids[:-1].astype(np.uint64) << np.uint64(20) | ids[1:])).all()

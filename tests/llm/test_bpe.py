"""Byte-level BPE against the library whose results it gives."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from assay.llm import bpe
from assay.llm.bpe import ByteBpe, decode_column, encode_column, encode_documents, read_ranks
from assay.llm.packing import RoomTree, best_fit, pack, write_packed
from assay.llm.queries import QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return ByteBpe(PATH, PATTERN)


def strange_texts(n=1500):
    rng = random.Random(5)
    letters = list("abcdethANDé ñ  \n\t\r\x0b\x0c'sltrevm.,!?0123456789") + [
        " ", "　", "\x1c", "\x1f", "\x85", "​", " ", "\xa0", "中", "🙂", "́", "Ⅷ", "²", "﻿"]
    fixed = ["", " ", "  ", " a", "a ", "don't 'S it's", "hello   world\n\n  foo", " \n x", "<|endoftext|>"]
    return fixed + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_encodes_as_the_library(own, library):
    texts = strange_texts()
    ids = own.encode(texts)
    assert [x.tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
    assert own.decode(ids) == [t.encode() for t in texts]


def test_long_words_merge_many_pairs_in_a_round(library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 1)
    rng, own = random.Random(1), ByteBpe(PATH, PATTERN)
    words = ["a" * 99, "ab" * 80, "é" * 70] + ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 60))) for _ in range(40)]
    assert [x.tolist() for x in own.encode(words)] == [library.encode_ordinary(w) for w in words]


def test_memory_of_words_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 10)
    monkeypatch.setattr(bpe, "MERGED", 32)
    own, texts = ByteBpe(PATH, PATTERN), strange_texts(100)
    for text in texts:
        assert own.encode([text])[0].tolist() == library.encode_ordinary(text)
        assert len(own.chunks.number) <= 10 + len(text) + 1


def test_query_over_the_table(spark, sf_dir, texts, library):
    found = {r.doc_id: r for r in QUERIES["op5_bpe"](spark, sf_dir).collect()}
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode_ordinary(text)
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows_and_columns(odd, odd_rows, empty, library):
    found = encode_documents(odd, PATH, PATTERN).collect()
    assert [(r.doc_id, bytes(r.decoded).decode()) for r in found] == [(i, t or "") for i, t in odd_rows]
    assert [r.ids for r in found] == [library.encode_ordinary(t or "") for _, t in odd_rows]
    assert encode_documents(empty, PATH, PATTERN).count() == 0
    ids = odd.select(encode_column(PATH, PATTERN).alias("ids"))
    back = ids.select(decode_column(PATH, PATTERN, ids.ids).alias("bytes")).collect()
    assert [bytes(r.bytes).decode() for r in back] == [t or "" for _, t in odd_rows]


def test_unknown_ids_and_rank_files(own, tmp_path):
    with pytest.raises(ValueError, match="vocabulary"):
        own.decode([np.array([10**6])])
    (tmp_path / "few.tiktoken").write_text("YQ== 0\n")
    with pytest.raises(ValueError, match="no token"):
        read_ranks(str(tmp_path / "few.tiktoken"))


def test_room_tree_finds_the_least_room():
    rng, tree, rooms = random.Random(2), RoomTree(50), []
    for _ in range(2000):
        if rooms and rng.random() < 0.4:
            tree.add(rooms.pop(rng.randrange(len(rooms))), -1)
        else:
            rooms.append(rng.randint(0, 50))
            tree.add(rooms[-1], 1)
        want = rng.randint(0, 50)
        assert tree.least(want) == min((r for r in rooms if r >= want), default=None)


@pytest.mark.parametrize("seed", range(3))
def test_best_fit_is_best_fit_decreasing(seed):
    sizes = np.random.default_rng(seed).integers(1, 101, 300)
    rows = []
    for piece in np.argsort(-sizes, kind="stable"):
        fits = [r for r in rows if r[0] >= sizes[piece]]
        if fits:
            row = min(fits, key=lambda r: r[0])
        else:
            rows.append(row := [100, []])
        row[0] -= sizes[piece]
        row[1].append(int(piece))
    found = best_fit(sizes, 100)
    # rows of equal room are as good as each other, so the fill of the rows is what must agree
    assert sorted(int(sizes[r].sum()) for r in found) == sorted(100 - int(r[0]) for r in rows)
    assert sorted(p for r in found for p in r) == list(range(300)) and all(sizes[r].sum() <= 100 for r in found)


def test_packing_loses_nothing(spark, tmp_path):
    rng = random.Random(3)
    docs = [(i, [rng.randrange(60000) for _ in range(rng.choice([0, 1, 5, 31, 32, 33, 64, 100, 333]))]) for i in range(200)]
    rows = [(*r, "x") for r in [*docs, (None, [1, 2]), (500, None)]]
    frame = spark.createDataFrame(rows, "doc_id long, ids array<int>, row string").repartition(3)
    write_packed(pack(frame, row=32, block=1000, pad=7), str(tmp_path / "packed"))
    rows = spark.read.parquet(str(tmp_path / "packed")).collect()
    back = {}
    for r in rows:
        line = np.frombuffer(r.ids, "<u2")
        assert len(line) == 32 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert (line[r.n_tokens:] == 7).all() and r.position_resets == r.cu_seqlens[:-1]
        for doc, at, s, e in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            back.setdefault(doc, []).append((at, line[s:e].tolist()))
    joined = {d: [x for _, part in sorted(parts) for x in part] for d, parts in back.items()}
    assert joined == {d: ids for d, ids in docs if ids} | {None: [1, 2]}
    assert len({(r.shard, r.row) for r in rows}) == len(rows)


def test_packing_edges(spark, empty):
    none = spark.createDataFrame([], "doc_id long, ids array<int>")
    assert pack(none).count() == 0
    with pytest.raises(ValueError):
        pack(none, id_bytes=3)
    big = spark.createDataFrame([(1, [70000])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="does not fit"):
        pack(big).collect()
    assert pack(big, id_bytes=4, row=4).first().ids == np.array([70000, 0, 0, 0], "<u4").tobytes()


def test_packing_query_covers_all_tokens(spark, sf_dir):
    packed = {}
    for r in QUERIES["op10_packing"](spark, sf_dir).collect():
        for doc, s, e in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:]):
            packed[doc] = packed.get(doc, 0) + e - s
    counts = {r.doc_id: r.n_tokens for r in QUERIES["op5_bpe"](spark, sf_dir).collect()}
    assert packed == {d: n for d, n in counts.items() if n}

"""Token counts, the token store and packing against the library itself."""

from __future__ import annotations

import json
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyloom.llm import packing, token_counts, token_store
from tallyloom.llm.codecs import codec

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "\na", "a\n", "a\n\nb c", "x \ny z", "q\r\nq w\te,", "don't I'LL we've", "x\x1cy z\x1f", "a\u00a0b\u3000c\u0085 d",
    "<|endoftext|> hi <|startoftext|>", "e\u0301 \u0301x", "\u03a3\u0391\u03a3 \u0130x", "\u03a9 \u2460 \u00bd x\u00b2", "1 22 333", "\u4f60\u597d \u4e16\u754c", "\U0001f600 ok", "a" * 5000, "word " * 3000, "Rs. 1,000.50/-", "\0 nul",
]


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)]
    rows += [(7, ODD[7], "again"), (-3, "below zero", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


@pytest.mark.parametrize(("path", "spaced"), [(WORD, False), (BYTE, True)])
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab'1.,\u00e9\u03a3\u0130"), st.characters(codec="utf-8")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_codec_gives_the_librarys_ids(path, spaced, text):
    library = Tokenizer.from_file(path)
    assert np.frombuffer(codec(path, spaced).encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_counts(spark, docs):
    library = Tokenizer.from_file(WORD)
    got = sorted(map(tuple, token_counts.token_counts(docs, WORD, limit=2048).collect()))
    want = sorted((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in docs.collect())
    assert [g[:3] for g in got] == want
    assert [g[3] for g in got] == [g[2] > 2048 for g in got]
    assert token_counts.token_counts(docs.limit(0), WORD, limit=1).count() == 0


def test_whole_tokens_are_proven():
    library, whole = Tokenizer.from_file(WORD), sorted(token_counts.whole_tokens(WORD))
    assert len(whole) > 10_000
    for word in random.Random(1).sample(whole, 300):
        assert len(library.encode(word, add_special_tokens=False).ids) == 1


def test_store_round_trip(spark, docs, tmp_path):
    library, out = Tokenizer.from_file(WORD), f"file://{tmp_path}/store"
    token_store.write_token_store(docs, out, WORD, end_id=2, parts=3, shard_tokens=500)
    got = sorted(map(tuple, token_store.read_token_store(spark, out).collect()), key=lambda r: (r[1]))
    assert [r[0] for r in got] == sorted(r[0] for r in docs.collect())
    start = 0
    texts = {}
    for d, t, _ in docs.collect():
        texts.setdefault(d, []).append(t)
    for doc, at, n, check in got:
        assert at == start
        wanted = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts[doc]]
        assert (n, check) in [(len(w), crc(w)) for w in wanted]
        start += n
    assert spark.read.parquet(out).count() > 3
    empty = f"file://{tmp_path}/empty"
    token_store.write_token_store(docs.limit(0), empty, WORD, end_id=2, parts=2)
    assert token_store.read_token_store(spark, empty).count() == 0


def test_store_of_any_ids_and_its_places(spark, tmp_path):
    library, out = Tokenizer.from_file(WORD), f"file://{tmp_path}/named"
    rows = [(f"d{i:02d}", f"the cat {i} sat on the mat " * (i % 4)) for i in range(30)] + [(None, "null id"), ("d03", "again the")]
    token_store.write_token_store(spark.createDataFrame(rows, "name string, body string"), out, WORD, end_id=2, parts=3, shard_tokens=60, id_col="name", text_col="body")
    got = token_store.read_token_store(spark, out, id_col="name").orderBy("start").collect()
    assert [r["name"] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    by_text = {crc(library.encode(t, add_special_tokens=False).ids + [2]): library.encode(t, add_special_tokens=False).ids + [2] for _, t in rows}
    stream = [x for r in got for x in by_text[r["ids_crc32"]]]
    the, cat = (library.encode(w, add_special_tokens=False).ids[0] for w in ("the", "cat"))
    found = token_store.token_occurrences(spark, out, [the, cat, 49_000, -1]).collect()
    for token in (the, cat):
        mine = sorted((r for r in found if r["token"] == token), key=lambda r: r["shard_no"])
        assert [p for r in mine for p in r["places"]] == [i for i, x in enumerate(stream) if x == token]
        assert all(r["n"] == len(r["places"]) for r in mine)
    assert {r["token"] for r in found} <= {the, cat, 49_000}
    assert token_store.token_occurrences(spark, out, [the], places=False).where("places IS NOT NULL").count() == 0
    asked = [0, 5, len(stream) - 1, len(stream), -1, None, 5]
    at = token_store.tokens_at(spark.createDataFrame([(p, "x") for p in asked], "place long, token string"), out).collect()
    assert sorted(((r["place"], r["token_"]) for r in at), key=str) == sorted(((p, stream[p] if p is not None and 0 <= p < len(stream) else None) for p in asked), key=str)
    clash = token_store.tokens_at(spark.createDataFrame([(0, 1, 2, 3, 4)], "`p.q` long, at int, found int, _AT int, shard_no int"), out, "p.q")
    assert clash.columns == ["p.q", "at", "found", "_AT", "shard_no", "token"] and tuple(clash.first()) == (0, 1, 2, 3, 4, stream[0])
    tiny = f"file://{tmp_path}/extreme"
    token_store.write_token_store(spark.createDataFrame([(-(2**63), "a"), (None, "b"), (2**63 - 1, "c")], "doc_id long, text string"), tiny, WORD, end_id=2, parts=2)
    assert [r["doc_id"] for r in token_store.read_token_store(spark, tiny).orderBy("start").collect()] == [None, -(2**63), 2**63 - 1]


def test_other_vocabulary_files_go_to_the_library_whole(tmp_path):
    settings_ = json.loads(Path(WORD).read_text())
    settings_["normalizer"] = None
    other = tmp_path / "other.json"
    other.write_text(json.dumps(settings_))
    assert codec(WORD, False).known and codec(BYTE, True).known and not codec(str(other), False).known and not codec(WORD, True).known
    for text in ("Hello World", "a  b\n\u00c9"):
        assert np.frombuffer(codec(str(other), False).encode(text), "<u4").tolist() == Tokenizer.from_file(str(other)).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("top", [1, 2, 700, 49_407, 70_000])
def test_shard_rank_select_access(top):
    rng = np.random.default_rng(top)
    ids = (rng.integers(0, top + 1, 3000) // rng.integers(1, 5, 3000)).astype(np.uint32)
    shard = token_store.Shard(token_store.encode_shard(ids, np.array([1000, 3000])))
    assert (shard.decode() == ids).all()
    assert [shard.access(i) for i in range(0, 3000, 97)] == ids[::97].tolist()
    for token in {int(ids[0]), int(ids[-1]), int(ids.max()), top}:
        places = np.flatnonzero(ids == token)
        assert shard.count(token) == len(places)
        assert shard.count(token, 1500) == int((places < 1500).sum())
        for k in range(0, len(places), max(1, len(places) // 7)):
            assert shard.locate(token, k) == places[k]
    with pytest.raises(IndexError):
        shard.access(3000)
    with pytest.raises(IndexError):
        shard.locate(int(ids[0]), 10**6)
    assert shard.count(1 << 20) == 0


def test_open_bins_find_the_tightest():
    rng, tree, held = random.Random(3), packing.OpenBins(100), []
    for number in range(3000):
        if rng.random() < 0.5:
            room = rng.randint(0, 100)
            tree.add(room, number)
            held.append(room)
        else:
            need = rng.randint(0, 100)
            fit = [r for r in held if r >= need]
            found = tree.take(need)
            assert (found and found[0]) == (min(fit) if fit else None)
            if fit:
                held.remove(found[0])


@given(st.lists(st.integers(1, 64), max_size=80))
@settings(max_examples=150, deadline=None)
def test_best_fit_decreasing_is_that_of_the_definition(lengths):
    bins, offsets = packing.best_fit_decreasing(np.array(lengths, np.int64), 64)
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(64 - n)
    assert len(set(bins.tolist())) == len(rooms)
    for b in set(bins.tolist()):
        parts = sorted((o, n) for o, n, c in zip(offsets.tolist(), lengths, bins.tolist()) if c == b)
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 64


def test_packing(spark, docs):
    library = Tokenizer.from_file(BYTE)
    rows = packing.best_fit_pack(docs, BYTE, end_id=0, size=128).collect()
    by_doc: dict[int, list] = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    total = 0
    for doc, text, _ in docs.collect():
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        if doc == 7:
            continue
        parts = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(len(parts)))
        assert sum(p["length"] for p in parts) == len(ids)
        for k, p in enumerate(parts):
            assert p["ids_crc32"] == crc(ids[p["start"] : p["start"] + p["length"]])
            assert p["length"] == 128 or k == 0
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 128
    assert len(bins) <= -(-total // 128) + 2
    assert packing.best_fit_pack(docs.limit(0), BYTE, end_id=0, size=128).count() == 0

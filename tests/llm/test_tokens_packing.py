import random
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideglass.llm import packing
from tideglass.llm.packing import best_fit, lower_bound, pack_documents
from tideglass.llm.queries import vocabulary
from tideglass.llm.tokens import PreTokens, token_counts

_TOKENIZER, _OWN = Tokenizer.from_file(vocabulary()), PreTokens(vocabulary())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    alphabet = ["the", " the", " é", "\n", "  ", "\t", "'s", "<|endoftext|>", "漢字", " ", "𝔘", "½", " 123", "!!", "\x00", "ة", " a"]
    out = [(i, "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 50, 400])))) for i in range(300)]
    return out + [(300, None), (301, "word " * 9000), (7, out[7][1]), (None, "no id")]


def test_counts_equal_the_library(spark, rows):
    t = Tokenizer.from_file(vocabulary())
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).repartition(3)
    got = sorted(map(tuple, token_counts(df, vocabulary(), 100).collect()), key=str)
    want = []
    for d, x in rows:
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        want.append((d, len((x or "").encode()), n, n > 100))
    assert got == sorted(want, key=str)
    assert token_counts(df.limit(0), vocabulary(), 100).collect() == []


def _joined(texts):
    data = [(x or "").encode() for x in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def test_cache_overflow_changes_nothing(monkeypatch, rows):
    monkeypatch.setattr("tideglass.llm.tokens.CACHE_SIZE", 3)
    t, own = Tokenizer.from_file(vocabulary()), PreTokens(vocabulary())
    texts = [x for _, x in rows[:80]]
    for low in range(0, 80, 7):
        ids, bounds = own.ids(*_joined(texts[low : low + 7]), 0)
        for i, x in enumerate(texts[low : low + 7]):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 0]


_CHARACTERS = "ab \n\t\r'sétÀ×÷1!.,\x1c\x85\xa0\u2003\u3000\u0301漢½ة\u200b\x00<|"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from(_CHARACTERS) | st.characters(exclude_categories=["Cs"])), min_size=1, max_size=6))
def test_cuts_are_those_of_the_library(texts):
    want = [_TOKENIZER.encode(x, add_special_tokens=False).ids for x in texts]
    ids, bounds = _OWN.ids(*_joined(texts), 0)
    assert [ids[a : b - 1].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want
    assert _OWN.count(*_joined(texts)).tolist() == list(map(len, want))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(name, rows):
    own = PreTokens(vocabulary(name))
    texts = [x for _, x in rows[:40]]
    if name.endswith(".model"):
        encode = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name)).encode
    else:
        other = Tokenizer.from_file(vocabulary(name))
        encode = lambda x: other.encode(x, add_special_tokens=False).ids
    assert own.count(*_joined(texts)).tolist() == [len(encode(x or "")) for x in texts]


def test_best_fit_and_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        size = int(rng.integers(5, 60))
        lengths = rng.integers(1, size + 1, int(rng.integers(1, 80)))
        bins, offsets, n = best_fit(lengths, size)
        assert np.bincount(bins, weights=lengths).max() <= size and len(set(bins)) == n
        for b in range(n):
            at = np.argsort(offsets[bins == b])
            assert (offsets[bins == b][at] == np.concatenate([[0], np.cumsum(lengths[bins == b][at])[:-1]])).all()
        assert -(-lengths.sum() // size) <= lower_bound(lengths, size) <= n
    assert lower_bound(np.array([51, 51, 51]), 100) == 3
    assert lower_bound(np.array([34, 34, 34, 34]), 100) == 2


def test_round_trip(spark, rows, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    t = Tokenizer.from_file(vocabulary())
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("offset", F.lit(1))
    got = pack_documents(df, vocabulary(), 256).toPandas()
    for doc, text in rows[:302]:
        if doc == 7:
            continue
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = got[got.doc_id == doc].sort_values("piece")
        assert own.length.sum() == len(ids) and own.piece.tolist() == list(range(len(own)))
        assert (len(own) == 1) == (len(ids) <= 256) and (own.length.iloc[1:] == 256).all()
        for r in own.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert len(got[got.doc_id == 7]) % 2 == 0
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 256
    assert got.sequence_id.nunique() <= lower_bound(got.length.to_numpy(), 256) * 1.03 + 1
    assert pack_documents(df.limit(0), vocabulary(), 256).collect() == []


def test_copies_of_a_row_spread_over_groups(spark, monkeypatch):
    """Of a third and more of equal rows, no group gets over twice its size, in the first round and in those of what was given up."""
    monkeypatch.setattr(packing, "GROUP", 500)
    sizes = []
    whole = packing._packed

    def watched(pieces, size, round_no, groups):
        sizes.extend(r["count"] for r in pieces.groupBy(packing.slot_of(round_no, groups)).count().collect())
        return whole(pieces, size, round_no, groups)

    monkeypatch.setattr(packing, "_packed", watched)
    rows = [(7, "the same words again and again " * 12)] * 6000 + [(None, "no id")] * 800 + [(100 + i, "word " * (i % 90)) for i in range(1000)]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), vocabulary(), 256)
    filled = got.groupBy("sequence_id").sum("length").collect()
    assert max(sizes) <= 1000 and got.count() == 7800 and max(r[1] for r in filled) <= 256

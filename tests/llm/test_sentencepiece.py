import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import sentencepiece_codec as sc

sentencepiece = pytest.importorskip("sentencepiece")
CODEC = sc.Codec(sc.MODEL)
MODEL = sentencepiece.SentencePieceProcessor(model_file=sc.MODEL)
ALPHABET = "aaabbcdeeth  \n\t▁é日本1👍.,-="


def by_chunks(text, size):
    x = sc.SPACE + text.replace(" ", sc.SPACE)
    cuts = [*range(0, len(x), size), len(x)]
    chunks = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        low = max(0, a - 2 * CODEC.reach)
        chunks.append(sc.Chunk(CODEC, x[low : b + 2 * CODEC.reach], a - low, b - low, k == 0, k == len(cuts) - 2))
    ends = sc.chosen([c.matrix() for c in chunks])
    return np.frombuffer(b"".join(c.trace(l, r) for c, (l, r) in zip(chunks, ends)), np.int32).tolist()


@given(st.text(alphabet=ALPHABET, max_size=60) | st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30))
@settings(max_examples=400, deadline=None)
def test_ids_are_the_model_s(text):
    if "\0" in text:
        return
    want = MODEL.encode(text)
    assert np.frombuffer(CODEC.encode(text), np.int32).tolist() == want
    assert CODEC.decode(np.array(want, np.int32)) == text.replace("▁", " ")


@pytest.mark.parametrize("size", [17, 40, 200])
def test_chunks_give_the_same_ids(size):
    rng = random.Random(size)
    words = ["the", "international", "straightforward", "haan", "ennt", "====", "日本", "\n", "   ", "characteristics", "é", "x" * 50, "aeaeae" * 20, "=" * 70]
    for _ in range(60):
        text = "".join(rng.choice(words) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 60)))
        assert by_chunks(text, size) == MODEL.encode(text)


def test_documents(spark, odd_docs):
    long = "the ennt of haan.\nrelyble " * 50 + "q" * 300
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(99, long), (99, long)], "doc_id long, text string"))
    rows = sc.decode_documents(sc.encode_documents(docs, chunk=64)).collect()
    want = sorted((str(r.doc_id), MODEL.encode(r.text or ""), r.text or "") for r in docs.collect())
    assert sorted((str(r.doc_id), r.ids, r.text) for r in rows) == want
    assert all(r.exact for r in rows) and {r.n_chunks for r in rows if r.doc_id == 99} == {26}


def test_empty(no_docs):
    assert sc.encode_documents(no_docs).count() == 0


def test_round_trip_in_blocks(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(sc, "BLOCK", 64)
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(99, " ▁ a  b\n " * 40), (100, "日本" * 90)], "doc_id long, text string"))
    rows = sc.round_trip(docs, chunk=100).collect()
    assert sorted((str(r.doc_id), r.ids) for r in rows) == sorted((str(r.doc_id), MODEL.encode(r.text or "")) for r in docs.collect())
    assert all(r.exact for r in rows) and max(r.n_chunks for r in rows) > 1

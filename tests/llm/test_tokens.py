"""Token helpers against the tokenizers library."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadloom.llm import bpe_words
from roadloom.llm import tokens as K

PIECES = ["<|endoftext|>", "  ", "'s", "'ll", " ", "\n", "\t", "\r", "a", "s", "D", "À", "é", "1", "²", "½", ".", ",", "!", "-", "中", "　", "\x85", "\xa0", "\x1c", "​", "😀", "<", "|", ">"]
TEXTS = st.one_of(st.lists(st.sampled_from(PIECES), max_size=24).map("".join), st.text(max_size=20))


@settings(max_examples=1500, deadline=None)
@given(TEXTS)
def test_same_ids_and_text_as_the_library(text):
    library = K.tokenizer(K.VOCABULARY)
    want = library.encode(text, add_special_tokens=False).ids
    assert K.text_ids(text, K.VOCABULARY).tolist() == want
    words = [w for c in K.text_chunks(text, K.VOCABULARY) for w in K.chunk_words(c, K.VOCABULARY)] if text else []
    assert "".join(words) == text
    assert [i for w in words for i in K.word_ids(w, K.VOCABULARY)] == want
    pieces = K.pieces_of(K.VOCABULARY)
    assert b"".join(pieces[i] for i in want).decode() == library.decode(want, skip_special_tokens=False) == text


def test_null_and_empty():
    assert K.text_ids(None, K.VOCABULARY).tolist() == K.text_ids("", K.VOCABULARY).tolist() == []
    assert K.text_ids("a", K.VOCABULARY).dtype == np.dtype("<u4")


def test_equal_runs_of_documents_spread_over_blocks(spark):
    docs = spark.range(60).select(F.lit(7).alias("doc_id"), F.repeat(F.lit("some words "), 30_000).alias("text")).repartition(4)
    blocks = [r["count"] for r in bpe_words._bundles(docs, 10).groupBy("block").count().collect()]
    assert sum(blocks) == 60 and len(blocks) >= 8 and max(blocks) < 20


def test_ids_without_a_piece_and_nulls(spark):
    """Decoding by the join: unknown ids give nothing, null ids give null, bytes that aren't UTF-8 give U+FFFD."""
    known = K.text_ids("ab é", K.VOCABULARY)
    broken = np.array([i for i, p in enumerate(K.pieces_of(K.VOCABULARY)) if p == b"\xc3"][:1], dtype="<u4")
    rows = [(0, known.tobytes()), (1, b""), (2, None), (3, np.array([2**31, *known, 2**32 - 1], dtype="<u4").tobytes()), (4, broken.tobytes())]
    got = {r.n: r.decoded for r in bpe_words.decode(spark.createDataFrame(rows, "n int, ids binary")).collect()}
    assert got == {0: "ab é", 1: "", 2: None, 3: "ab é", 4: "\ufffd"}

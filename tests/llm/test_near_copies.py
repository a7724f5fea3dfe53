"""The pipeline's near-duplicate stage against a comparison of all pairs in plain Python."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from roadloom.llm import near_copies

STAGE = dict(corpus_pipeline.STAGES)["near_duplicates"]


def plain_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_bits(hashes):
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_near(a, b):
    """Whether the two SimHashes of the texts' words are near."""
    return all((x ^ y).bit_count() <= r for x, y, r in zip(a, b, (near_copies.RADIUS, near_copies.SECOND_RADIUS), strict=True))


def plain_prints(text):
    own = set(near_copies.word_hashes(text, near_copies._WordHashes()).tolist())
    return plain_bits(own), plain_bits([int(x) for x in near_copies._mixed(np.array(sorted(own), dtype="<u8"))])


def plain_kept(rows, every_pair):
    """Doc ids that stay, of ``(doc_id, text)``: the smallest of each component, nulls last."""
    sets = sorted({plain_set(t) for _, t in rows}, key=len)
    prints = {plain_set(t): plain_prints(t) for _, t in rows}
    parent = {s: s for s in sets}

    def top(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for i, a in enumerate(sets):
        for b in sets[i + 1 :]:
            if 5 * len(a) < 4 * len(b):
                break
            if 5 * len(a & b) >= 4 * len(a | b) and (every_pair or plain_near(prints[a], prints[b])):
                parent[top(a)] = top(b)
    best = {}
    for doc_id, text in rows:
        root = top(plain_set(text))
        best[root] = min(best.get(root, (True, 0)), (doc_id is None, doc_id or 0))
    return Counter(None if none else i for none, i in best.values())


def planted():
    """Texts with copies that differ in a few places, so similarities run from about 0.6 to 1."""
    r = random.Random(3)
    words = ["".join(r.choices("abcdefgh", k=4)) for _ in range(400)]
    line = " ".join(r.choices(words, k=30))
    texts = [None, "", "  ", "one", "ONE", "one two three four", "One two\tthree four", "one two three four five"]
    for n in range(120):
        base = r.choices(words, k=r.choice([12, 60, 200]))
        texts += [" ".join(base), line + " " + " ".join(base)]
        for _ in range(3):
            other = list(base)
            for _ in range(r.randrange(0, max(2, len(base) // 40))):
                other[r.randrange(len(other))] = "zz"
            texts.append(" ".join(other[: len(other) - r.randrange(0, len(base) // 8)]))
    group = r.choices(words, k=100)
    for _ in range(80):
        other = list(group)
        other[r.randrange(100)] = "yy"
        texts.append(" ".join(other))
    r.shuffle(texts)
    return [*enumerate(texts), (None, "no id here"), (None, "no id here"), (3, texts[3]), (None, texts[0])]


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return Counter(r.doc_id for r in STAGE(spark, docs, "").collect())


@pytest.mark.parametrize("block", [near_copies.TEXTS_A_BLOCK, 7])
def test_same_as_all_pairs(spark, monkeypatch, block):
    """The same links as a comparison of all pairs, with one block a group and with several."""
    monkeypatch.setattr(near_copies, "TEXTS_A_BLOCK", block)
    rows = planted()
    assert kept(spark, rows) == plain_kept(rows, every_pair=False)


def test_near_copies_found_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got, all_ = Counter(r.doc_id for r in STAGE(spark, docs, sf).collect()), plain_kept(rows, every_pair=True)
    assert got == plain_kept(rows, every_pair=False)
    gone = len(rows) - all_.total()
    assert gone > 0 and len(rows) - got.total() >= 0.95 * gone
    assert not all_ - got


def test_of_repeated_rows_the_smallest_stays(spark):
    rows = [(1, "some words that occur twice", s) for s in ("b", "a", None)] + [(2, "others", "c"), (2, "others", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(map(tuple, STAGE(spark, docs, "").collect())) == [(1, "some words that occur twice", None), (2, "others", "c")]


def test_shingles_and_bits_by_their_definition():
    known = near_copies._WordHashes()
    r = random.Random(1)
    for _ in range(50):
        a, b = ([r.choice("abc") for _ in range(r.randrange(0, 40))] for _ in range(2))
        sets = [plain_set(" ".join(x)) for x in (a, b)]
        own = [near_copies.shingles(near_copies.word_hashes(" ".join(x), known)) for x in (a, b)]
        assert [len(x) for x in own] == [len(x) for x in sets]
        assert len(np.intersect1d(*own)) == len(sets[0] & sets[1])
        if sets[0] and sets[1]:
            alike = 5 * len(sets[0] & sets[1]) >= 4 * len(sets[0] | sets[1])
            overlaps = near_copies.Overlaps(own)
            assert overlaps.similar(0).tolist() == [True, alike] and overlaps.similar(1).tolist() == [alike, True]
    h = np.array([r.getrandbits(64) for _ in range(99)], dtype="<u8")
    assert near_copies.majority_bits(h) % 2**64 == plain_bits(h.tolist())


def test_copies_of_a_very_long_text(spark):
    r = random.Random(5)
    long = [r.choice("abcdefgh") + str(r.randrange(5000)) for _ in range(300_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:150_000], "zz", *long[150_000:]])), (3, " ".join(long[:200_000]))]
    assert kept(spark, rows) == Counter([1, 3])


def test_first_of_many_copies_of_one_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same five words here").alias("text"))
    assert [r.doc_id for r in STAGE(spark, docs, "").collect()] == [0]

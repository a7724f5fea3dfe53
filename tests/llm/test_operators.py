"""Operators of the training-data subpackage against plain statements of their rules, on awkward rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from roadloom.llm import bpe_words, chat_snapshots, components, external_shuffle, language_bitmask, media_wav, packing, segment_topk, simhash_dedup, toxicity_pu
from roadloom.llm.common import held_out
from roadloom.llm.tokens import VOCABULARY, tokenizer

DOCS = "doc_id long, text string, lang string, bucket string, score string, fp string"
_r = random.Random(11)
WORDS = ["".join(_r.choices("abcdefgh", k=_r.randrange(2, 7))) for _ in range(80)]
LONG = " ".join(_r.choices(WORDS, k=30_000))


def _rows():
    base = [" ".join(_r.choices(WORDS, k=60)) for _ in range(12)]
    near = [b.replace(b.split()[30], "zz", 1) for b in base[:6]]
    texts = [None, "", "", "   ", "one", "One\ttwo", "a <|endoftext|>  b\n\n c's 12", "ÉÀ 中文 ½", *base, *near, base[0], base[0], LONG]
    rows = [(i, t, "xx", "b", "s", "f") for i, t in enumerate(texts)]
    return rows + [(None, "no id here", None, None, None, None), (3, "   ", "xx", "b", "s", "f")]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_by_word_table(docs, none, rows):
    library = tokenizer(VOCABULARY)
    got = bpe_words.decode(bpe_words.encode(docs, block_bytes=50_000)).collect()
    ids = lambda t: np.array(library.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in got) == Counter((r[0], ids(r[1]), r[1] or "") for r in rows)
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)
    assert bpe_words.decode(bpe_words.encode(none)).count() == 0


def test_packing_covers_every_id_once(docs, none, rows):
    library = tokenizer(VOCABULARY)
    got = packing.pack_documents(docs, examples=8).collect()
    want = Counter((r[0], np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()) for r in rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append((r.start, bytes(r.ids)))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc_id, pieces in by_doc.items():
        if sum(n for (d, _), n in want.items() if d == doc_id) == 1:
            assert (doc_id, b"".join(ids for _, ids in sorted(pieces))) in want
    assert sum(r.length for r in got) == sum(n * len(ids) // 4 for (_, ids), n in want.items())
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(none).count() == 0


def test_packing_keeps_all_limits():
    r = np.random.default_rng(2)
    n = r.integers(1, 1000, 300)
    sizes = np.stack([n, np.ones_like(n), (n * r.random(300)).astype(int)], axis=1)
    limits = np.array([1000, 4, 500])
    fit = sizes[:, 2] <= 500
    bins = packing.pack_vectors(sizes[fit], limits, cut=False)
    assert sorted(i for b in bins for i, _, _ in b) == list(range(fit.sum()))
    assert all((sizes[fit][[i for i, _, _ in b]].sum(axis=0) <= limits).all() for b in bins)
    with pytest.raises(ValueError):
        packing.pack_vectors(np.array([[2000, 1, 1]]), limits, cut=False)


def _fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_simhash_groups(spark, docs, none, rows):
    ball = [(100 + i, None, "xx", "b", "s", "f") for i in range(3)]
    fps = {r[1]: _fingerprint(r[1]) for r in rows + ball}
    ids = [(r[0], fps[r[1]]) for r in rows + ball]
    parent = {f: f for f in fps.values()}

    def top(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= 4:
                parent[top(a)] = top(b)
    smallest = {}
    for i, f in ids:
        if i is not None:
            smallest[top(f)] = min(i, smallest.get(top(f), i))
    all_ = docs.unionByName(spark.createDataFrame(ball, DOCS))
    got = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash_dedup.simhash_groups(all_).collect())
    assert got == Counter((i, f, smallest.get(top(f))) for i, f in ids)
    assert simhash_dedup.simhash_groups(none).count() == 0


@pytest.mark.parametrize("count", [10, 10**6, 10**10])
def test_segments_find_all_near_pairs(count):
    parts = simhash_dedup.segments_for(count)
    assert sum(w for _, w, _ in parts) == 64 and sum(r for _, _, r in parts) >= simhash_dedup.RADIUS - len(parts) + 1
    for _ in range(300):
        flips = sum(1 << b for b in _r.sample(range(64), 4))
        assert any((flips >> s & ((1 << w) - 1)).bit_count() <= r for s, w, r in parts)


def _components(fps, pairs):
    parent = {f: f for f in fps}

    def top(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in pairs:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    return {f: top(f) for f in fps}


@pytest.mark.parametrize("hot", [simhash_dedup.HOT, 20, 1])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dense_clusters_keep_their_components(spark, seed, hot):
    r = random.Random(seed)
    centre = r.getrandbits(64)
    flips = lambda most: sum(1 << b for b in r.sample(range(64), r.randrange(0, most)))
    fps = {centre ^ flips(4) for _ in range(200)} | {centre ^ flips(9) for _ in range(150)} | {r.getrandbits(64) for _ in range(50)}
    fps = {f - (f >> 63 << 64) for f in fps}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = [(x.a, x.b) for x in simhash_dedup.near_links(df, len(fps), hot=hot).collect()]
    assert hot < 1000 or len(links) < 4 * len(fps)
    near = [(a, b) for a in fps for b in fps if ((a ^ b) & 2**64 - 1).bit_count() <= 4]
    assert _components(fps, links) == _components(fps, near)


@pytest.mark.parametrize("hot", [simhash_dedup.HOT, 3])
def test_pairs_among_many_unrelated_fingerprints(spark, hot):
    """Here most fingerprints share every segment's value with smaller ones that aren't near."""
    r = random.Random(5)
    fps = {r.getrandbits(63) for _ in range(20_000)}
    pairs = [(f, f ^ sum(1 << b for b in r.sample(range(63), r.randrange(1, 5)))) for f in r.sample(sorted(fps), 300)]
    fps |= {b for _, b in pairs}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = [(x.a, x.b) for x in simhash_dedup.near_links(df, len(fps), hot=hot).collect()]
    assert _components(fps, links) == _components(fps, pairs)


def test_a_crowded_value_at_the_real_limit(spark):
    """More fingerprints than ``HOT`` share a segment's value; planted pairs among them, and others, are linked."""
    r = random.Random(12)
    shift, width, _ = simhash_dedup.segments_for(17_500)[0]
    fixed = ((1 << width) - 1) << shift
    crowd = {r.getrandbits(63) & ~fixed for _ in range(simhash_dedup.HOT + 500)}
    fps = crowd | {r.getrandbits(63) for _ in range(500)}
    pairs = [(f, f ^ sum(1 << b for b in r.sample([b for b in range(63) if not fixed >> b & 1], r.randrange(1, 5)))) for f in r.sample(sorted(crowd), 150)]
    fps |= {b for _, b in pairs}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = [(x.a, x.b) for x in simhash_dedup.near_links(df, len(fps)).collect()]
    assert _components(fps, links) == _components(fps, pairs)


def test_shards(spark, docs, none, rows, tmp_path):
    got = external_shuffle.shuffle_to_shards(docs, str(tmp_path / "a"), 5, bucket_bytes=30_000).collect()
    again = external_shuffle.shuffle_to_shards(docs.repartition(2), str(tmp_path / "b"), 5, bucket_bytes=30_000).collect()
    key = lambda r: (r.doc_id, r.text, r.shard, r.slot)
    assert Counter(map(key, got)) == Counter(map(key, again))
    assert Counter((r.doc_id, r.text, r.bucket) for r in got) == Counter((r[0], r[1], r[3]) for r in rows)
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    ids = spark.range(2000).select(external_shuffle.shard_of(F.col("id"), 16).alias("a"), external_shuffle.shard_of(F.col("id"), 17).alias("b")).collect()
    assert all(r.a == r.b or r.b == 16 for r in ids) and min(Counter(r.a for r in ids).values()) > 80
    assert external_shuffle.shuffle_to_shards(none.coalesce(1), str(tmp_path / "c")).count() == 0


def test_media_round_trip(docs, none, rows):
    got = media_wav.fingerprint_wav(media_wav.store_wav(docs)).collect()
    assert Counter((r.doc_id, bytes(r.payload), r.n_bytes) for r in got) == Counter((r[0], media_wav.payload_of(r[1]), len((r[1] or "").encode())) for r in rows)
    assert all(len(r.payload) % 64 == 0 and len(r.payload) > 0 for r in got)
    by_text = defaultdict(set)
    for r in got:
        by_text[r.text or ""].add(tuple(r.pairs))
    assert all(len(v) == 1 for v in by_text.values())
    assert media_wav.fingerprint_wav(media_wav.store_wav(none)).count() == 0


def test_media_peaks_follow_a_tone():
    t = np.arange(2048)
    tone = np.round(128 + 100 * np.sin(2 * np.pi * 20 * t / media_wav.WINDOW)).astype(np.uint8).tobytes()
    pairs = media_wav.peak_pairs(tone)
    assert len(pairs) and {(p >> 16 & 255, p >> 8 & 255) for p in pairs.tolist()} == {(20, 20)}
    assert len(media_wav.peak_pairs(b"\x80" * 512)) == 0


@pytest.mark.parametrize("block", [segment_topk.CANDIDATES_A_BLOCK, 40])
def test_top_k_against_brute_force(spark, monkeypatch, block):
    """Ties, repeated ids and rows, and several blocks on both sides: every row but the query's own is a candidate."""
    monkeypatch.setattr(segment_topk, "CANDIDATES_A_BLOCK", block)
    monkeypatch.setattr(segment_topk, "QUERIES_A_BLOCK", max(2, block // 20))
    r = np.random.default_rng(4)
    vs = [(i, [float(x) for x in r.normal(size=8)]) for i in range(150)] + [(i, [0.5] * 8) for i in range(150, 200)]
    vs += [(0, vs[0][1]), (0, [2.0] * 8), (7, [3.0] * 8), (7, [3.0] * 8)]
    odd = [(500, None), (550, []), (600, [1.0, None] + [0.0] * 6), (650, [float("nan")] * 8), (700, [float("inf")] * 8), (None, [1.0] * 8), (750, [1.0, 2.0])]
    df = spark.createDataFrame(vs + odd, "vec_id long, embedding array<double>").repartition(3)
    v = segment_topk.integer_vectors(df)
    got = Counter((x.query_id, x["rank"], x.vec_id, x.score) for x in segment_topk.top_k(v, v.where("vec_id % 50 = 0")).collect())
    whole = [(i, [int(np.floor(256 * x)) for x in e]) for i, e in vs]
    want = Counter()
    for row, (q, own) in enumerate(whole):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(own, other)), c) for n, (c, other) in enumerate(whole) if n != row)[:5]
            want.update((q, n + 1, c, -s) for n, (s, c) in enumerate(best))
    assert got == want
    few = segment_topk.integer_vectors(df.where("vec_id IN (0, 3) AND size(embedding) = 8"))
    assert Counter(x.query_id for x in segment_topk.top_k(few, few.where("vec_id = 0")).collect()) == {0: 9}
    assert segment_topk.top_k(v.where("FALSE"), v.where("FALSE")).count() == 0


@pytest.mark.parametrize(("spread", "most"), [(0.05, 0.1), (0.5, 0.5), (None, 1.0)])
def test_top_k_spares_products(spread, most):
    """Of vectors near a few centres most products are never computed; of vectors in all directions alike, many are. The answer is the full scan's."""
    r = np.random.default_rng(2)
    centres = r.normal(size=(20, 64))
    v = r.normal(size=(4000, 64)) if spread is None else centres[r.integers(0, 20, 4000)] + spread * r.normal(size=(4000, 64))
    v = np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)
    rows, left = np.arange(4000), []
    got = segment_topk.best_of_block(rows[:40], v[:40], rows, rows, v, 5, left)
    want = []
    for i in range(40):
        scores = v @ v[i]
        want += [(i, j, int(scores[j])) for j in sorted((j for j in range(4000) if j != i), key=lambda j: (-scores[j], j))[:5]]
    assert got == want
    left = np.array(left)
    assert (np.diff(left, axis=1) <= 0).all() and left[:, -1].sum() <= most * left[:, 0].sum()


@pytest.mark.parametrize("seed", range(8))
def test_top_k_of_large_components(seed):
    """Large components that differ little: their deviations are small differences of large squares, and bounds must hold all the same."""
    r = np.random.default_rng(seed)
    v = 2**27 + r.integers(-2, 3, size=(200, 33))
    v[0] = r.integers(-(2**27), 2**27, size=33)
    rows = np.arange(200)
    whole = v.tolist()
    want = []
    for i in range(3):
        scores = [sum(a * b for a, b in zip(whole[i], c, strict=True)) for c in whole]
        want += [(i, j, scores[j]) for j in sorted((j for j in range(200) if j != i), key=lambda j: (-scores[j], j))[:5]]
    assert segment_topk.best_of_block(rows[:3], v[:3], rows, rows, v, 5) == want


def test_top_k_beyond_longs(spark):
    """A component that no long holds takes part; the products that are asked for are longs."""
    vs = [(0, [0.0, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 3.0]), (3, [0.5, -1.0])]
    v = segment_topk.integer_vectors(spark.createDataFrame(vs, "vec_id long, embedding array<double>"))
    got = segment_topk.top_k(v, v.where("vec_id % 50 = 0")).orderBy("rank").collect()
    assert [tuple(x) for x in got] == [(0, 1, 2, 3 * 256**2), (0, 2, 1, 2 * 256**2), (0, 3, 3, -(256**2))]


@pytest.mark.parametrize(("hub", "small"), [(components.HUB, components.SMALL), (3, components.SMALL), (3, 0)])
def test_components_with_hubs(spark, monkeypatch, hub, small):
    monkeypatch.setattr(components, "SMALL", small)
    r = random.Random(6)
    links = [(i, 5000 - i % 3) for i in range(100)] + [(i, i + 1) for i in range(200, 260)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(70)] + [(7, 7), (50, 4998)]
    parent = {x: x for p in links for x in p}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    df = spark.createDataFrame(links, "a long, b long")
    got = {x.id: x.label for x in components.connected_components(df, hub).collect()}
    assert got == {x: top(x) for a, b in links if a != b for x in (a, b)}


def test_snapshots_collapse(spark):
    turns = [(c, t, role, text) for c, texts in {1: "ab", 2: "abc", 3: "abc", 4: "b", 5: "abd", 6: "a"}.items() for t, text in enumerate(texts) for role in ["u"]]
    turns += [(7, 0, None, None), (8, 0, None, ""), (8, 1, "u", "x"), (None, 0, "u", "a"), (9, 0, "u", "q"), (9, 0, "u", "q")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("prefix", F.lit(1))
    kept = {(r.conv_id, r.n_turns) for r in chat_snapshots.maximal(df).collect()}
    assert kept == {(2, 3), (4, 1), (5, 3), (7, 1), (8, 2), (9, 2)}
    shown = {r.conv_id: r.rendered for r in chat_snapshots.render(df.where("conv_id IN (2, 7)")).collect()}
    assert shown == {2: "<|u|>\na\n<|u|>\nb\n<|u|>\nc\n", 7: "<||>\n\n"}
    assert chat_snapshots.maximal(df.where("FALSE")).count() == 0


def test_toxicity_learns_held_out_rows(spark):
    rows, labels = [], []
    for i in range(1500):
        bad = _r.random() < 0.2
        text = " ".join(_r.choices(WORDS, k=40) + (["grobian", "Grobian!"] if bad else []))
        rows.append((i, text, "xx", None, None, None))
        if i % 2:
            labels.append((i, int(bad)))
    rows += [(9001, None, "xx", None, None, None), (9002, "", "xx", None, None, None), (9003, LONG + " grobian", "xx", None, None, None)]
    labels += [(None, 1), (5, None), (99_999, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity_pu.train(docs, marks)
    got = {r.doc_id: r.score for r in toxicity_pu.score(docs, model).collect()}
    held = [(i, y) for i, y in labels if i in got and y is not None and zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and all((got[i] >= 0.5) == (y == 1) for i, y in held)
    assert got[9001] == got[9002] < 0.5 <= got[9003]
    assert toxicity_pu.train(docs, marks.where("FALSE")).score("grobian") < 0.5


def test_nnpu_risk_holds_back_overfitting():
    r = np.random.default_rng(1)
    row = lambda bad: np.unique(np.append(r.integers(1, 60, 6), [0] if bad else []).astype(int))
    w, b = toxicity_pu.fit_nnpu([row(True) for _ in range(300)], [row(i % 5 == 0) for i in range(1500)], 60, 0.2)
    fresh = [(w[row(y)].sum() + b > 0) == y for y in [True, False] * 100]
    assert np.mean(fresh) > 0.95


def test_language_of_held_out_rows(spark, docs, none):
    speak = {"aa": "bado keru mito", "bb": "striengel wurchst pfand", "cc": "élou aieux çon"}
    rows = []
    for i in range(600):
        lang = list(speak)[i % 3]
        rows.append((i, " ".join(_r.choices(speak[lang].split(), k=12)), lang, None, None, None))
    rows += [(9001, None, "aa", None, None, None), (9002, "12 !?", "aa", None, None, None), (9003, "bado keru " * 90_000, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    found = {r.doc_id: (r.lang_pred, r.lang_score) for r in language_bitmask.identify(df, language_bitmask.train(df)).collect()}
    assert all(found[i][0] == lang and 0 <= found[i][1] <= 1 for i, _, lang, *_ in rows[:600])
    assert found[9001] == found[9002] == ("und", 0.0) and found[9003][0] == "aa"
    assert {r.lang_pred for r in language_bitmask.identify(df, language_bitmask.train(none)).collect()} == {"und"}
    assert sorted(r.doc_id for r in language_bitmask.language_stage(spark, df, "").collect()) == [*range(600), 9003]


def test_grams_do_not_depend_on_pieces(monkeypatch):
    whole = Counter(h for part in language_bitmask.gram_hashes(LONG[:5000]) for h in part.tolist())
    monkeypatch.setattr(language_bitmask, "_PIECE", 700)
    assert Counter(h for part in language_bitmask.gram_hashes(LONG[:5000]) for h in part.tolist()) == whole


def test_folds(spark):
    got = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_digest_of_an_empty_payload():
    assert hashlib.sha256(media_wav.payload_of(None)).hexdigest() == hashlib.sha256(b"\0" * 64).hexdigest()

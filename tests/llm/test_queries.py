"""Every registered query on awkward rows, against plain versions of its contract."""

import hashlib
import random
import wave
import zlib
from collections import Counter, defaultdict
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F
from roadloom import llm
from roadloom.llm import external_shuffle, language_bitmask, media_wav, packing, toxicity_pu
from roadloom.llm.tokens import VOCABULARY, tokenizer

from tests.conftest import SF

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, fp string, ids string, bucket long, media binary, pairs string"


def _texts():
    r = random.Random(21)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randrange(2, 8))) for _ in range(400)]
    some = [" ".join(r.choices(words, k=r.randrange(5, 150))) for _ in range(60)]
    long = " ".join(f"{r.choice(words)}{r.randrange(50)}" for _ in range(1_000_000))
    odd = [None, "", " ", "\n\t ", "one", "ÉÀ 中文 ½    x", "a <|endoftext|> b", "it's  what’s\r\n\r\nup", "1234567890 " * 40, "🙂🙃 é"]
    return [*odd, *some, *some[:3], some[0], long]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    made = [(i, t, r.choice(["en", "de", "fr", None]), "s", None) for i, t in enumerate(_texts())]
    return made + [(None, "no id here", None, None, None), (3, "\n\t ", "en", "s", 1), (3, "\n\t ", "en", "s", 1)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("awkward"))
    clash = (7, 0.5, "f", "i", 2, b"m", "p")
    spark.createDataFrame([(*x, *clash) for x in rows], DOCUMENTS).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int(i % 3 == 0)) for i in range(60)] + [(1, 0, 1), (None, 1, 1), (2, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("FALSE").write.parquet(f"{at}/{name}.parquet")
    for name in ("embeddings", "conversations"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("FALSE").write.parquet(f"{at}/{name}.parquet")
    return at


def run(spark, folder, name):
    return llm.queries()[name](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert run(spark, empty, name) == []


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_queries_say_what_they_do(name):
    assert llm.queries()[name].__doc__


def test_op1_scores_every_row(spark, folder, rows):
    got = run(spark, folder, "op1_masked_lm")
    words = lambda t: len((t or "").lower().split())
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((x[0], words(x[1])) for x in rows)
    assert all((r.per_token is None) == (r.n_tokens == 0) and r.log_likelihood <= 0 for r in got)


def test_op2_follows_its_law(spark, folder, rows):
    got = run(spark, folder, "op2_external_shuffle")
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((x[0], size(x[1]), zlib.crc32((x[1] or "").encode())) for x in rows)
    assert {r.law for r in got} == {"key"} and all(0 <= r.shard < 16 for r in got)
    assert all(r.grown_shard in (r.shard, 16) for r in got)
    by_id, by_shard = defaultdict(set), defaultdict(list)
    for r in got:
        by_id[r.doc_id].add((r.shard, r.grown_shard))
        by_shard[r.shard].append(r.slot)
    assert all(len(v) == 1 for v in by_id.values())
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())


def test_op2_spreads_buckets_over_shuffles(spark):
    """Every row once, under its own buckets, and no shuffle over the limit; beyond its square there is no way."""
    rows = spark.range(3000).select("id", F.xxhash64("id").alias(external_shuffle._ORDER))
    for buckets, fan_out in ((1, 10), (10, 10), (11, 10), (37, 10), (99, 10), (100, 10)):
        parts = external_shuffle._spread(rows, F.col("id") % buckets, buckets, fan_out)
        assert [p[1] for p in parts] == [sum(q[2] for q in parts[:i]) for i in range(len(parts))]
        assert sum(p[2] for p in parts) == buckets and max(p[2] for p in parts) <= fan_out and len(parts) <= fan_out
        seen = [(r.id, first <= r.id % buckets < first + count) for part, first, count in parts for r in part.collect()]
        assert sorted(seen) == [(i, True) for i in range(3000)]
        if len(parts) > 1:
            assert len(parts[0][0].inputFiles()) <= fan_out
    with pytest.raises(ValueError, match="squared"):
        external_shuffle._spread(rows, F.col("id") % 101, 101, 10)


def test_op2_by_a_plain_shuffle(spark, tmp_path):
    """Buckets by the same hashes, then numpy's Fisher-Yates over rows in order of id: the same slots; a file a bucket, in order."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    got = {(r.doc_id): (r.shard, r.slot) for r in external_shuffle.shuffle_to_shards(docs, str(tmp_path / "s"), 3, bucket_bytes=1500).collect()}
    total = sum(i % 50 + 1 for i in range(500))
    buckets = 1 + total // (3 * 1500)
    at = docs.select("doc_id", external_shuffle.shard_of(F.col("doc_id"), 3).alias("s"), F.pmod(F.xxhash64(F.lit(external_shuffle.SEED + 1), "doc_id", "text"), F.lit(buckets)).alias("b")).collect()
    want, start = {}, defaultdict(int)
    for s in range(3):
        for b in range(buckets):
            own = sorted(r.doc_id for r in at if (r.s, r.b) == (s, b))
            order = np.random.Generator(np.random.PCG64([external_shuffle.SEED, s, b])).permutation(len(own))
            for i, k in enumerate(order):
                want[own[k]] = (s, start[s] + i)
            start[s] += len(own)
    assert got == want
    # groups of buckets first, if one shuffle mayn't have a partition for each
    for fan_out in (4, 5, 3 * buckets - 1):
        rows = external_shuffle.shuffle_to_shards(docs, str(tmp_path / f"by{fan_out}"), 3, bucket_bytes=1500, fan_out=fan_out).collect()
        assert {r.doc_id: (r.shard, r.slot) for r in rows} == want and len(rows) == 500
    files = [p for p in (tmp_path / "s").rglob("*.parquet")]
    assert len(files) == len({p.parent for p in files}) == len({(r.s, r.b) for r in at})
    import pyarrow.parquet as pq

    for p in files:
        position = pq.ParquetFile(p).read().column("_position").to_pylist()
        assert position == list(range(len(position)))


def test_op3_scores_every_row(spark, folder, rows):
    got = run(spark, folder, "op3_toxicity_nnpu")
    assert Counter(r.doc_id for r in got) == Counter(x[0] for x in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_op3_risk_and_slopes_by_their_definition():
    r = np.random.default_rng(1)
    for prior, shift in ((0.2, 0.0), (0.6, 3.0)):
        z, is_p = r.normal(size=40) + shift, np.arange(40) < 15
        loss = lambda y, z=z: np.log(1 + np.exp(-y * z))
        positive, negative = prior * loss(1)[is_p].mean(), loss(-1)[~is_p].mean() - prior * loss(-1)[is_p].mean()
        assert toxicity_pu.risk(z, is_p, prior) == pytest.approx((positive, negative))
        slopes = toxicity_pu.risk_slopes(z, is_p, prior)
        for i in range(0, 40, 3):
            parts = []
            for step in (1e-6, -1e-6):
                moved = z.copy()
                moved[i] += step
                parts.append(toxicity_pu.risk(moved, is_p, prior))
            a, b = ((x - y) / 2e-6 for x, y in zip(*parts, strict=True))
            assert slopes[i] == pytest.approx(a + b if negative >= 0 else -b, abs=1e-6)


def test_op4_is_the_librarys(spark, folder, rows):
    library = tokenizer(VOCABULARY)
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        want[(doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in run(spark, folder, "op4_bpe_words")) == want


def test_op5_columns(spark, folder, rows):
    got = run(spark, folder, "op5_language_bitmask")
    assert Counter(r.doc_id for r in got) == Counter(x[0] for x in rows)
    texts = {x[0]: x[1] for x in rows}
    for r in got:
        letters = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
        assert r.lang_pred in ("en", "de", "fr", "und")


def test_op5_against_exact_sets_of_grams(spark):
    """Twelve languages, more than an octet has bits: the answer is the language most of whose grams a text has."""
    r = random.Random(8)
    names = [f"l{i:02d}" for i in range(12)]
    words = {n: ["".join(r.choices("abcdefghijklmnopqrstuvwxyz"[i : i + 12], k=r.randrange(4, 8))) for _ in range(120)] for i, n in enumerate(names)}
    rows = [(i, " ".join(r.choices(words[names[i % 12]], k=40)), names[i % 12]) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_bitmask.identify(docs.drop("lang"), language_bitmask.train(docs)).collect()
    grams = lambda t: {w[k : k + n] for w in t.split() for n in (3, 4) for k in range(len(w) - n + 1)}
    sets = {n: set().union(*(grams(t) for i, t, lang in rows if lang == n and zlib.crc32(str(i).encode()) % 5)) for n in names}
    right = same = held = 0
    for x in found:
        if zlib.crc32(str(x.doc_id).encode()) % 5 == 0:
            text, lang = rows[x.doc_id][1:]
            own = grams(text)
            exact = max(names, key=lambda n: len(own & sets[n]))
            held, right, same = held + 1, right + (x.lang_pred == lang), same + (x.lang_pred == exact)
    assert held > 150 and right >= 0.95 * held and same >= 0.95 * held


def test_op8_packs_every_id_once(spark, folder, rows):
    library = tokenizer(VOCABULARY)
    got = run(spark, folder, "op8_vector_packing")
    ids = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
    texts, copies, by_doc, by_sequence = {x[0]: x[1] for x in rows}, Counter(x[0] for x in rows), defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, pieces in by_doc.items():
        own = ids(texts[doc_id])
        assert all(r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes()) for r in pieces)
        covered = np.zeros(len(own), dtype=int)
        for r in pieces:
            covered[r.start : r.start + r.length] += 1
        assert (covered == copies[doc_id]).all()
    assert set(by_doc) == set(copies)
    for pieces in by_sequence.values():
        ends = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == ends
            ends += r.length
        assert ends <= 2048 and len(pieces) <= packing.MAX_SEGMENTS


def _plain_bins(sizes, limits, vectors=True):
    """The rule, one item at a time: of what fits, the largest dot product with what is left; one-dimensional: the largest."""
    left, bins = set(range(len(sizes))), []
    while left:
        room, own = list(limits), []
        while True:
            fits = [i for i in sorted(left) if all(s <= x for s, x in zip(sizes[i], room, strict=True))]
            if not fits:
                break
            best = max(fits, key=lambda i: (sum(s * x / m**2 for s, x, m in zip(sizes[i], room, limits, strict=True)) if vectors else sizes[i][0], -i))
            own.append(best)
            left.discard(best)
            room = [x - s for x, s in zip(room, sizes[best], strict=True)]
        bins.append(own)
    return bins


def test_op8_by_a_plain_packer():
    r = random.Random(6)
    sizes = [(n := r.randrange(20, 700), 1, r.randrange(1, n)) for _ in range(150)]
    limits = (1000, 5, 400)
    sizes = [s for s in sizes if s[2] <= 400]
    got = [[i for i, _, _ in b] for b in packing.pack_vectors(np.array(sizes), np.array(limits), cut=False)]
    assert got == _plain_bins(sizes, limits) != _plain_bins(sizes, limits, vectors=False)


@pytest.mark.parametrize("closes", ["tokens", "segments", "loss"])
def test_op8_each_limit_closes_a_sequence(spark, closes):
    """Instruction data, with prompts that bear no loss: one limit at a time is the one that binds."""
    long, short = " ".join(["prompt"] * 60), "ask"
    prompt, text = {"tokens": (long, "two words"), "segments": (short, "two"), "loss": (short, " ".join(["words"] * 60))}[closes]
    docs = spark.createDataFrame([(i, prompt, text) for i in range(64)], "doc_id long, asked string, text string")
    pieces = packing.tokenized_pieces(docs, prompt="asked")
    limits = {"max_tokens": 512, "max_segments": 12, "max_loss": 200}
    held = defaultdict(lambda: np.zeros(3, dtype=int))
    loss = {r.doc_id: r.loss for r in pieces.collect()}
    for r in packing.packed(pieces, 1, **limits, cut=False).collect():
        held[r.sequence_id] += (r.length, 1, loss[r.doc_id])
    most = np.array(list(held.values())).max(axis=0)
    one = np.array([next(iter(pieces.select("length").collect())).length, 1, loss[0]])
    full = {k: bool(m + o > x) for k, m, o, x in zip(("tokens", "segments", "loss"), most, one, (512, 12, 200), strict=True)}
    assert full == {k: k == closes for k in full}


def test_op10_stores_and_reads_back(spark, folder, rows):
    got = run(spark, folder, "op10_media_wav")
    want = Counter()
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        out = BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(media_wav.RATE)
            w.writeframes(payload)
        media = out.getvalue()
        want[(doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())] += 1
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    assert Counter(tuple(r[n] for n in names) for r in got) == want
    assert all(r.feature.split(":")[0] == str(len(r.pairs)) for r in got)


def test_op10_peaks_by_a_plain_transform():
    """Frame by frame, bin by bin, with sums of cosines and sines."""
    r = np.random.default_rng(5)
    samples = np.clip(np.round(128 + 60 * np.sin(np.arange(700) * 0.4) + r.normal(0, 20, 700)), 0, 255).astype(np.uint8)
    wave_ = samples.astype(float) - 128
    count = 1 + -(-(700 - media_wav.WINDOW) // media_wav.STEP)
    wave_ = np.pad(wave_, (0, (count - 1) * media_wav.STEP + media_wav.WINDOW - 700))
    n = np.arange(media_wav.WINDOW)
    hann, peaks = 0.5 - 0.5 * np.cos(2 * np.pi * n / media_wav.WINDOW), []
    for f in range(count):
        frame = wave_[f * media_wav.STEP :][: media_wav.WINDOW] * hann
        power = [(frame * np.cos(2 * np.pi * k * n / media_wav.WINDOW)).sum() ** 2 + (frame * np.sin(2 * np.pi * k * n / media_wav.WINDOW)).sum() ** 2 for k in range(1, media_wav.WINDOW // 2)]
        peaks.append(int(np.argmax(power)) + 1)
    want = sorted(f << 24 | peaks[f] << 16 | peaks[f + g] << 8 | g for g in (1, 2) for f in range(count - g))
    assert media_wav.peak_pairs(samples.tobytes()).tolist() == want


def test_op9_components_on_awkward_rows(spark, folder, rows):
    got = run(spark, folder, "op9_simhash_dedup")
    assert Counter(r.doc_id for r in got) == Counter(x[0] for x in rows)
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {0, 1, 2, 3} <= {r.doc_id for r in zero} and {r.component_id for r in zero} == {0}
    assert all(len(r.fingerprint) == 16 for r in got)

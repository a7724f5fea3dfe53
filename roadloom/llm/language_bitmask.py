"""Language identification by bit-sliced Bloom filters of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.common import held_out, rows_of, sample_share, table

#: About how many documents of each language the filters are built from.
SAMPLE_A_LANGUAGE = 1500
SIZES, PROBES, SLOTS_A_GRAM = (3, 4), 3, 12
#: An n-gram enters a language's filter if it is there twice, and at least this share of its best language's rate.
LEAST_COUNT, LEAST_SHARE = 2, 0.1
SEED, UND = 5, "und"
#: The stage's bound on the score.
LEAST_KNOWN = 0.4
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
_PIECE = 1 << 20
_letters: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), dtype=bool))
    return _letters[0][codes]


def gram_hashes(text: str | None) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of a whole text, piece by piece.

    Letters are lower-cased; what stands between them counts as one space, and
    the text begins and ends with one.
    """
    text = (text or "").lower()
    carry = np.array([32], dtype=np.uint64)
    for at in range(0, len(text) + 1, _PIECE):
        codes = np.frombuffer(text[at : at + _PIECE].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes = np.where(_is_letter(codes), codes, 32).astype(np.uint64)
        stream = np.concatenate([carry, codes, [32] if at + _PIECE > len(text) else []]).astype(np.uint64)
        stream = stream[np.append(True, (stream[1:] != 32) | (stream[:-1] != 32))] if len(stream) else stream
        for n in SIZES:
            # n-grams that lie wholly in the carried part were given before
            first = max(0, len(carry) - n + 1) if at else 0
            if len(stream) - first < n:
                continue
            h = np.full(len(stream) - first - n + 1, n, dtype=np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) ^ stream[first + k : len(stream) - n + 1 + k]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            yield h ^ (h >> np.uint64(32))
        carry = stream[-(max(SIZES) - 1) :]


@dataclass(frozen=True)
class Filters:
    """A table of slots; in each slot one bit a language, in octets of eight languages."""

    languages: list[str]
    slots: list[np.ndarray]
    false_rates: np.ndarray

    def masks(self, hashes: np.ndarray, octet: int) -> np.ndarray:
        """Of each n-gram all languages of the octet whose filters hold it: AND over the probed slots."""
        size, found = np.uint64(len(self.slots[octet])), None
        step = (hashes >> np.uint64(33)) | np.uint64(1)
        for k in range(PROBES):
            at = (hashes + np.uint64(k) * step) % size
            found = self.slots[octet][at] if found is None else found & self.slots[octet][at]
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        total, hits = 0, np.zeros(len(self.languages))
        for hashes in gram_hashes(text) if text and any(c.isalpha() for c in text) else ():
            total += len(hashes)
            for o in range(len(self.slots)):
                counts = np.bincount(self.masks(hashes, o), minlength=256) @ _BITS
                hits[8 * o : 8 * o + 8] += counts[: len(self.languages) - 8 * o]
        if not total or not self.languages:
            return UND, 0.0
        # of n-grams that a language lacks, the filter still claims its false rate
        true = np.clip((hits - total * self.false_rates) / (1 - self.false_rates), 0, total)
        best = int(np.argmax(true))
        return self.languages[best], float(true[best] / total)


def train(docs: DataFrame, sample: int = SAMPLE_A_LANGUAGE) -> Filters:
    """Filters from whole texts of about ``sample`` documents of each ``lang``, drawn by a hash of doc_id.

    Rows of the held-out fold and rows without text, lang or id don't train;
    without any, no language is known and every text is ``und``.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    totals = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Filters([], [], np.zeros(0))
    shares = F.create_map(*(F.lit(x) for lang in languages for x in (lang, sample / totals[lang])))
    drawn = known.where(sample_share(F.col("doc_id"), SEED) < shares[F.col("lang")]).select("lang", "text")
    index = {lang: i for i, lang in enumerate(languages)}

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in rows_of(batches, "lang", "text", size=256):
            found: dict[int, list[np.ndarray]] = {}
            for lang, text in zip(langs, texts, strict=True):
                found.setdefault(index[lang], []).extend(gram_hashes(text))
            for i, parts in found.items():
                grams, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
                arrays = [pa.array(np.full(len(grams), i)), pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "gram", "n"])

    counts = drawn.mapInArrow(counted, "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    own = counts.where(F.col("n") >= LEAST_COUNT).toArrow()
    lang, gram, n = (own.column(c).to_numpy() for c in ("lang", "gram", "n"))
    gram = gram.view(np.uint64)
    totals_n = np.maximum(np.bincount(lang, weights=n, minlength=len(languages)), 1)
    rate = n / totals_n[lang]
    grams, where = np.unique(gram, return_inverse=True)
    top = np.zeros(len(grams))
    np.maximum.at(top, where, rate)
    keep = rate >= LEAST_SHARE * top[where]
    size = 1 + SLOTS_A_GRAM * max(64, int(np.bincount(lang[keep], minlength=len(languages)).max(initial=0)))
    slots = [np.zeros(size, dtype=np.uint8) for _ in range(0, len(languages), 8)]
    step = (gram >> np.uint64(33)) | np.uint64(1)
    for k in range(PROBES):
        at = (gram + np.uint64(k) * step) % np.uint64(size)
        for o, slot in enumerate(slots):
            mine = keep & (lang // 8 == o)
            np.bitwise_or.at(slot, at[mine], (1 << (lang[mine] % 8)).astype(np.uint8))
    fill = np.concatenate([((s[:, None] >> np.arange(8)) & 1).mean(axis=0) for s in slots])[: len(languages)]
    return Filters(languages, slots, fill**PROBES)


def identify(docs: DataFrame, filters: Filters, into: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with the columns ``into``: the language, and the corrected share of n-grams that the language's filter holds.

    Null texts and texts without a letter are ``und`` with score 0. Ties go to the
    first language in order of name. Repeated rows are kept.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [filters.predict(t.as_py()) for t in batch.column("text")]
            arrays = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *into])

    kept = docs.drop(*into)
    fields = [T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType())]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


def op5_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the folds that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language stay; those without letters, or in none of the languages, go.

    A text is in none if its best language's filter holds under ``LEAST_KNOWN`` of its n-grams.
    """
    found = identify(docs, train(docs), ("_lang", "_known"))
    return found.where((F.col("_lang") != UND) & (F.col("_known") >= LEAST_KNOWN)).select(docs.columns)

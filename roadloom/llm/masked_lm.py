"""Masked pseudo-likelihood scores of a bidirectional window network."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.common import checkpointed, table

#: Classes of a token: 0 pads, the most frequent words have their own, all others share one by their form.
OWN, FORMS = 63, 64
TARGETS = 1 + OWN + FORMS
#: Coarser classes of the neighbours: of the next ones 31 words and 32 forms, of those beyond 3 forms.
NEAR_OWN, NEAR, FAR = 31, 64, 4
CONTEXTS = NEAR * NEAR * FAR * FAR
CELLS_A_BLOCK = CONTEXTS // NEAR * TARGETS
#: Sizes of the embeddings and the hidden layer; steps, contexts a step, rate and decay (a pull as strong as so many tokens).
NEAR_EMBED, FAR_EMBED, HIDDEN = 24, 8, 48
STEPS, BATCH, RATE, DECAY, SEED = 500, 2048, 0.02, 20.0, 1
#: Most words that tasks hold; the others are joined. The number decides the cost, not the scores.
HELD = 200_000
#: Counts of so many tasks are added up in one place.
FAN = 64
_SPAN = 1 << 20


def tokens_of(text: str | None) -> list[str]:
    """Lower-cased runs between white space."""
    return (text or "").lower().split()


def form_of(word: str) -> int:
    """Words with the same last two characters share a form."""
    return crc32(word[-2:].encode("utf-8", "surrogatepass")) % FORMS


def _form(word: Column) -> Column:
    return F.crc32(F.substring(word, -2, 2).cast("binary")) % FORMS


class Words(dict):
    """Index of every held word; other words give ``-1 - form``."""

    def __missing__(self, word: str) -> int:
        return -1 - form_of(word)


def _code(target: int, near: int, far: int) -> int:
    return target | near << 7 | far << 13


_FORM_CODES = [_code(1 + OWN + f, 1 + NEAR_OWN + f % (NEAR - 1 - NEAR_OWN), 1 + f % (FAR - 1)) for f in range(FORMS)]


@dataclass(frozen=True)
class Network:
    """``log p(word | two tokens before and two after)``: that of the word's class, by one hidden layer
    over the neighbours' embeddings, and of the word's share in its class.

    ``codes`` and ``rates`` hold, by index, the classes and the logarithm of the share of the held
    words, and at their ends those of the forms (no share: it is the word's own). ``tokens``
    has the corpus's tokens of each form, and ``counts(word, n)`` those of every word.
    """

    words: Words
    codes: np.ndarray
    rates: np.ndarray
    tokens: tuple[int, ...]
    params: tuple[np.ndarray, ...] | None = None
    counts: DataFrame | None = None

    def indexes(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    def cells(self, indexes: np.ndarray) -> np.ndarray:
        """For each position the number of its context and class."""
        n, codes = len(indexes), np.pad(self.codes[indexes], 2)
        near, far = codes >> 7 & NEAR - 1, codes >> 13
        sides = (near[1 : n + 1] * NEAR + near[3 : n + 3]) * FAR + far[:n]
        return (sides * FAR + far[4:]) * TARGETS + (codes[2 : n + 2] & TARGETS - 1)

    @cached_property
    def log_probabilities(self) -> np.ndarray:
        """Of every class in every context, by ``cells``; worked out once in each process."""
        assert self.params is not None
        parts = [_forward(self.params, np.arange(at, at + 4096))[0] for at in range(0, CONTEXTS, 4096)]
        return np.concatenate(parts).astype(np.float32).ravel()

    def log_likelihood(self, indexes: np.ndarray) -> float:
        """The sum over all positions of held words; of other words, the class's part alone."""
        total = float(self.rates[indexes].sum())
        cells = self.cells(indexes)
        for at in range(0, len(cells), _SPAN):
            total += float(self.log_probabilities[cells[at : at + _SPAN]].sum(dtype=np.float64))
        return total


def _neighbours(context: np.ndarray) -> tuple[np.ndarray, ...]:
    return context // (NEAR * FAR * FAR), context // (FAR * FAR) % NEAR, context // FAR % FAR, context % FAR


def _forward(params: tuple[np.ndarray, ...] | list[np.ndarray], context: np.ndarray) -> tuple[np.ndarray, ...]:
    """Log-probabilities of the classes, the hidden layer and its input."""
    *embeds, w1, b1, w2, b2 = params
    x = np.concatenate([e[i] for e, i in zip(embeds, _neighbours(context), strict=True)], axis=1)
    h = np.tanh(x @ w1 + b1)
    z = h @ w2 + b2
    # nothing predicts padding
    z[:, 0] = -np.inf
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True)), h, x


def initial(totals: np.ndarray) -> list[np.ndarray]:
    """Seeded small weights; the output's offset starts at the classes' log share."""
    r = np.random.Generator(np.random.PCG64(SEED))
    wide = 2 * NEAR_EMBED + 2 * FAR_EMBED
    draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    embeds = [(r.standard_normal((n, e)) * 0.3).astype(np.float32) for n, e in ((NEAR, NEAR_EMBED),) * 2 + ((FAR, FAR_EMBED),) * 2]
    share = (totals + 1) / (totals + 1).sum()
    return [*embeds, draw(wide, HIDDEN), np.zeros(HIDDEN, np.float32), draw(HIDDEN, TARGETS) * np.float32(0.1), np.log(share).astype(np.float32)]


def slopes(params: list[np.ndarray], context: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Of the mean negative log-likelihood of tokens that ``counts`` has by context and class."""
    logp, h, x = _forward(params, context)
    dz = np.exp(logp) * counts.sum(axis=1, keepdims=True) - counts
    dz /= counts.sum()
    w1, w2 = params[4], params[6]
    dh = (dz @ w2.T) * (1 - h * h)
    dx, at, out = dh @ w1.T, 0, []
    for embed, index in zip(params[:4], _neighbours(context), strict=True):
        d = np.zeros_like(embed)
        np.add.at(d, index, dx[:, at : at + embed.shape[1]])
        out.append(d)
        at += embed.shape[1]
    return [*out, x.T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0)]


def fit(context: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Trains the network on the counts of every class in every context, in seeded order (Adam)."""
    params = initial(counts.sum(axis=0))
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    r, total, waiting = np.random.Generator(np.random.PCG64(SEED)), float(counts.sum()), np.zeros(0, dtype=np.int64)
    for step in range(1, STEPS + 1):
        if len(waiting) < min(BATCH, len(context)):
            waiting = np.concatenate([waiting, r.permutation(len(context))])
        own, waiting = waiting[:BATCH], waiting[BATCH:]
        rate = RATE * (1 - step / (STEPS + 1))
        for p, m, v, slope in zip(params, first, second, slopes(params, context[own], counts[own].astype(np.float32)), strict=True):
            if p.ndim > 1:
                slope = slope + np.float32(DECAY / total) * p
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            p -= np.float32(rate / (1 - 0.9**step)) * m / (np.sqrt(v / (1 - 0.99**step)) + np.float32(1e-8))
    return tuple(params)


def _rate(n: int, tokens: int) -> float:
    """``log p(word | class)`` of a word that occurs ``n`` times in a class of ``tokens``; all unseen words share one more token."""
    return log(max(n, 1) / (tokens + 1))


def _word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of every word of the corpus."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for text in batch.column("text"):
                found.update(tokens_of(text.as_py()))
            arrays = [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["word", "n"])

    counts = docs.select("text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return checkpointed(counts)


def _vocabulary(counts: DataFrame, held: int) -> Network:
    """The words that tasks hold: all above a count that at most ``held`` words reach, and always those with classes of their own."""
    step = F.floor(F.log2("n") * 16)
    steps = sorted(((r.step, r.words) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, words = None, 0
    for at, more in steps:
        words += more
        if words > held:
            break
        least = at
    most = counts.orderBy(F.col("n").desc(), "word").limit(OWN)
    frequent = counts.where(step >= least if least is not None else F.lit(False)).union(most).distinct().toArrow().to_pylist()
    frequent.sort(key=lambda r: (-r["n"], r["word"]))
    tokens = [0] * FORMS
    for r in counts.groupBy(_form(F.col("word")).alias("form")).agg(F.sum("n").alias("n")).collect():
        tokens[r.form] = r.n
    forms = [form_of(r["word"]) for r in frequent]
    for r, form in zip(frequent[:OWN], forms, strict=False):
        tokens[form] -= r["n"]
    codes, rates = [], []
    for i, (r, form) in enumerate(zip(frequent, forms, strict=True)):
        shared = _FORM_CODES[form]
        near = 1 + i if i < NEAR_OWN else shared >> 7 & NEAR - 1
        codes.append(_code(1 + i if i < OWN else 1 + OWN + form, near, shared >> 13))
        rates.append(0.0 if i < OWN else _rate(r["n"], tokens[form]))
    codes, rates = np.array([*codes, *_FORM_CODES[::-1]]), np.array([*rates, *[0.0] * FORMS])
    return Network(Words((r["word"], i) for i, r in enumerate(frequent)), codes, rates, tuple(tokens), counts=counts)


def _statistics(docs: DataFrame, network: Network) -> DataFrame:
    """``(block, part, at, n)``: how often each class occurs in each context, over all tokens.

    Every task counts its documents; the counts of ``FAN`` tasks at a time are added up until each block has one row.
    """
    bare = docs.sparkSession.sparkContext.broadcast(replace(network, counts=None))
    schema = "block int, part long, at binary, n binary"

    def rows(found: Iterable[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        squeeze, out = zstandard.ZstdCompressor().compress, []
        for block, part, cells in found:
            at = np.flatnonzero(cells)
            if len(at):
                out.append((block, part, squeeze(at.astype("<u4").tobytes()), squeeze(cells[at].astype("<i8").tobytes())))
        types = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["block", "part", "at", "n"])

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own = np.zeros(CONTEXTS * TARGETS, dtype=np.uint32), bare.value
        for batch in batches:
            for text in batch.column("text"):
                np.add.at(total, own.cells(own.indexes(tokens_of(text.as_py()))), np.uint32(1))
        part = TaskContext.get().partitionId()
        yield rows((b, part, total[b * CELLS_A_BLOCK : (b + 1) * CELLS_A_BLOCK]) for b in range(NEAR))

    def added(group: pa.Table) -> pa.Table:
        grow, total = zstandard.ZstdDecompressor().decompress, np.zeros(CELLS_A_BLOCK, dtype=np.int64)
        for at, n in zip(group.column("at"), group.column("n"), strict=True):
            total[np.frombuffer(grow(at.as_py()), "<u4")] += np.frombuffer(grow(n.as_py()), "<i8")
        return pa.Table.from_batches([rows([(group.column("block")[0].as_py(), group.column("part")[0].as_py(), total)])])

    found = checkpointed(docs.select("text").mapInArrow(local, schema))
    while found.agg(F.max("part")).first()[0]:
        found = found.withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        found = checkpointed(found.groupBy("block", "part").applyInArrow(added, schema))
    return found


def train(docs: DataFrame, held: int = HELD) -> Network:
    """Trains on all of ``docs(text)``.

    Every token of the corpus is a target once, with its whole window: tasks count how often each class
    occurs in each context, a table as large as ``CONTEXTS * TARGETS`` whatever the corpus's size, and
    the network is fitted to these counts. So the weights don't depend on partitions or their order.
    Null and empty texts add nothing; an empty table gives a network of even chances.
    """
    network = _vocabulary(_word_counts(docs), held)
    grow, counts = zstandard.ZstdDecompressor().decompress, np.zeros((NEAR, CELLS_A_BLOCK), dtype=np.int64)
    for r in _statistics(docs, network).collect():
        counts[r.block, np.frombuffer(grow(bytes(r.at)), "<u4")] = np.frombuffer(grow(bytes(r.n)), "<i8")
    counts = counts.reshape(CONTEXTS, TARGETS)
    context = np.flatnonzero(counts.any(axis=1))
    params = fit(context, counts[context]) if len(context) else tuple(initial(counts.sum(axis=0)))
    return replace(network, params=params)


def _key(text: str) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
    return int.from_bytes(digest[:8], signed=True), int.from_bytes(digest[8:], signed=True)


def score(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` with ``n_tokens``, ``log_likelihood`` (the sum over all tokens) and ``per_token``.

    A token's likelihood is that of its class by the network, times its word's share of
    the class's tokens. Tasks hold the shares of the most frequent words; those of
    the others are joined, by word, and summed for each text. Null and empty texts have no
    tokens, 0.0 and a null ``per_token``. Whole texts count. Input columns of these names are replaced.
    """
    assert network.counts is not None
    shared = docs.sparkSession.sparkContext.broadcast(replace(network, counts=None))

    def rare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                tokens = tokens_of(text.as_py())
                found = Counter(tokens[i] for i in np.flatnonzero(model.indexes(tokens) < 0).tolist())
                if found:
                    key = _key(text.as_py())
                    rows.extend((*key, word, n) for word, n in found.items())
            arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["_k1", "_k2", "word", "times"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n, total, keys, others = [], [], [], []
            for text in batch.column("text"):
                indexes = model.indexes(tokens_of(text.as_py()))
                n.append(len(indexes))
                total.append(model.log_likelihood(indexes))
                keys.append(_key(text.as_py() or ""))
                others.append(int((indexes < 0).sum()))
            arrays = [pa.array(n, pa.int64()), pa.array(total, pa.float64()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), pa.array(others, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "n_tokens", "log_likelihood", "_k1", "_k2", "_others"])

    of_class = F.element_at(F.array(*(F.lit(t).cast("long") for t in network.tokens)), (_form(F.col("word")) + 1).cast("int"))
    rated = docs.select("text").mapInArrow(rare, "_k1 long, _k2 long, word string, times long").join(network.counts, "word", "left")
    rate = F.log(F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)) / (of_class + 1))
    sums = rated.groupBy("_k1", "_k2").agg(F.sum(F.col("times") * rate).alias("_sum"), F.sum("times").alias("_times"))

    kept = docs.drop("n_tokens", "log_likelihood", "per_token")
    longs = [T.StructField(c, T.LongType()) for c in ("_k1", "_k2", "_others")]
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("log_likelihood", T.DoubleType()), *longs]
    scored = kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields])).join(sums, ["_k1", "_k2"], "left")
    # equal texts meet in one sum, so each takes its own tokens' part
    more = F.coalesce(F.col("_sum") * F.col("_others") / F.col("_times"), F.lit(0.0))
    scored = scored.select(*kept.columns, "n_tokens", (F.col("log_likelihood") + more).alias("log_likelihood"))
    return scored.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def op1_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a network trained on all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs)).drop("text")

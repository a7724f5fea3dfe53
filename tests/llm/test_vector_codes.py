"""Vector codes and whitening against plain versions and SQL, on ties, repeated rows, nulls and several lengths."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from roadloom import llm
from roadloom.llm import vector_codes, whitening
from roadloom.llm.common import sound_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, v string, code string, near int, x double, error long, n long, component int"


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(12)
    made = [(i, [float(x) for x in np.round(r.normal(0, 0.1, 32), 2)], [None, 1, 2][i % 3]) for i in range(150)]
    made += [(i, [0.25] * 32, 7) for i in range(150, 170)] + [(9, made[9][1], 1), (9, made[10][1], 1), (None, made[3][1], None), (None, None, 2)]
    made += [(200, None, 1), (201, [float("nan")] * 32, 1), (202, [None] + [0.0] * 31, 1), (203, [float("inf")] * 32, 1), (-5, [-0.3] * 32, 1)]
    made += [(300 + i, [float(x) for x in np.round(r.normal(0, 1, 20), 3)], 3) for i in range(5)]
    return [(*x, "v", "c", 1, 0.5, 2, 3, 4) for x in made]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/embeddings.parquet")
    return at


def sound(rows):
    kept = [x for x in rows if x[1] is not None and all(c is not None and np.isfinite(c) for c in x[1])]
    return [(i, np.array(np.float32(v), dtype=np.float64), label) for i, v, label, *_ in kept]


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Every entry against every part, in whole numbers."""
    out = []
    for width in sorted({len(v) for _, v, _ in rows}):
        own = [(i, [int(np.floor(256 * c)) for c in v], label) for i, v, label in rows if len(v) == width]
        own.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        cuts = [(p * width // parts, (p + 1) * width // parts) for p in range(parts)]
        books = [[x[1][a:b] for x in own[:entries]] for a, b in cuts]
        for step in range(rounds + 1):
            near = [[min((sum((c - e) ** 2 for c, e in zip(v[a:b], entry, strict=True)), k) for k, entry in enumerate(books[p])) for p, (a, b) in enumerate(cuts)] for _, v, _ in own]
            if step == rounds:
                break
            for p, (a, b) in enumerate(cuts):
                for k in range(len(books[p])):
                    mine = [x[1][a:b] for x, n in zip(own, near, strict=True) if n[p][1] == k]
                    if mine:
                        books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
        out += [(x[0], "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), x[2], digest) for x, n in zip(own, near, strict=True)]
    of = {}
    for x in out:
        of[x[3]] = of.get(x[3], 0) + x[2]
    return [(i, code, error, of[label], digest) for i, code, error, label, digest in out]


def ordered(rows):
    return sorted(rows, key=lambda x: tuple((c is None, c if c is not None else 0) for c in x))


def test_codes_are_the_plain_rounds(spark, folder, rows):
    got = llm.queries()["op12_yinyang_codes"](spark, folder)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = ordered(map(tuple, got.collect()))
    assert got == ordered(plain_codes(sound(rows)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    assert got == ordered(con.execute(vector_codes.ORACLE).fetchall())


def test_bounds_spare_groups_and_lose_no_entry():
    """Rounds of moving entries: the assignment is always that of all distances, and most groups of clustered points aren't scanned."""
    r = np.random.default_rng(3)
    centres = r.integers(-900, 900, (40, 4))
    x = centres[r.integers(0, 40, 3000)] + r.integers(-6, 7, (3000, 4))
    x[:40] = x[40:80] = centres
    entries = centres.copy()
    group = vector_codes.grouped(entries)
    code, near = np.zeros(len(x), np.int64), np.full((len(x), group.max() + 1), -1.0)
    looked = []
    for _ in range(5):
        code, d, near, scanned = vector_codes.assigned(x, entries, group, code, near)
        full = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (code == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
        others = np.sqrt(np.where(np.arange(40)[None] == code[:, None], np.inf, full))
        assert all((near[:, g] <= others[:, group == g].min(axis=1) + 1e-9).all() for g in range(group.max() + 1))
        looked.append(scanned.mean())
        moved = entries + r.integers(-8, 9, entries.shape)
        near = near - vector_codes._drift(entries, moved, group)
        entries = moved
    assert looked[0] == 40 and max(looked[1:]) < 20


def test_heavy_and_light_labels_give_the_same_sums(spark):
    rows = spark.range(400).select(F.when(F.col("id") % 5 > 0, F.col("id") % 50).alias("label"), F.col("id").alias("error"))
    want = {}
    for label, error in rows.collect():
        want[label] = want.get(label, 0) + error
    for heavy in (0.0, 0.05, 1.0):
        got = vector_codes.with_label_error(rows, heavy).collect()
        assert len(got) == 400 and all(r.label_error == want[r.label] for r in got)


def test_too_large_components_raise(spark):
    big = spark.createDataFrame([(1, [2.0**20] * 16, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="beyond"):
        vector_codes.coded(big, 16)


def plain_whitening(v, components=32):
    x = np.floor(64 * v) + 1_000_000
    c = x - x.mean(axis=0)
    e, u = np.linalg.eigh(c.T @ c / len(c))
    e, u = e[::-1], u[:, ::-1]
    k = min(components, x.shape[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        return x.astype(np.int64), e[:k] / e.sum(), c @ u[:, :k] / np.sqrt(e[:k])


def test_whitening_is_numpys(spark, folder, rows):
    got = llm.queries()["op13_whitening"](spark, folder).toPandas()
    kept = sound(rows)
    assert len(got) == sum(min(32, len(v)) for _, v, _ in kept)
    for width in (32, 20):
        own = [(i, v) for i, v, _ in kept if len(v) == width]
        part = got[got["n"] == len(own)]
        assert len(part) == len(own) * width and (part["identity_error"] < 1e-9).all() or width == 20
        x, shares, y = plain_whitening(np.array([v for _, v in own]))
        far = ((len(own) * x - x.sum(axis=0)) ** 2).sum(axis=1)
        assert sorted(part[part["component"] == 1]["deviation"]) == sorted(far.tolist())
        if width == 20:  # five rows have a variance in four directions only
            assert (part[part["component"] > 4]["whitened"] == 0).all() and part["identity_error"].max() < 1e-9
            continue
        seen = part.groupby("component")["explained"].first().to_numpy()
        assert np.allclose(seen, shares, rtol=1e-9)
        of = {(i, int(d)): y[k] for k, ((i, _), d) in enumerate(zip(own, far, strict=True))}
        for (i, d), rows_ in part[part["vec_id"].notna()].groupby(["vec_id", "deviation"]):
            want = of[(int(i), int(d))]
            first = rows_.sort_values("component").drop_duplicates("component")["whitened"].to_numpy()
            assert np.allclose(np.abs(first), np.abs(want), atol=1e-8)


def _table(spark, v):
    return spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")


def test_a_narrow_range_is_enough_where_variance_is(spark):
    """Three strong directions among forty: no residual fails. With as much in all of them, the range is widened."""
    r = np.random.default_rng(8)
    strong = np.round(r.normal(0, 40, (300, 3))) @ np.round(r.normal(0, 3, (3, 40)))
    for v, widened in ((strong, False), (np.round(r.normal(0, 40, (300, 40))), True)):
        rows = whitening.integer_entries(_table(spark, v))
        fit = whitening.fit_whitening(rows, 40, components=3, oversample=4)
        _, shares, _ = plain_whitening(v, 3)
        assert fit.widened == widened
        assert np.allclose(fit.eigenvalues / fit.trace, shares, rtol=1e-10)
        assert whitening.identity_error(rows, 40, fit) < 1e-9


def test_whitening_without_variance(spark):
    rows = whitening.integer_entries(_table(spark, np.ones((6, 4))))
    fit = whitening.fit_whitening(rows, 4)
    got = whitening.whitened(rows, 4, fit).collect()
    assert len(got) == 24 and all(r.whitened == 0 and r.deviation == 0 and r.n == 6 for r in got)
    assert whitening.identity_error(rows, 4, fit) == 0


def test_whitening_of_large_entries(spark):
    """Deviations that a long doesn't hold are null; sums stay whole."""
    v = np.zeros((4, 2))
    v[0] = (2.0**26, 3)
    v[1] = (-(2.0**25), 5)
    rows = whitening.integer_entries(_table(spark, v))
    fit = whitening.fit_whitening(rows, 2)
    got = {r.vec_id: r.deviation for r in whitening.whitened(rows, 2, fit).where("component = 1").collect()}
    x = [[int(64 * c) + 1_000_000 for c in row] for row in v.tolist()]
    want = {i: sum((4 * a - sum(c)) ** 2 for a, c in zip(row, zip(*x, strict=True), strict=True)) for i, row in enumerate(x)}
    assert got == {i: d if d < 2**63 else None for i, d in want.items()} and None in got.values()


def test_empty_vectors_and_tables(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int"
    for name, rows in (("none", []), ("empty", [(1, [], 4), (2, [], None)]), ("null", [(1, None, 4)])):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "embeddings.parquet"))
    codes = {n: sorted(map(tuple, llm.queries()["op12_yinyang_codes"](spark, str(tmp_path / n)).select("vec_id", "code", "error", "label_error").collect())) for n in ("none", "empty", "null")}
    assert codes == {"none": [], "null": [], "empty": [(1, "00" * 16, 0, 0), (2, "00" * 16, 0, 0)]}
    assert all(llm.queries()["op13_whitening"](spark, str(tmp_path / n)).count() == 0 for n in codes)
    assert sound_vectors(spark.read.parquet(str(tmp_path / "null" / "embeddings.parquet"))).count() == 0

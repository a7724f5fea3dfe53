"""Personal data against plain expressions, SQL and planted cases."""

import hashlib
import random
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from roadloom import llm
from roadloom.llm import personal_data
from roadloom.llm.personal_data import spans_of

BITS = ["a@b.c", "@", "+1 (555) 010-4477 ", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "1.2.3.4", "256.1.1.1", ".", "..1.2.3.4.5", "http://a.b/x,", "HTTPS://ex.org:80/q?x=1). ", 'token = "abc123def"', "Account no: 00-11-22", "iban DE89 3704 0044 0532 0130 00", "IBAN: GB82WEST12345698765432", "account account number 123456", "é", "中", " ", "-", "5", "secret 12", " user id#x_9-8-7", "+", "++12(3)4 5678901", "a.b+c@d.e-f@g.h.", "<", '"', "0000001.2.3.4", "token=token1 : 999999x", "\n", "\t", "@@", "0", "1", "9" * 30]


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    """The contract's expressions, over the whole text."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [(kind, *m.span()) for kind, pattern, holds in rules for m in re.finditer(pattern, text) if holds(m.group())]


def base(text):
    return [s for s in spans_of(text) if s[0] in personal_data.BASE]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=25).map("".join) | st.text("+@.0123 -()ab", max_size=60))
def test_base_spans_are_the_expressions(text):
    assert base(text) == plain(text)


def test_what_the_method_adds():
    text = 'See https://shop.example.org/a?b=1). Account no: DE-44-120, token = "9c8b45435718", IBAN DE89 3704 0044 0532 0130 00, iban DE88 3704 0044 0532 0130 00; mytoken = "abc123def", secret plans'
    found = [(k, text[a:b]) for k, a, b in spans_of(text) if k in ("url", "account")]
    assert found == [("url", "https://shop.example.org/a?b=1"), ("account", "DE-44-120"), ("account", "9c8b45435718"), ("account", "DE89 3704 0044 0532 0130 00")]
    assert personal_data.redact("é mail a.b@c.de, or +1 (555) 010-4477 or 10.0.0.1") == "é mail <email>, or <phone> or <ip>"


def test_long_runs_take_linear_time():
    for text in ("9" * 300_000, "1." * 300_000, "+1" + " " * 300_000, "a@" * 200_000, "a" * 500_000 + "@", "1-" * 300_000, "token=" * 60_000, "http://" * 60_000):
        assert base(text) == plain(text) if len(text) < 4000 else spans_of(text) is not None


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    rows = [(None, "x@y.z"), (0, None), (1, ""), (2, " "), (3, "x@y.z"), (3, "x@y.z"), (4, " ".join(r.choices(BITS, k=60_000)))]
    rows += [(10 + i, "".join(r.choice(BITS) for _ in range(r.randrange(1, 25)))) for i in range(800)]
    at = str(tmp_path_factory.mktemp("personal"))
    spark.createDataFrame([(*x, 1, "p", "s") for x in rows], "doc_id long, text string, n_email int, personal_data string, spans string").repartition(4).write.parquet(f"{at}/documents.parquet")
    return at, rows


def _ordered(rows):
    return sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[-1]))


def test_query_on_awkward_rows(spark, folder):
    at, rows = folder
    got = _ordered(map(tuple, llm.queries()["op11_personal_data"](spark, at).collect()))
    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    want = [(i, *(sum(s[0] == k for s in plain(t or "")) for k in personal_data.BASE), hashlib.sha256(joined(plain(t or "")).encode()).hexdigest(), joined(spans_of(t or ""))) for i, t in rows]
    assert got == _ordered(want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
    assert got == _ordered(con.execute(personal_data.ORACLE).fetchall())


def test_redacted_texts_and_clashing_columns(spark, folder):
    docs = spark.createDataFrame([(1, "mail a@b.cd", "old"), (2, None, "old")], "doc_id long, text string, redacted string")
    assert {r.doc_id: r.redacted for r in personal_data.redacted(docs).collect()} == {1: "mail <email>", 2: None}
    spans = personal_data.find_personal_data(docs.withColumnRenamed("redacted", "personal_data")).collect()
    assert {r.doc_id: [tuple(s) for s in r.personal_data] for r in spans} == {1: [("email", 5, 11)], 2: []}

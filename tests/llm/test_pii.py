import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from acreline.llm import pii


def one(spark, text, key="k"):
    return pii.pseudonymize(spark.createDataFrame([(text,)], "text string"), key).first()


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10


def test_formats_and_links_are_kept(spark):
    a = one(spark, "card 4720843956327690, again 4720-8439-5632-7690; bad 4720843956327691")
    first, again, bad = re.findall(r"[\d\-]{16,}", a["text"])
    assert first == again.replace("-", "") != "4720843956327690" and luhn(first) == 0
    assert bad == "4720843956327691" and a["n_number"] == 2
    b = one(spark, "call 4720 8439 5632 7690")
    assert first in b["text"].replace(" ", "")
    assert one(spark, "4720843956327690", key="other")["text"] != first


@pytest.mark.parametrize(("text", "kind", "shape"), [
    ("see und.34@mail7.example.com.", "email", r"see [a-z]{3}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com\."),
    ('token = "58ed55e8cc700f5a0109593b09891d0a1a8ca26f"', "secret", r'token = "[0-9a-f]{40}"'),
    ("at 64.147.79.24.", "ip", r"at \d{1,3}(\.\d{1,3}){3}\."),
    ("+1 (640) 555-0953!", "phone", r"\+1 \(\d{3}\) \d{3}-\d{4}!"),
    ("no 123-45-6789 x", "ssn", r"no \d{3}-\d{2}-\d{4} x"),
    ("on 1987-02-28, ", "date", r"on \d{4}-\d\d-\d\d, "),
])
def test_each_kind(spark, text, kind, shape):
    got = one(spark, text)
    assert got["text"] != text and re.fullmatch(shape, got["text"])
    assert got["n_replaced"] == got[f"n_{kind}"] == 1
    if kind == "ip":
        assert all(int(x) < 256 for x in re.findall(r"\d+", got["text"]))


@pytest.mark.parametrize("text", ["2020-02-30", "13/32/2000", "999.1.1.1", "1.2.3.4.5", "v 12345 6", "a @ b", ""])
def test_what_is_not_valid_is_left(spark, text):
    got = one(spark, text)
    assert got["text"] == text and got["n_replaced"] == 0


def test_dates_are_permuted_one_to_one(spark):
    days = spark.range(0, 3000).select(F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int"))
                                        .cast("string").alias("text"))
    got = [r["text"] for r in pii.pseudonymize(days, "k", counts=False).collect()]
    assert len(set(got)) == 3000 and all(1800 <= dt.date.fromisoformat(x).year < 2200 for x in got)


@pytest.mark.parametrize("pattern", ["dd/MM/yyyy", "MM/dd/yyyy", "both"])
def test_slash_dates_are_permuted_one_to_one(spark, pattern):
    days = spark.range(0, 12_000).select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    texts = [F.date_format("d", p) for p in (("dd/MM/yyyy", "MM/dd/yyyy") if pattern == "both" else (pattern,))]
    table = days.select(F.explode(F.array(*texts)).alias("text")).distinct()
    got = [r["text"] for r in pii.pseudonymize(table, "k", counts=False).collect()]
    assert len(set(got)) == len(got) == table.count()
    for x in got:
        a, b, y = map(int, x.split("/"))
        dt.date(y, *((b, a) if b <= 12 else (a, b)))  # a date in one of the notations
        assert 1800 <= y < 2200


def test_dates_at_the_ends_of_the_calendar_keep_four_digits(spark):
    for text in ("0001-01-01", "0150-05-05", "9999-12-31", "12/31/9999", "01/31/0100"):
        assert one(spark, text)["text"] == text
    for text in ("0200-01-01", "9799-12-31", "12/31/9799", "02/29/0400"):
        got = one(spark, text)["text"]
        assert got != text and len(got) == 10


def test_a_text_with_very_many_values(spark):
    """The costly case: tens of thousands of values in one text, against the values one by one."""
    cards = [f"411111111111{i:04}" for i in range(10_000)]
    text = " x ".join(cards)
    got = one(spark, text)
    valid = sum(luhn(c) == 0 for c in cards)
    assert got["n_replaced"] == got["n_number"] == valid
    new = got["text"].split(" x ")
    assert len(new) == len(cards) and all((a == b) == (luhn(a) != 0) for a, b in zip(cards, new))
    some = [c for c in cards if luhn(c) == 0][:40]
    each = pii.pseudonymize(spark.createDataFrame([(c,) for c in some], "text string"), "k", counts=False).collect()
    assert [r["text"] for r in each] == [new[cards.index(c)] for c in some]


def test_integers_and_texts_are_permuted_one_to_one(spark):
    n = spark.range(0, 21 * 13)
    assert sorted(r[0] for r in n.select(pii.permuted_int(F.col("id"), 21, 13, "k")).collect()) == list(range(273))
    digits = n.limit(100).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("t"))
    assert len({r[0] for r in digits.select(pii.permuted_text(F.col("t"), "k")).collect()}) == 100


def test_whole_table_keeps_clean_rows_and_order_of_columns(documents):
    done = pii.pseudonymize(documents, "k")
    assert done.columns[:5] == documents.columns
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    both = done.join(documents.select("doc_id", F.col("text").alias("before")), "doc_id").collect()
    assert len(both) == documents.count()
    found = re.compile(pii.ANY)
    for r in both:
        assert (r["text"] == r["before"]) == (r["n_replaced"] == 0)
        assert found.split(r["before"]) == found.split(r["text"]) or r["n_replaced"]


def test_awkward_rows(awkward, nothing):
    rows = pii.pseudonymize(awkward, "k").collect()
    assert len(rows) == awkward.count() and rows[0]["text"] is None and rows[0]["n_replaced"] == 0
    assert rows[6]["text"] == rows[7]["text"] == rows[9]["text"] != "mail a.b@mail.example.com now"
    assert rows[5]["n_replaced"] == 50
    assert pii.pseudonymize(nothing, "k").count() == 0

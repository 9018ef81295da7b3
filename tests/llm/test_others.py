"""Pseudonyms, the quality classifier, top-k search, the pipeline, and the queries that have check SQL."""
import datetime
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terratally.llm import pii, quality, queries, topk
from tools.check import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


def new(text):
    return pii.pseudonymised(text)[0]


def test_formats_and_links():
    card = new("card 4111-1111-1111-1111!")
    assert re.fullmatch(r"card \d{4}-\d{4}-\d{4}-\d{4}!", card) and card != "card 4111-1111-1111-1111!"
    digits = re.sub(r"\D", "", card)
    assert pii.luhn(digits) % 10 == 0 and re.sub(r"\D", "", new("4111111111111111")) == digits
    iban = new("DE89 3704 0044 0532 0130 00")
    assert re.fullmatch(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", iban) and pii.iban_number(iban.replace(" ", "")) % 97 == 1
    assert re.fullmatch(r"at [a-z]{4}\.\d\d@mail7\.example\.com, ok", new("at anna.34@mail7.example.com, ok"))
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} \d+\.\d+\.\d+\.\d+", new("+1 (826) 555-4081 190.137.223.204"))
    assert re.fullmatch(r"\d{3}-\d\d-\d{4}", new("123-45-6789")) and new("123-45-6789") != "123-45-6789"
    day = new("born 1980-02-29.")
    assert datetime.date.fromisoformat(day[5:15]) and day[15:] == "." and day != "born 1980-02-29."
    a, b = new("29.02.1980"), new("1980-02-29")
    assert datetime.datetime.strptime(a, "%d.%m.%Y").date() == datetime.date.fromisoformat(b)


def test_invalid_values_stay():
    for text in ("4111111111111112", "300.1.1.1", "2023-02-30", "000-12-3456", "DE00 3704 0044 0532 0130 00", "v1.2.3", "@", "a@b", "12345", "3.14", "", "no digits"):
        assert new(text) == text


@pytest.mark.parametrize("after", [" BIC COBADEFF", " BIC COBADEFFXXX", " 2024", " I", " 2024-01-05", " FR14 2004 1010 0505 0001 3M02 606", " MAX@mail.org", ". DE", ""])
@pytest.mark.parametrize("value", ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "NO93 8601 1117 947"])
def test_text_after_an_iban(value, after):
    text, found = pii.pseudonymised(f"IBAN {value}{after}")
    assert found["iban"] == 1 + ("FR14" in after) and text[5:5 + len(value)] == new(value) != value
    if "@" not in after and "-" not in after and "FR14" not in after:
        assert text[5 + len(value):] == after
    # a country without a registered length
    ends = pii.pseudonymised("ZZ" + str(98 - pii.iban_number("ZZ00" + "1" * 14) % 97).zfill(2) + "1" * 14 + " PLEASE")[0]
    assert ends.endswith(" PLEASE") and "1" * 14 not in ends


def test_date_before_a_time():
    day = new("1980-02-29")
    for after in ("T10:00:00", "T10:00:00Z", "t1000+01:00", "T10:00:00.5 x"):
        assert pii.pseudonymised("at 1980-02-29" + after) == (f"at {day}{after}", {"date": 1})
    assert new("1980-02-29Time") == "1980-02-29Time" and new("1980-02-30T10:00:00") == "1980-02-30T10:00:00"


def test_pseudonyms_are_one_to_one():
    ips = {new(f"10.0.{k // 256}.{k % 256}") for k in range(3000)}
    dates = {new((pii.FIRST_DAY + datetime.timedelta(k)).isoformat()) for k in range(0, 73049, 31)}
    assert len(ips) == 3000 and len(dates) == len(range(0, 73049, 31))


def test_month_first_dates_stay_month_first():
    for k in range(13, 29):
        assert int(new(f"01/{k}/1999").split("/")[1]) > 12


def test_pii_links_by_value():
    """One value, however written, has one pseudonym; every telephone number and every day has its own."""
    def digits(text):
        return re.sub(r"\D", "", new(text))

    for forms in (["+1 555 123 4567", "+15551234567", "+1-555-123-4567", "+1 (555) 123-4567"], ["+44 20 7946 0958", "+442079460958"], ["+420 601 234 567", "+420601234567"]):
        assert len({digits(f) for f in forms}) == 1 and digits(forms[0]) != re.sub(r"\D", "", forms[0])
    assert digits("+1 555 123 4567")[1:] == digits("(555) 123-4567")
    days, months_first = set(), set()
    for k in range(73049):
        d = pii.FIRST_DAY + datetime.timedelta(k)
        y, m, day = map(int, new(d.isoformat()).split("-"))
        days.add((y, m, day))
        assert (day > 12) == (d.day > 12) and (y, m, day) != (d.year, d.month, d.day)
        if k % 97 == 0:
            assert new(f"{d.day:02d}/{d.month:02d}/{d.year}") == f"{day:02d}/{m:02d}/{y}" and new(f"{d.day}.{d.month}.{d.year}") == f"{day:02d}.{m:02d}.{y}"
            if d.day > 12:
                assert new(f"{d.month:02d}/{d.day:02d}/{d.year}") == f"{m:02d}/{day:02d}/{y}"
    assert len(days) == 73049


def test_pii_with_a_clashing_name(make):
    docs = make([(1, "call +1 555 123 4567"), (2, None)]).selectExpr("*", "'x' AS new", "'y' AS _new")
    rows = {r.doc_id: r for r in pii.pseudonymise(docs).collect()}
    assert rows[1].new == "x" and rows[1]._new == "y" and rows[1].n_phone == 1 and rows[2].text is None


def test_pii_table(make, awkward):
    rows = awkward + [(500, "mail a.b@c.org"), (501, "1.2.3.4 and 1.2.3.4")]
    got = {r.doc_id: r for r in pii.pseudonymise(make(rows)).collect()}
    assert len(got) == len(rows) and got[1].text is None and got[500].n_email == 1 and got[501].n_ip == 2
    x, y = got[501].text.split(" and ")
    assert x == y != "1.2.3.4" and got[501].bucket == "clash"
    assert all(got[i].text == t for i, t in awkward if t is None or not re.search(r"[0-9@]", t))
    assert pii.pseudonymise(make([])).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_quality_ignores_the_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.classify(docs, x).collect()} for x in (labels, flipped))
    assert all(math.isclose(a[k], b[k], rel_tol=1e-6, abs_tol=1e-9) for k in a)


def test_quality_edges(spark, make, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.classify(make([*awkward, (None, "x")]), none).collect()
    assert len(rows) == len(awkward) + 1 and {r.score for r in rows} == {0.5}
    one = spark.createDataFrame([(k, q, None) for k, q in ((0, 1), (2, 1), (3, None), (4, 7))], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.5 for r in quality.classify(make(awkward), one).collect())
    assert quality.classify(make([]), one).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string, part string")


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART", 40)
    monkeypatch.setattr(topk, "BLOCK", 8)
    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rnd.normal(size=6).astype(np.float32)], None, "s", "p") for i in range(200)]
    rows += [(200 + i, rows[3][1], None, "s", "p") for i in range(20)]  # ties
    rows += [(400, None, None, None, None), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0], None, None, None), (402, [float("nan")] * 6, None, None, None), (403, [float("inf")] * 6, None, None, None), (None, rows[0][1], None, None, None), (450, [1.0], None, None, None)]
    got = {}
    for r in topk.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, np.floor(np.array(v, np.float32).astype(float) * 256)) for i, v, *_ in rows if i is not None and i < 300]
    for i, q in good:
        if i % 50 == 0:
            best = sorted(((-int(q @ v), j) for j, v in good if j != i))[:5]
            assert sorted(got.pop(i)) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert not got  # 400 and 450 have no candidates


def test_top_k_few_and_large(spark):
    rows = [(0, [3e38, 1.0], 1, "", ""), (1, [3e38, 0.5], 1, "", "")]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 2**63 - 1)]
    assert topk.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("name", list(queries.SQL))
def test_check_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == sql_rows(connect(SF), queries.SQL[name])


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    from tests.llm.test_dedup import exact_by_hand, near_by_hand
    scores = {r.doc_id: r.predicted for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    expected = {i: t for i, t in before.items() if scores[i]}
    expected = {i: expected[i] for i, *_, kept, _ in exact_by_hand(list(expected.items())) if kept}
    classes = near_by_hand(list(expected.items()))
    expected = {i: new(t) for i, t in expected.items() if classes[i][1] == i}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns, name
    rows = now.collect()
    assert {r.doc_id: r.text for r in rows} == expected and all(r.n_chars == len(r.text) for r in rows if r.text != before[r.doc_id])
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == set(expected)


def test_pipeline_pieces(spark):
    """The pieces of the last stage, with their places, lengths and ids, on the texts that brute force expects."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tests.llm.test_dedup import exact_by_hand, near_by_hand
    from tests.llm.test_tokens import check_pieces
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    texts = {i: texts[i] for i, *_, kept, _ in exact_by_hand(list(texts.items())) if kept}
    classes = near_by_hand(list(texts.items()))
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.encode_special_tokens = True
    ids = {i: encoder.encode(new(t), add_special_tokens=False).ids + [1] for i, t in texts.items() if classes[i][1] == i}
    check_pieces(corpus_pipeline.run(spark, SF).collect(), ids, 2048)

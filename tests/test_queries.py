"""Every registered query with an oracle, on the smallest tables; the others run and give rows."""

import hashlib
import re
import unicodedata
from collections import Counter

import pytest
from oracle import DATA, assert_same, connect

from fixtura.functions import text
from fixtura.plans import catalogue, link_plans

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    assert_same(QUERIES[name](spark, DATA), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"PIPE-02"}))
def test_runs(spark, name):
    rows = QUERIES[name](spark, DATA)
    assert len(set(rows.columns)) == len(rows.columns)
    rows.collect()


def test_scoreline_prefixes_are_cut_from_real_arrays(spark):
    rows = QUERIES["ARR-03"](spark, DATA).collect()
    assert rows and {r.n for r in rows} == {0, 1, 2, 3}
    assert all(r.n == r.k % 4 == len(r.lines.split(",") if r.lines else ()) for r in rows)


def test_late_rows_of_every_order_are_reported(spark):
    rows = QUERIES["VAL-02"](spark, DATA).collect()
    assert {r.l_orderkey % 50 for r in rows} == {r.o_orderkey % 50 for r in spark.read.parquet(f"{DATA}/orders.parquet").collect()}


def whole_keys(name):
    """(plain, folded) by plain Python."""
    if name is None:
        return None, None
    plain = "".join(dict(zip(text.ACCENTED, text.PLAIN, strict=True)).get(c, c) for c in name).lower()
    folded = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).casefold()
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", plain.strip(" ")), " ".join(folded.split())


def hashed(key):
    return None if key is None else hashlib.sha256(key.encode()).hexdigest()


def test_whole_texts_of_every_language_are_normalised(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "text").collect()
    got = QUERIES["STR-02"](spark, DATA).collect()
    assert Counter(map(tuple, got)) == Counter((r.doc_id, r.lang, *map(hashed, whole_keys(r.text))) for r in docs)


def test_accents_past_the_first_letter_and_outside_latin_are_folded(spark):
    texts = ["Real  São\tTomé", "Ko\u0301benhavn ", "STRASSE Straße", "Ünï\u2003CÔTE d’Ivoire", "Ελλάδα ΌΧΙ", "\ufb01n Ⅳ", "Ёлка", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "'xx' AS lang", "text")
    got = {r.doc_id: r.folded for r in link_plans.whole_text_keys(lambda name: rows).collect()}
    keys = ["real sao tome", "kobenhavn", "strasse strasse", "uni cote d’ivoire", "ελλαδα οχι", "fin iv", "елка", "", None]
    assert got == {k: hashed(key) for k, key in enumerate(keys)}


def test_flagship_has_rows(spark):
    assert catalogue.flagship(spark, DATA).limit(1).count() == 1

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from cohortline import functions as fn


def test_ids_and_blanks(column):
    values = [None, "", "\t\t", "　", "　 Ab　", "Ünï  Code"]
    assert column(values, fn.normalize_id) == [None, None, None, None, "ab", "ünï  code"]
    assert column(values, fn.is_blank) == [True, True, True, True, False, False]
    assert column(values, fn.normalize_text) == [None, None, None, None, "ab", "ünï code"]
    assert column([None, "", " "], fn.fill_unknown) == ["UNKNOWN", "UNKNOWN", " "]


def test_keys_need_every_part(column):
    assert column(["A b", " ", None], lambda c: fn.org_key(c, F.lit("X　 y"))) == ["a b|x y", None, None]
    assert column([" ", "v"], lambda c: fn.first_non_blank(c, F.lit(" w "))) == ["w", "v"]


def test_numbers(column):
    values = ["12", "1,234", " 5 ", "1e3", "1d", "NaN", "abc", "", None, "-.5", "+7.", "Infinity", "1,2,3.5", "0x10"]
    want = [12.0, 1234.0, 5.0, 1000.0, None, None, None, None, None, -0.5, 7.0, None, 123.5, None]
    assert column(values, fn.to_double) == want


def test_typed_numbers_skip_the_parser(table):
    df = table([(1, "2")], "a int, b string")
    assert df.select(fn.number_of(df, "a"), fn.number_of(df, "b")).first() == (1.0, 2.0)


def test_dates(column):
    values = ["20200901", "20201332", "44075", "202009", "2020-9-1", "2020/9/1 10:20", "9/1/2020", "2020-9", "text", " ", None, "44075.75"]
    day = date(2020, 9, 1)
    want = [day, None, day, day, day, day, day, day, None, None, None, day]
    assert column(values, fn.to_date_flexible) == want
    assert column(["202009"], lambda c: fn.to_date_flexible(c, strict_serial=True)) == [date(1899, 12, 30) + timedelta(days=202009)]
    assert column(["99999999999"], fn.to_date_flexible) == [None]
    assert column([" ", "x"], lambda c: fn.coalesce_dates(c, F.lit(""), F.lit("20200901"))) == [day, day]


@pytest.mark.parametrize(
    ("day", "year", "semester"),
    [
        ("2020-12-31", "2020-2021", "1"),
        ("2021-01-01", "2020-2021", "1"),
        ("2021-01-31", "2020-2021", "1"),
        ("2021-02-01", "2020-2021", "2"),
        ("2021-07-31", "2020-2021", "2"),
        ("2021-08-01", "2021-2022", "1"),
        ("2021-08-31", "2021-2022", "1"),
        ("2021-09-30", "2021-2022", "1"),
    ],
)
def test_term_of_date(column, day, year, semester):
    assert column([day], lambda c: fn.term_of_date(c.cast("date"))) == [(year, semester)]


def test_terms_of_every_month_and_missing(column):
    months = [f"2020-{m:02d}-15" for m in range(1, 13)]
    got = column([*months, None], lambda c: fn.term_of_date(c.cast("date")))
    assert [g[1] for g in got[:12]] == ["1"] + ["2"] * 6 + ["1"] * 5
    assert got[12] == (None, None)


def test_plans_and_orders(column):
    values = ["2020-2021-1", " 2020-2021-1", "2020-2021-", "20-21-1", None]
    got = column(values, fn.term_of_plan)
    assert got[0] == ("2020-2021", "1") and all(g == (None, None) for g in got[1:])
    assert column(["2020-2021", "20-21"], lambda c: fn.term_order(c, F.lit("2"))) == [20202, -1]
    assert column(["20-21"], lambda c: fn.term_order(c, F.lit("2"), malformed_as_zero=True)) == [2]
    assert column(["2020", "20", "20200", None], fn.school_year_of) == ["2020-2021", None, None, None]


def test_ratio_pairs(column):
    got = column(["170/60", " 170.5 / 60 ", "170", "170/", None], fn.parse_ratio_pair)
    assert [tuple(g) for g in got] == [(170.0, 60.0), (170.5, 60.0), (None, None), (None, None), (None, None)]


def test_half_even_rounding(column):
    values = [0.12345, 0.12355, 2.00005, -0.12345, -0.00001, None]
    got = column(values, fn.round4, "double")
    assert got == [0.1234, 0.1236, 2.0, -0.1234, 0.0, None]
    assert str(got[4]) == "0.0"


def test_logarithms(column):
    clipped = column([-3.0, 0.0, 1.0, None], fn.log1p_clip, "double")
    assert clipped[:2] == [0.0, 0.0] and clipped[3] is None
    signed = column([-1.0, 0.0, 1.0], fn.signed_log1p, "double")
    assert signed[0] == -signed[2] and signed[1] == 0.0


def test_codes(column, table):
    assert column(["男", "女", "?", None], lambda c: fn.map_code(c, {"男": 0, "女": 1})) == [0, 1, 0, 0]
    assert column(["1", "13", "2", None], lambda c: fn.in_code_set(c, ("1", "3", "11", "13"))) == [True, True, False, False]
    assert column(["2"], lambda c: fn.in_code_set(c, ("1",), F.lit("0"))) == [True]
    assert column(["b", "z"], lambda c: fn.list_position(c, ["a", "b"])) == [1, 999]
    codes = table([(["b", "a"],), ([],), (None,)], "v array<string>").select(fn.join_codes(F.col("v"))).collect()
    assert [r[0] for r in codes] == ["a|b", None, None]
    status = column([0.8, 0.79], lambda c: fn.threshold_status(c, F.lit(1)), "double")
    assert status == ["OK BEST", "WARN BEST"]


def test_vectors(table):
    df = table([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    row = df.select(fn.vec_distance(a, b), fn.l2_normalize(a), fn.cosine(a, a), fn.cosine(a, b), fn.l2_normalize(b)).first()
    assert tuple(row) == (5.0, [0.6, 0.8], 1.0, None, [0.0, 0.0])

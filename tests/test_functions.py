import datetime

import pytest
from pyspark.sql import functions as F

from opsdesk.functions import checks, dates, numbers, text


def one(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", expr.alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("profile, cases", [
    ("agg", {"1,200": 1200.0, "¥3.5": 3.5, "(40)": -40.0, "（４１）": -41.0, "+7": 7.0, "－8": None, "-8": -8.0, "": None, "1e3": None, "12.": None, "abc": None, " 9 ": 9.0}),
    ("csv", {"１，２３４．５０": "1234.50", "(12)": "-12", "$ 7": "7", "-(3)": None, "x": None, "+4.0": "4.0"}),
    ("cents", {"1.005": 100, "12.34": 1234, "(0.5)": -50, "¥1,000.10": 100010, "none": None}),
    ("diff", {"100": 100.0, "100.00": 100.0, "￥1,0": 10.0, "(5)": None, "-2": -2.0}),
    ("invoice", {"(12.5)": -12.5, "￥8": 8.0, "１３": 13.0}),
    ("amount", {"1234.565": 123457, "RMB 12": 1200, "5元": 500, "-0.05": -5, "１２。５": 1250, "1" * 15: None}),
])
def test_numbers(spark, profile, cases):
    assert dict(zip(cases, one(spark, list(cases), numbers.parse_number("v", profile)), strict=True)) == cases


def test_capital_amounts(spark):
    cases = {
        0: "零元整", 100: "壹元整", 1000: "壹拾元整", 50: "零元伍角", 5: "零元零伍分", 203: "贰元零叁分", 230: "贰元叁角", 123456: "壹仟贰佰叁拾肆元伍角陆分", 101_00: "壹佰零壹元整", 10_005_00: "壹万零伍元整", 20_030_00: "贰万零叁拾元整",
        10_700_00: "壹万零柒佰元整", 11_700_00: "壹万壹仟柒佰元整", 100_000_000_00: "壹亿元整", 100_000_020_00: "壹亿零贰拾元整", 300_010_000_00: "叁亿零壹万元整", 4_000_000_000_00: "肆拾亿元整", -5_00: "负伍元整", -40: "负零元肆角", 1_000_100_010_00: "壹拾亿零壹拾万零壹拾元整",
    }
    assert dict(zip(cases, one(spark, list(cases), numbers.capital_amount("v"), "long"), strict=True)) == cases


def test_capital_amounts_beyond_the_whole_numbers_of_a_double(spark):
    cases = {
        9_007_199_254_740_993: "玖拾万亿零柒佰壹拾玖亿玖仟贰佰伍拾肆万柒仟肆佰零玖元玖角叁分", 90_000_000_000_000_099: "玖佰万亿元玖角玖分",
        -99_999_999_999_999_999: "负玖佰玖拾玖万亿玖仟玖佰玖拾玖亿玖仟玖佰玖拾玖万玖仟玖佰玖拾玖元玖角玖分",
    }
    assert dict(zip(cases, one(spark, list(cases), numbers.capital_amount("v"), "long"), strict=True)) == cases


def test_rates_and_cents(spark):
    assert one(spark, ["13%", "13", "0.13", "1", ""], numbers.tax_rate("v")) == [0.13, 0.13, 0.13, 1.0, None]
    assert one(spark, [0, 5, -1234, 100000], numbers.cents_text("v"), "long") == ["0.00", "0.05", "-12.34", "1000.00"]


def test_dates(spark):
    cases = {"2024-2-9": "2024-02-09", "2024/02/29": "2024-02-29", "2023.2.29": None, "2024年3月5日": "2024-03-05", "2026-3/5": "2026-03-05", "20240305": None, " 2024-01-01　": "2024-01-01", "x": None, "": None, "2024-13-01": None}
    assert [x and x.isoformat() for x in one(spark, list(cases), dates.parse_date("v"))] == list(cases.values())
    assert one(spark, ["20240305", "20240231"], dates.parse_date("v", compact=True)) == [datetime.date(2024, 3, 5), None]
    assert one(spark, ["2023-02-29", "2024-02-29", "no"], dates.invalid_date("v")) == [True, False, False]
    assert one(spark, ["23:50"], dates.minutes_between("v", F.lit("00:10"))) == [20]
    assert one(spark, ["00:00:01,5", "01:02.250", "1:00:00.05", "bad"], dates.subtitle_ms("v")) == [1500, 62250, 3600050, None]
    assert one(spark, [3_661_045], dates.subtitle_time("v", "srt"), "long") == ["01:01:01,045"]
    assert one(spark, [3_661_045], dates.subtitle_time("v", "ass"), "long") == ["1:01:01.04"]


def luhn(digits):
    return digits + next(str(c) for c in range(10) if sum(int(d) if k % 2 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(reversed(digits))) % 10 == (10 - c) % 10)


def test_check_digits(spark):
    good = luhn("400000000000000")
    assert one(spark, [good, good[:-1] + str((int(good[-1]) + 1) % 10), "12", None], checks.luhn("v")) == [True, False, False, False]
    body = "11010519900307123"
    mark = checks.ID_CHECKS[sum(int(a) * b for a, b in zip(body, checks.ID_WEIGHTS, strict=True)) % 11]
    wrong = "0" if mark != "0" else "1"
    assert one(spark, [body + mark, body + wrong, "11010519901332123" + mark, "x"], checks.id_number("v", strict_standard=True)) == [True, False, False, False]
    code = "91350100M000100Y4"
    value = (31 - sum(checks.CREDIT_ALPHABET.index(c) * (3**k % 31) for k, c in enumerate(code)) % 31) % 31
    ok = checks.CREDIT_ALPHABET[value]
    assert one(spark, [code + ok, code + ("0" if ok != "0" else "1"), "short"], checks.credit_code("v")) == [True, False, None]
    assert one(spark, ["1.2.3.4", "1.2.3.256", "1.2.3"], checks.ipv4("v")) == [True, False, False]
    assert one(spark, ["123456789012345", "12345678901234X", "1"], checks.old_tax_number("v")) == [True, False, None]


def test_texts(spark):
    assert one(spark, ["ＡＢ　１"], text.half_width("v")) == ["AB 1"]
    assert one(spark, ["　 x  ", None], text.trim_u("v")) == ["x", None]
    assert one(spark, ["abcdefgh", "abcdefghij", "a" * 40], text.mask("v")) == ["*" * 8, "abcd**ghij", "aaaa" + "*" * 12 + "aaaa"]
    assert one(spark, ["ab", "中文x"], text.display_width("v")) == [2, 5]
    assert one(spark, ["a,b", 'q"q', "plain", None, "x\ny"], text.csv_escape("v")) == ['"a,b"', '"q""q"', "plain", "", '"x\ny"']
    assert one(spark, ["a|b", "x\r\ny"], text.markdown_cell("v")) == ["a\\|b", "x<br>y"]
    assert one(spark, ["1,200", "-3.5%", "¥7", "x", ""], text.numericish("v")) == [True, True, True, False, False]
    assert one(spark, [512, 2048, 5 << 20, 3 << 30], text.human_size("v"), "long") == ["512 B", "2.0 KB", "5.0 MB", "3.00 GB"]
    for style, want in {"kebab": "my-file-name-2", "snake": "my_file_name_2", "camel": "myFileName2", "pascal": "MyFileName2", "upper": "MYFILE NAME-2", "lower": "myfile name-2"}.items():
        assert one(spark, ["myFile name-2"], text.case_style("v", style)) == [want]
    assert one(spark, ["a\nbc\nd"], text.line_of("v", F.lit(5))) == [3]
    assert one(spark, ["stories", "boxes", "classes", "glass", "cats"], text.singular("v")) == ["story", "box", "class", "glass", "cat"]
    assert one(spark, ["ok_1", "two words", 'q"'], text.identifier("v")) == ["ok_1", '"two words"', '"q\\""']

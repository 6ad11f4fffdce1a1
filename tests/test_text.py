from pyspark.sql import functions as F

from cedarlog.functions import text


def values(spark, column, rows):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("c"))).collect()]


def test_masking(spark):
    cases = {
        "13300009999": "133****9999", "17700001111": "177****1111", "refA13300009999B": "refA13300009999B", "330102198506150023": "330102********0023",
        "33010219850615002X": "330102********002X", "6228480402564890018": "6228****0018", "card:6228480402564890018;": "card:6228****0018;", "ann.lee@mail.test": "an****@mail.test",
        "x@y.net": "x@y.net", "xy@z.net ok": "**@z.net ok", "x@y.net@z.test": "**@y.net@z.test", "": "",
        "\ue000ann\ue001@mail.test \ue002 \ue000\ue001 bob@mail.test": "\ue000ann\ue001@mail.test \ue002 \ue000\ue001 bo****@mail.test", "call 13300009999 \ue000(ab)\ue001": "call 133****9999 \ue000(ab)\ue001",
    }
    assert values(spark, text.mask, [*cases, None]) == [*cases.values(), None]


def test_sanitizing(spark):
    rows = ["user\r\n2031 WARN y", "key\tvalue", "before\x7fafter", "a<script>run('y')</script>b", "\x1b[31mred\x1b[0m", "ok ✅🎉", "a < b", None]
    assert values(spark, text.sanitize, rows) == ["user  2031 WARN y", "key value", "before after", "ab", "red", "ok ✅🎉", "a < b", None]


def test_throwables(spark):
    rows = ["E: x\n\tat a.B(C.java:1)\nCaused by: y\n... 3 more\n", "E: evil\nINFO fake\n\tat a.B.<init>(B.java:1)", None]
    assert values(spark, text.sanitize_throwable, rows) == [rows[0], "E: evil\n\t[ex-msg] INFO fake\n\tat a.B.(B.java:1)", None]


def test_gates(spark):
    assert values(spark, lambda c: text.secure(c)["value"], ["ab\x7fcd", "133<b></b>00009999", "13300009999"]) == ["ab\x7fcd", "13300009999", "133****9999"]
    assert values(spark, lambda c: text.secure(c, strict_mask=True)["value"], ["133<b></b>00009999"]) == ["133****9999"]
    assert values(spark, text.scan_flags, ["plain", "a<b", "x@y", "a<12345678901", None]) == [0, 1, 2, 3, 0]
    assert values(spark, lambda c: text.scan_flags(c, throwable=True), ["a\nb", "a\tb"]) == [1, 0]


def test_custom_rules(spark):
    assert text.unsafe_regex("(a+)+") == "nested quantifier" and text.unsafe_regex(None) == "null" and text.unsafe_regex("(") == "syntax"
    masker = text.Masker([("token=[^ ]+", "token=***")])
    assert values(spark, masker, ["token=abc9 x"]) == ["token=*** x"]
    assert not masker.add(("(a+)+", ""))


def test_mdc(spark):
    df = spark.sql("SELECT map('a b', 'x\\ny', 'traceId', '<b>1', 'k', 'mail anna@z.test') AS m")
    assert df.select(text.secure_mdc(F.col("m"))).first()[0] == {"a_b": "x y", "traceId": "<b>1", "k": "mail an****@z.test"}


def test_utf16(spark):
    assert values(spark, text.utf16_units, ["ok🎉", "", "é", None]) == [4, 0, 1, None]

"""Numbers in texts: English words to figures, Chinese numerals both ways, and the rates that compare them."""

import random

import pytest
from pyspark.sql import functions as F

from evalspark.functions import spoken_chinese as C
from evalspark.functions import spoken_english as E
from evalspark.operators import error_rates as R
from evalspark.plans import text_queries

ENGLISH = {
    "twenty one": "21", "two thousand and five": "2005", "nineteen sixties": "1960s", "one oh one": "101", "nineteen eighty four": "1984", "twenty twenty one": "2021",
    "two twenty two": "222", "ten eleven": "1011", "twenty million dollars": "$20000000", "two dollars and seven cents": "$2.07", "zero dollars and five cents": "¢5", "7 cents": "¢7",
    "three and a half million": "3500000", "dogs and a half": "dogs and a half", "and a half": "", "double oh seven": "007", "triple five": "555", "double trouble": "double trouble",
    "point five": ".5", "two point five million": "2500000", "three point hundred": "300", "one point two three": "one.23", "first": "1st", "one hundred twenty third": "123rd", "two thousands": "2000s",
    "minus five": "-5", "minus dogs": "minus dogs", "five percent": "5%", "five per cent": "5%", "five per dog": "5 per dog", "percent": "percent", "he is the one": "he is the one", "ones": "ones",
    "four hundred and dogs": "400 and dogs", "two and two": "2 and 2", "$5 and 3": "$5 and 3", "5 million": "5000000", "fifty 1960s": "50 1960s", "eighth ninth nineth": "8th ninth 9th", "zero thousand": "0",
    "sixty fourth": "64th", "a1b 2 nd": "a one b 2nd", "ten point one point two": "10.one.2", "1 thousand": "1000", "": "",
}


def test_english_numbers():
    assert {t: E.figures(t) for t in ENGLISH} == ENGLISH


def in_words(n):
    """A cardinal in English words, written for this test."""
    if n < 20:
        return ["zero", *E.UNITS][n]
    if n < 100:
        return E.TENS[n // 10 - 2] + (" " + in_words(n % 10) if n % 10 else "")
    for name, size in [(w, 1000**k) for k, w in reversed(list(enumerate(E.THOUSANDS, 1)))] + [("hundred", 100)]:
        if n >= size:
            return f"{in_words(n // size)} {name}" + (" and " if name == "hundred" and n % size else " ") * bool(n % size) + (in_words(n % size) if n % size else "")


def test_cardinals_of_all_sizes_read_back():
    rng = random.Random(2)
    for n in [*range(2, 3000), *(rng.randrange(10 ** rng.randrange(4, 16)) for _ in range(3000))]:
        assert E.figures(in_words(n)) == ("one" if n == 1 else str(n)), in_words(n)


CHINESE = {
    "固话：0595-23865596或23880880。": "固话 零五九五二三八六五五九六或二三八八零八八零 ", "手机：+86 19859213959或15659451527。": "手机 八六一九八五九二一三九五九或一五六五九四五一五二七 ",
    "分数：32477/76391。": "分数 七万六千三百九十一分之三万两千四百七十七 ", "百分数：80.03%。": "百分数 百分之八十点零三 ", "有62％": "有百分之六十二", "编号：31520181154418。": "编号 三一五二零一八一一五四四一八 ",
    "日期：1999年2月20日或09年3月15号。": "日期 一九九九年二月二十日或零九年三月十五号 ", "12块5，34.5元，20.1万": "十二块五 三十四点五元 二十点一万", "O2O或B2C": "O2O或B2C", "2938个": "两千九百三十八个", "938": "九百三十八", "": "", "没有": "没有",
}
NUMERALS = {"0": "零", "10": "十", "12": "十二", "20": "二十", "200": "两百", "222": "两百二十二", "1001": "一千零一", "1010": "一千零一十", "10010": "一万零一十", "100000": "十万", "20000": "两万", "1020000": "一百零二万", "0.5": "零点五", "05": "零五", "12.30": "十二点三零"}


def test_chinese_numerals_and_texts():
    assert {n: C.numeral(n) for n in NUMERALS} == NUMERALS
    assert {t: C.spoken(t) for t in CHINESE} == CHINESE
    read = {"一百八": "180", "一亿一千三百万": "113000000", "两千万": "20000000", "十": "10", "一万八": "18000", "三点一四": "3.14", "壹佰贰拾": "120", "一百零八": "108", "〇": "0"}
    assert {t: C.number(t) for t in read} == read
    for odd in ("", "三点四点五", "一只"):
        with pytest.raises(ValueError):
            C.number(odd)


def test_numerals_read_back_up_to_a_million_millions():
    rng = random.Random(3)
    for n in [*range(0, 20_000), *(rng.randrange(10 ** rng.randrange(5, 13)) for _ in range(20_000)), 10**12]:
        assert C.number(C.numeral(str(n))) == str(n)


def test_normalized_rates_and_skipped_references(spark):
    rows = [(1, "I've got twenty-one dogs.", "i have got 21 dogs"), (2, "uh, um", "x"), (3, "xxx", "x"), (4, "It costs two dollars", "it costs $3"), (5, None, "x"), (6, "hello there", None)]
    got = {r.id: (r.skipped, r.errors, r.n) for r in R.practice(spark.createDataFrame(rows, "id int, r string, h string"), "r", "h").collect()}
    assert got[1] == (None, 0, 5) and got[2][0] == "filler_only" and got[3][0] == "placeholder_ref" and got[4] == (None, 1, 4) and got[6] == (None, 2, 2)
    assert got[2][1:] == got[3][1:] == (None, None)
    zh = spark.createDataFrame([(1, "共200个。", "共两百个"), (2, "呃啊", "x")], "id int, r string, h string")
    assert [(r.skipped, r.errors) for r in R.practice(zh, "r", "h", "zh").orderBy("id").collect()] == [(None, 0), ("filler_only", None)]
    spelled = spark.range(1).select(R.normalize_english(F.lit("The colour of one"), {"colour": "color"}).alias("t")).first().t
    assert spelled.strip() == "the color of one"


def test_queries_of_numbers(spark):
    sf = "/root/testdata/sf0.001"
    for r in text_queries.normalize_english(spark, sf).collect():
        assert r.normal.rstrip().endswith(f"turn 2{r.turn % 9 + 1} of 205 that is 50%")
    for r in text_queries.normalize_chinese(spark, sf).limit(500).collect():
        assert not any(c.isdigit() and c.isascii() for c in r.said) 
        assert r.o_orderkey <= 10 or f"单{r.o_orderkey}个" in r.figures
        assert r.figures[:2] in ("19", "20")

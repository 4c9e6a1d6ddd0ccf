"""Chinese numerals both ways, and the rules that write figures in texts as they are said."""

from __future__ import annotations

import re
import string
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Numerals with their other forms, and units with the powers of ten that they stand for.
DIGITS = "零一二三四五六七八九"
FORMS = ("零壹贰叁肆伍陆柒捌玖", "零壹貳參肆伍陸柒捌玖")
ALSO = {"〇": 0, "幺": 1, "两": 2, "兩": 2}
SMALL, SMALL_ALSO = "十百千万", "拾佰仟萬"
LARGE, LARGE_ALSO = "亿兆京垓秭穰沟涧正载", "億兆京垓秭穰溝澗正載"
POINTS = "点點"

POWER_OF = {u: k + 1 for names in (SMALL, SMALL_ALSO) for k, u in enumerate(names)} | {u: 8 + 4 * k for names in (LARGE, LARGE_ALSO) for k, u in enumerate(names)}
UNITS = sorted({POWER_OF[u]: u for u in SMALL + LARGE}.items(), reverse=True)
DIGIT_OF = {d: k for names in (DIGITS, *FORMS) for k, d in enumerate(names)} | ALSO
_DIGIT, _SIGN = f"[{''.join(DIGIT_OF)}]", f"[{''.join(DIGIT_OF)}{''.join(POWER_OF)}]"
_POINT, _UNIT = re.compile(f"[{POINTS}]"), re.compile(f"[{''.join(POWER_OF)}]")
_NUMERAL = re.compile(f"(?=.){_SIGN}*(?:[{POINTS}]{_DIGIT}*)?")
_RUNS = re.compile(f"{_SIGN}{{2,}}(?:[{POINTS}]{_DIGIT}+)?")


def _said(figures: str) -> list[tuple[int, int | None]]:
    """A run of figures as (digit, None) and (0, power of a unit), the greatest unit first."""
    bare = figures.lstrip("0")
    if len(bare) < 2:
        zero = [(0, None)] if bare and bare != figures else []
        return zero + [(int(d), None) for d in bare]
    power = next(p for p, _ in UNITS if p < len(bare))
    # zeros that lead stay with what the unit counts
    return _said(figures[:-power]) + [(0, power)] + _said(bare[-power:])


_READ = str.maketrans("0123456789", DIGITS)
_NAMES = dict(UNITS)


def _read(figures: str) -> str:
    """Figures one by one."""
    return figures.translate(_READ) if figures.isascii() else "".join(DIGITS[int(d)] for d in figures)


@lru_cache(1 << 16)
def _group(figures: str, closed: bool) -> str:
    """A run of figures worth less than ten thousand, as it is said at the start or behind a unit above ten; closed: such
    a unit follows."""
    symbols = _said(figures)
    out = []
    for k, (digit, power) in enumerate(symbols):
        before = symbols[k - 1][1] if k else 0
        after = symbols[k + 1][1] if k + 1 < len(symbols) else 4 if closed else None
        # two of a unit above ten, at the start or behind another such unit
        pair = digit == 2 and power is None and after not in (None, 1) and before not in (None, 1)
        out.append(_NAMES[power] if power else "两" if pair else DIGITS[digit])
    return "".join(out)


def _whole(figures: str, closed: bool = False) -> str:
    """A run of figures as a numeral, by what stands before and behind its greatest unit above a thousand."""
    bare = figures.lstrip("0")
    if len(bare) < 5:
        return _group(figures, closed)
    power = next(p for p, _ in UNITS if p < len(bare))
    # zeros that lead stay with what the unit counts
    return _whole(figures[:-power], True) + _NAMES[power] + _whole(bare[-power:], closed)


def numeral(number: str, by_digit: bool = False) -> str:
    """Figures, with a decimal point or without, as a numeral (or read digit by digit)."""
    whole, point, decimals = number.partition(".")
    text = _read(whole) if by_digit or len(whole) == 1 else _whole(whole)
    if point:
        text += "点" + _read(decimals)
    if text.startswith("点"):
        return "零" + text
    return text[1:] if text.startswith("一十") else text


def number(text: str) -> str:
    """A numeral as figures. A digit at the end, behind a unit, counts the unit below (一百八 is 180); a unit multiplies
    whatever smaller ones stand before it. ValueError for anything else than a numeral."""
    if not _NUMERAL.fullmatch(text):
        raise ValueError(f"no numeral: {text}")
    whole, *rest = _POINT.split(text)
    high, unit, low = whole.partition("万")
    if unit and high and len(low) != 1 and (not low or low[0] in DIGIT_OF) and not _LARGER.search(high) and not _LARGER.search(low):
        # what counts the ten thousands, and the rest: both come again and again
        value = _summed(high, True) * 10**4 + _summed(low)
    else:
        value = _summed(whole)
    return f"{value}.{''.join(str(DIGIT_OF[c]) for c in rest[0])}" if rest and rest[0] else str(value)


#: Units from ten thousand on, and units that multiply others.
_LARGER = re.compile(f"[{''.join(u for u, p in POWER_OF.items() if p > 3)}]|{_UNIT.pattern}{{2}}")


@lru_cache(1 << 16)
def _summed(whole: str, closed_by_unit: bool = False) -> int:
    """The value of a numeral without decimals; with closed_by_unit a greater unit stands behind it, so that a last digit
    counts ones."""
    # sums by the power of the unit that closed them, powers falling
    closed: list[tuple[int, int]] = []
    digit: int | None = None
    for k, c in enumerate(whole):
        if c in DIGIT_OF:
            digit = DIGIT_OF[c]
            continue
        power = POWER_OF[c]
        lower = [v for v, p in closed if p < power]
        closed = [(v, p) for v, p in closed if p >= power]
        count = sum(lower) + (digit or 0)
        if digit is None and not lower:
            # ten alone is one ten; a unit behind a greater one multiplies that one
            if closed and k:
                v, p = closed.pop()
                closed.append((v * 10**power, p + power))
                continue
            count = 1 if power == 1 else 0
        closed.append((count * 10**power, power))
        digit = None
    value = sum(v for v, _ in closed)
    if digit is not None:
        last = POWER_OF.get(whole[-2]) if len(whole) > 1 and not closed_by_unit else None
        value += digit * 10 ** (last - 1) if last else digit
    return value


# Units of money, and the words that count things.
MONEY = "((亿|千万|百万|万|千|百)|(亿|千万|百万|万|千|百|)元|(亿|千万|百万|万|千|百|)块|角|毛|分)"
COUNTERS = (
    "(?:[匹张座回场尾条个首阙阵网炮顶丘棵只支袭辆挑担颗壳窠曲墙群腔砣客贯扎捆刀令打手罗坡山岭江溪钟队单双对出口头脚板跳枝件贴针线管名位身堂课本页家户层丝毫厘分钱两斤"
    "铢石钧锱忽寸尺丈里寻常铺程撮勺合升斗盘碗碟叠桶笼盆盒杯斛锅簋篮罐瓶壶卮盏箩箱煲啖袋钵年月日季刻时周天秒旬纪岁世更夜春夏秋冬代伏辈丸泡粒幢堆根道面片块]|[千微][克米])"
)
MARKS = "！？｡。＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､、〃《》「」『』【】〔〕〖〗〘〙〚〛〜〝〞〟〰〾〿–—‘’‛“”„‟…‧﹏·〈〉-"
_MARKS = re.compile(f"[{re.escape(MARKS + string.punctuation)}]")
_BETWEEN = re.compile(r"([a-zA-Z]+)二([a-zA-Z]+)")
_FIGURES = re.compile(r"\d+(?:\.\d+)?")


def _by_digit(text: str) -> str:
    return "".join(numeral(part, by_digit=True) for part in re.findall(r"\d+", text))


def _date(text: str) -> str:
    year, mark, rest = text.rpartition("年")
    spoken = [numeral(year, by_digit=True) + mark if mark else ""]
    # 3月5日: month and day, each with its own sign
    return "".join(spoken + [numeral(n) + sign for n, sign in re.findall(r"(\d+)(\D)", rest)])


def _money(text: str) -> str:
    for n in _FIGURES.findall(text):
        text = text.replace(n, numeral(n))
    return text


def _fraction(text: str) -> str:
    above, below = text.split("/")
    return f"{numeral(below)}分之{numeral(above)}"


#: Rules in order (patterns are fixed values): what the first group matches is said so, in texts that hold what stands
#: before the pattern. Runs of figures are never given back: nothing behind them could match a figure or a point.
RULES: tuple[tuple[re.Pattern, re.Pattern, Callable[[str], str]], ...] = tuple(
    (re.compile(sign), re.compile(pattern), say)
    for sign, pattern, say in (
        ("[年月]", r"\D+((([089]\d|(19|20)\d{2})年)?(\d{1,2}月(\d{1,2}[日号])?)?)", _date),
        ("[亿万千百元块角毛分]", rf"\D++((\d++(\.\d++)?+)[多余几]?{MONEY}(\d{MONEY}?)?)", _money),
        (r"\d{9}", r"\D((\+?86 ?)?1([38]\d|5[0-35-9]|7[678]|9[89])\d{8})\D", _by_digit),
        (r"\d{7}", r"\D((0(10|2[1-3]|[3-9]\d{2})-?)?[1-9]\d{6,7})\D", _by_digit),
        ("/", r"(\d+/\d+)", _fraction),
        ("[%％]", r"(\d++(\.\d++)?+[%％])", lambda t: "百分之" + numeral(t[:-1])),
        (r"\d", rf"(\d++(\.\d++)?+)[多余几]?{COUNTERS}", numeral),
        (r"\d{4}", r"(\d{4,32})", lambda t: numeral(t, by_digit=True)),
        (r"\d", r"(\d+(\.\d+)?)", numeral),
    )
)


def spoken(text: str) -> str:
    """A text with its figures as they are said: dates, money, telephone numbers, fractions, per cent, counted things,
    long numbers digit by digit, others as numerals; a per-cent sign of full width counts too. Punctuation becomes blanks."""
    # rules see what stands around figures, at either end too
    text = f"^{text}$"
    for sign, pattern, say in RULES:
        if sign.search(text):
            for found in [m[1] for m in pattern.finditer(text) if m[1]]:
                text = text.replace(found, say(found), 1)
    text = _BETWEEN.sub(r"\g<1>2\2", text)
    return _MARKS.sub(" ", text.lstrip("^").rstrip("$"))


@F.arrow_udf(returnType=StringType())
def spoken_numerals(text: pa.Array) -> pa.Array:
    """`spoken` of a column of texts."""
    return pa.array([None if t is None else spoken(t) for t in text.to_pylist()], pa.string())


_FIGURE = {ord(c): str(d) for c, d in DIGIT_OF.items()} | dict.fromkeys(map(ord, POINTS), ".")


def _numbers_said(text: str) -> str:
    """Numerals of two characters or more in a text as figures; digits without units are read one by one."""
    return _RUNS.sub(lambda m: number(m[0]) if _UNIT.search(m[0]) else m[0].translate(_FIGURE), text)


_SAID = StructType([StructField("said", StringType()), StructField("figures", StringType())])


@F.arrow_udf(returnType=_SAID)
def spoken_and_read(text: pa.Array) -> pa.Array:
    """`spoken` of a column of texts, and that with its numerals as figures again; each text is said once."""
    said = [None if t is None else spoken(t) for t in text.to_pylist()]
    read = [None if t is None else _numbers_said(t) for t in said]
    return pa.StructArray.from_arrays([pa.array(said, pa.string()), pa.array(read, pa.string())], names=_SAID.names)


@F.arrow_udf(returnType=StringType())
def numerals_to_figures(text: pa.Array) -> pa.Array:
    """Texts with their numerals as figures."""
    return pa.array([None if t is None else _numbers_said(t) for t in text.to_pylist()], pa.string())

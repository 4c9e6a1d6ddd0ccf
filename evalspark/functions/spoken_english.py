"""Spelled-out English numbers to figures, as an automaton over words.

Every word belongs to a class; a class has one rule for what it does to the number read so far, which is a sum that can
still grow (an int), a string of figures that were said one by one (a str), or nothing (None). Rules may look one word
back and one ahead.
"""

from __future__ import annotations

import re
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Number words, multipliers, signs, currencies.
UNITS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ZEROS = ("o", "oh", "zero")
THOUSANDS = "thousand million billion trillion quadrillion quintillion sextillion septillion octillion nonillion decillion".split()
ODD_PLURALS = {"six": "sixes"}
ODD_ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "twelve": "twelfth"}
ORDINAL_ENDS = {1: "st", 2: "nd", 3: "rd"}
SIGNS = {"minus": "-", "negative": "-", "plus": "+", "positive": "+"}
CURRENCIES = {"pound": "£", "pounds": "£", "euro": "€", "euros": "€", "dollar": "$", "dollars": "$", "cent": "¢", "cents": "¢"}
REPEATS = {"double": 2, "triple": 3}

ONES = {w: k for k, w in enumerate(UNITS, 1)}
DECADES = {w: 10 * k for k, w in enumerate(TENS, 2)}
POWERS = {"hundred": 100} | {w: 1000**k for k, w in enumerate(THOUSANDS, 1)}


def _endings() -> dict[str, tuple[str, int, str]]:
    """(class, value, ending) of plurals and ordinals."""
    out: dict[str, tuple[str, int, str]] = {"zeroth": ("unit", 0, "th")}
    for word, value in ONES.items():
        out[ODD_PLURALS.get(word, word + "s")] = ("unit", value, "s")
        # the word list that must be equalled has "nineth" for the ninth
        ordinal = ODD_ORDINALS.get(word, word + ("h" if word.endswith("t") else "th"))
        out[ordinal] = ("unit", value, ORDINAL_ENDS.get(value, "th"))
    for word, value in DECADES.items():
        out[word.replace("y", "ies")] = ("ten", value, "s")
        out[word.replace("y", "ieth")] = ("ten", value, "th")
    for word, value in POWERS.items():
        out[word + "s"], out[word + "th"] = ("power", value, "s"), ("power", value, "th")
    return out


WORDS: dict[str, tuple[str, int, str]] = {w: ("zero", 0, "") for w in ZEROS}
WORDS |= {w: ("unit", v, "") for w, v in ONES.items()} | {w: ("ten", v, "") for w, v in DECADES.items()} | {w: ("power", v, "") for w, v in POWERS.items()}
WORDS |= _endings()
WORDS |= {w: ("sign", 0, "") for w in SIGNS} | {w: ("currency", 0, "") for w in CURRENCIES} | {w: (w, 0, "") for w in ("per", "percent", "and", "point")} | {w: ("repeat", n, "") for w, n in REPEATS.items()}
_FIGURES = re.compile(r"\d+(\.\d+)?")
_SYMBOLS = {*SIGNS.values(), *CURRENCIES.values()}


class _Reader:
    """Words in, words with figures out."""

    def __init__(self) -> None:
        self.number: int | str | None = None
        self.symbol = ""
        self.out: list[str] = []

    def put(self, word: int | str) -> None:
        """Writes a word behind the symbol that waits for one; the number read so far is done with."""
        self.out.append(f"{self.symbol}{word}")
        self.number, self.symbol = None, ""

    def flush(self) -> None:
        if self.number is not None:
            self.put(self.number)

    def _joined(self, value: int, before: str | None, is_unit: bool) -> int | str:
        """The number with a word from one to ninety behind it."""
        number = self.number
        if number is None:
            return value
        if isinstance(number, str) or is_unit and before in ONES:
            # twenty twenty | one: the last figure is a place for this one
            return f"{number}"[:-1] + str(value) if is_unit and before in DECADES and value < 10 else f"{number}{value}"
        room = 10 if value < 10 else 100
        return number + value if number % room == 0 else f"{number}{value}"

    def _scaled(self, power: int) -> int | None:
        """The number times a power, or with its last three places times it; None if it can't be multiplied."""
        number = self.number
        if number is None:
            return power
        if isinstance(number, int):
            return number - number % 1000 + number % 1000 * power
        try:
            product = Fraction(number) * power
        except ValueError:
            return None
        return product.numerator if product.denominator == 1 else None

    def read(self, words: list[str]) -> list[str]:
        skip = False
        for before, word, after in zip([None, *words], words, [*words[1:], None], strict=False):
            if skip:
                skip = False
                continue
            kind, value, ending = WORDS.get(word, ("", 0, ""))
            countable = after is not None and (after in WORDS or bool(_FIGURES.fullmatch(after)))
            figures = word[1:] if word[0] in _SYMBOLS else word
            if _FIGURES.fullmatch(figures):
                self._figures(word, figures)
            elif not kind:
                self.flush()
                self.put(word)
            elif kind == "zero":
                self.number = f"{self.number or ''}0"
            elif kind in ("unit", "ten"):
                self.number = self._joined(value, before, kind == "unit")
                if ending:
                    self.put(f"{self.number}{ending}")
            elif kind == "power":
                self._power(value, ending)
            elif kind == "sign":
                self.flush()
                if countable:
                    self.symbol = SIGNS[word]
                else:
                    self.put(word)
            elif kind == "currency" and self.number is not None:
                self.symbol = CURRENCIES[word]
                self.flush()
            elif kind in ("percent", "per") and self.number is not None:
                skip = kind == "per" and after == "cent"
                if kind == "percent" or skip:
                    self.put(f"{self.number}%")
                else:
                    self.flush()
                    self.put(word)
            elif kind == "repeat" and after is not None and WORDS.get(after, ("",))[0] in ("unit", "zero") and not WORDS[after][2]:
                self.number = f"{self.number or ''}" + str(WORDS[after][1]) * value
                skip = True
            elif kind == "point" and countable:
                # before a word that is no figure, such as "hundred", it goes
                if WORDS.get(after, ("zero", 0, ""))[0] in ("zero", "unit", "ten") and not WORDS.get(after, ("", 0, ""))[2]:
                    self.number = f"{self.number or ''}."
            elif not (kind == "and" and countable and before in POWERS):
                self.flush()
                self.put(word)
        self.flush()
        return self.out

    def _figures(self, word: str, figures: str) -> None:
        if isinstance(self.number, str) and self.number.endswith("."):
            self.number += word
            return
        self.flush()
        if word != figures:
            self.symbol = word[0]
        whole = Fraction(figures)
        self.number = whole.numerator if whole.denominator == 1 else figures

    def _power(self, power: int, ending: str) -> None:
        product = self._scaled(power) if self.number != 0 or ending else 0
        if product is None:
            self.flush()
            product = power
        self.number = product
        if ending:
            self.put(f"{product}{ending}")


def _halves(text: str) -> str:
    """`and a half` as `point five` behind a number word."""
    pieces = re.split(r"\band\s+a\s+half\b", text)
    out = []
    for k, piece in enumerate(pieces):
        if not piece.strip():
            continue
        out.append(piece)
        if k + 1 < len(pieces):
            last = WORDS.get(piece.split()[-1], ("", 0, ""))
            out.append("point five" if last[0] in ("zero", "unit", "ten", "power") and not last[2] else "and a half")
    return " ".join(out)


# Where figures and letters part, and which endings stay with figures.
_SPACING = ((r"([a-z])([0-9])", r"\1 \2"), (r"([0-9])([a-z])", r"\1 \2"), (r"([0-9])\s+(st|nd|rd|th|s)\b", r"\1\2"))


def figures(text: str) -> str:
    """Lower-case text with its spelled-out numbers as figures: cardinals, ordinals, decades, decimals, currencies, per
    cent, repeated figures; a lone 1 is written out."""
    text = _halves(text)
    for pattern, by in _SPACING:
        text = re.sub(pattern, by, text)
    text = " ".join(_Reader().read(text.split()))
    text = re.sub(r"([€£$])([0-9]+) (?:and )?¢([0-9]{1,2})\b", lambda m: f"{m[1]}{m[2]}.{int(m[3]):02d}", text)
    text = re.sub(r"[€£$]0.([0-9]{1,2})\b", lambda m: f"¢{int(m[1])}", text)
    return re.sub(r"\b1(s?)\b", r"one\1", text)


def spoken_numbers(spellings: dict[str, str] | None = None):
    """An Arrow function of `figures`; then words are replaced by `spellings`, a table of British by American ones, say."""
    table = dict(spellings or {})

    @F.arrow_udf(returnType=StringType())
    def run(text: pa.Array) -> pa.Array:
        def one(t: str) -> str:
            return " ".join(table.get(w, w) for w in figures(t).split())

        return pa.array([None if t is None else one(t) for t in text.to_pylist()], pa.string())

    return run

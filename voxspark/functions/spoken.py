"""Token walks over spoken forms: numbers, money, times, dates, ordinals, punctuation.

Each rule is a small Python function of one string; pandas UDFs apply them to Arrow
batches, behind an rlike filter, so rows without a spoken form never leave the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rx import word

# fixed values
_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_SCALES = {"thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
_ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split()
_TENTHS = "twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth ninetieth".split()
_MONTHS = "january february march april may june july august september october november december".split()
_SIGNS = {"dollar": "$", "dollars": "$", "euro": "€", "euros": "€", "pound": "£", "pounds": "£"}
_CENTS = {"$": {"cent", "cents"}, "€": {"cent", "cents"}, "£": {"pence", "penny", "p"}}
_NUMBERED = set("avenue street boulevard floor anniversary birthday edition grade amendment".split())
_TLDS = set("com net org io dev ai co edu gov app me sh us uk de fr ca au jp info xyz".split())
MOST = 999_999_999_999

SMALL = {w: i for i, w in enumerate(_SMALL)}
TENS = {w: 10 * i for i, w in enumerate(_TENS, 2)}
ORDINALS = {w: i for i, w in enumerate(_ORDINALS, 1)} | {w: 10 * i for i, w in enumerate(_TENTHS, 2)}
NUMBER_WORDS = {*SMALL, *TENS, *_SCALES, "hundred"}

_WORD = re.compile(r"[A-Za-z']+")
_RUN = re.compile(r"[A-Za-z']+(?:[ \t]+[A-Za-z']+)*")


def read_number(words: list[str], at: int = 0) -> tuple[int, int] | None:
    """(value, index after it) of the number that starts at words[at], or None.

    A scale multiplies all that stands before it, and an "and" inside a number is taken
    even if the word behind it then doesn't fit.
    """
    done = hundreds = rest = 0
    i, after_digit, any_ = at, False, False
    while i < len(words):
        w = words[i]
        if w == "and":
            if not any_ or i + 1 == len(words) or words[i + 1] not in SMALL.keys() | TENS.keys():
                break
        elif (v := SMALL.get(w)) is not None:
            if v < 10 and (after_digit or rest % 10) or v >= 10 and rest:
                break
            rest, after_digit, any_ = rest + v, True, True
        elif w in TENS:
            if rest:
                break
            rest, after_digit, any_ = TENS[w], False, True
        elif w == "hundred":
            if not rest or hundreds:
                break
            hundreds, rest, after_digit = 100 * rest, 0, False
        elif w in _SCALES:
            done, hundreds, rest, after_digit, any_ = (done + hundreds + rest or 1) * _SCALES[w], 0, 0, False, True
        else:
            break
        i += 1
    value = done + hundreds + rest
    return (value, i) if any_ and value <= MOST else None


def _walk(text: str, rule: Callable[[list[str], int], tuple[str, int] | None]) -> str:
    """Replace, inside runs of words with only blanks between, what rule(words, i) takes."""

    def run(m: re.Match) -> str:
        spans = [x.span() for x in _WORD.finditer(m[0])]
        words = [m[0][a:b].lower() for a, b in spans]
        if not NUMBER_WORDS.intersection(words):
            return m[0]
        out, i, last = [], 0, 0
        while i < len(words):
            got = rule(words, i)
            if got:
                out += [m[0][last:spans[i][0]], got[0]]
                last = spans[got[1] - 1][1]
            i = got[1] if got else i + 1
        return "".join([*out, m[0][last:]])

    return _RUN.sub(run, text)


def _money(words: list[str], i: int) -> tuple[str, int] | None:
    n = read_number(words, i)
    if not n or n[1] >= len(words) or words[n[1]] not in _SIGNS:
        return None
    sign, j = _SIGNS[words[n[1]]], n[1] + 1
    if j < len(words) and words[j] == "and" and (c := read_number(words, j + 1)) and c[0] < 100 and c[1] < len(words) and words[c[1]] in _CENTS[sign]:
        return f"{sign}{n[0]}.{c[0]:02d}", c[1] + 1
    return f"{sign}{n[0]}", j


def _cardinal(words: list[str], i: int) -> tuple[str, int] | None:
    n = read_number(words, i)
    if n and (n[1] - i >= 2 or words[i] in TENS or SMALL.get(words[i], 0) >= 10):
        return str(n[0]), n[1]
    return None


def currency(text: str) -> str:
    return _walk(text, _money)


def cardinals(text: str) -> str:
    return _walk(text, _cardinal)


_HOURS = "|".join(_SMALL[1:13])
_TIME = re.compile(rf"\b(\d{{1,2}}|{_HOURS})(?:[ -]+(o'?clock|thirty|fifteen|forty[ -]?five|[0-5]?\d))?[ ]+(a\.?m\.?|p\.?m\.?)(?=$|[^a-zA-Z])", re.I | re.A)


def times(text: str) -> str:
    def one(m: re.Match) -> str:
        hour = int(m[1]) if m[1].isdigit() else SMALL[m[1].lower()]
        said = re.sub(r"[ -]+", " ", (m[2] or "0").lower())
        minute = int(said) if said.isdigit() else {"thirty": 30, "fifteen": 15, "forty five": 45, "o'clock": 0, "oclock": 0}.get(said)
        if not 1 <= hour <= 12 or minute is None:
            return m[0]
        return f"{hour}{f':{minute:02d}' if minute else ''} {m[3].replace('.', '').upper()}"

    return _TIME.sub(one, text)


_TEN, _ORD, _MONTH = "|".join(TENS), "|".join(ORDINALS), "|".join(_MONTHS)
_DAY = rf"(?:(?:{_TEN})[- ])?(?:{_ORD})|\d{{1,2}}(?:st|nd|rd|th)?"
_DATES = (re.compile(rf"\b(?P<m>{_MONTH})\s+(?P<d>{_DAY})\b", re.I | re.A), re.compile(rf"\bthe\s+(?P<d>{_DAY})\s+of\s+(?P<m>{_MONTH})\b", re.I | re.A))


def dates(text: str) -> str:
    def one(m: re.Match) -> str:
        said = m["d"].lower()
        parts = re.split("[- ]", said)
        day = int(re.match(r"\d+", said)[0]) if said[0].isdigit() else sum(TENS.get(p) or ORDINALS[p] for p in parts)
        return f"{m['m'].capitalize()} {day}" if 1 <= day <= 31 else m[0]

    for rule in _DATES:
        text = rule.sub(one, text)
    return text


def suffixed(n: int) -> str:
    return f"{n}{'th' if n % 100 in (11, 12, 13) else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"


_COMPOUND = re.compile(rf"\b({_TEN})[- ]({_ORD})\b", re.I | re.A)
_SIMPLE = re.compile(rf"\b({_ORD})\b", re.I | re.A)


def ordinals(text: str) -> str:
    def both(m: re.Match) -> str:
        o = ORDINALS[m[2].lower()]
        return suffixed(TENS[m[1].lower()] + o) if o < 10 else m[0]

    def alone(m: re.Match) -> str:
        said, n = m[1].lower(), ORDINALS[m[1].lower()]
        before = re.search(r"([^ ]*)$", m.string[:m.start()].rstrip())[1].lower()
        before = re.sub(r"^[^\w]+|[^\w]+$", "", before, flags=re.A)
        after = re.match(r"[A-Za-z0-9_]*", m.string[m.end():].lstrip())[0].lower()
        if said == "second" and (before in ("per", "a", "an", "every", "each") or before.isdigit() or before in NUMBER_WORDS):
            return m[0]
        if after == "hour" and said == "eleventh" or n < 10 and after not in _NUMBERED or n >= 10 and before in ("a", "an", "one"):
            return m[0]
        return suffixed(n)

    return _SIMPLE.sub(alone, _COMPOUND.sub(both, text))


_BIG = re.compile(r"([$€£])(\d{4,})(?!\d)(?!,\d)|(?<![\d.,€£$])(\d{6,})(?!\d)(?!,\d)")


def grouped(text: str) -> str:
    return _BIG.sub(lambda m: f"{m[1] or ''}{int(m[2] or m[3]):,}" if not (m[2] or m[3]).startswith("0") else (m[1] or "") + f"{int('1' + (m[2] or m[3])):,}"[1:].lstrip(","), text)


def itn(text: str) -> str:
    if not text.strip():
        return text
    for rule in (currency, times, dates, ordinals, cardinals, grouped):
        text = rule(text)
    return re.sub(r"[ \t]{2,}", " ", re.sub(r"[ \t]+([,.;:!?])", r"\1", text))


_MARKS = {("question", "mark"): "?", ("exclamation", "mark"): "!", ("exclamation", "point"): "!", ("full", "stop"): "."}
_BREAKS = {("new", "line"): "\n", ("new", "paragraph"): "\n\n"}
_ATTACHED = {"comma": ",", "semicolon": ";", "colon": ":"}
_END = re.compile(r"[.,!?;:]+$")
_PLAIN = re.compile(r"[A-Za-z0-9_'-]+")


def punctuation(text: str) -> str:
    """Commands become marks on the word before them; leading commands are dropped."""
    tokens = text.split()
    if not tokens:
        return text
    said = [_END.sub("", t.lower()) for t in tokens] + ["", ""]
    out: list[str] = []
    capital = glue = False
    i = 0

    def attach(mark: str) -> bool:
        if not out or out[-1][0] == "\n":
            return False
        out[-1] = _END.sub("", out[-1]) + mark
        return True

    while i < len(tokens):
        two, one = (said[i], said[i + 1]), said[i]
        plain_next = bool(_PLAIN.fullmatch(said[i + 1]))
        step = 2
        if two in _MARKS:
            capital = attach(_MARKS[two])
        elif two == ("at", "sign"):
            glue = attach("@")
        elif two in _BREAKS:
            attach("")
            out.append(_BREAKS[two])
            capital = True
        elif one == "hyphen" and out and plain_next:
            out[-1] += "-" + tokens[i + 1]
        elif one == "dot" and out and plain_next and (said[i + 1] in _TLDS or said[i + 2] == "dot") and re.search(r"[A-Za-z0-9_-]$", out[-1]):
            out[-1] += "." + said[i + 1]
        else:
            step = 1
            if one == "period":
                capital = attach(".")
            elif one in _ATTACHED:
                attach(_ATTACHED[one])
            else:
                w = "&" if one == "ampersand" else tokens[i]
                if capital:
                    w, capital = w[:1].upper() + w[1:], False
                if glue and out:
                    out[-1] += w
                else:
                    out.append(w)
                glue = False
        i += step
    joined = ""
    for part in out:
        joined = joined.rstrip(" \t") + part if part[0] == "\n" else joined + ("" if not joined or joined.endswith("\n") else " ") + part
    return joined.strip()


def _udf(f: Callable[[str], str]):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


_NUMBERISH = "|".join(sorted({*NUMBER_WORDS, *ORDINALS, *_MONTHS, *_SIGNS})) + r"|[ap]\.?m\.?"


_TWO = r"[.,!?;:]*[\s\x1c-\x1f\x85\p{Z}]+"
_COMMANDS = [*_ATTACHED, "period", "ampersand", "hyphen", "dot", *(_TWO.join(x) for x in (*_MARKS, *_BREAKS, ("at", "sign")))]
#: A command, or white space that is not one blank between words, in a text with a word.
_COMMANDED = rf"(?s)(?=.*\S)(?:(?i).*?(?:{'|'.join(_COMMANDS)})|.*?[\t-\r\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|.*?  |^ |.* $)"


def _behind(c: Column, pattern: str, f: Callable[[str], str]) -> Column:
    """f, by way of Python only for the rows that the pattern finds."""
    return F.when(c.rlike(pattern), _udf(f)(F.when(c.rlike(pattern), c))).otherwise(c)


def itn_currency(c: Column) -> Column:
    return _behind(c, word("|".join(_SIGNS)), currency)


def itn_times(c: Column) -> Column:
    return _behind(c, r"(?i)[ap]\.?m", times)


def itn_dates(c: Column) -> Column:
    return _behind(c, word(_MONTH), dates)


def itn_ordinals(c: Column) -> Column:
    return _behind(c, word(_ORD), ordinals)


def itn_cardinals(c: Column) -> Column:
    return _behind(c, word("|".join(sorted(NUMBER_WORDS))), cardinals)


def number_words_to_int(c: Column) -> Column:
    """The number that a text of number words starts with, or null."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None or (n := read_number(t.lower().split())) is None else n[0]).astype("Int64")

    return run(c)


def group_digits(c: Column) -> Column:
    """Thousands separators: from four digits after a currency sign, from six alone."""
    return _behind(c, r"\d{4,}", grouped)


def apply_itn(c: Column, marks: bool = False) -> Column:
    """Written forms of all spoken numbers; idempotent.  marks: also spoken punctuation."""
    from .text import itn_punctuation

    c = itn_punctuation(c) if marks else c
    return _behind(c, rf"{word(_NUMBERISH)}|(?i)\d[ap]\.?m|\d{{4,}}|[ \t]{{2,}}|[ \t][,.;:!?]|[ap]\.m\.", itn)


def spoken_punctuation(c: Column) -> Column:
    """Of a text without a command, and with single blanks only, nothing changes."""
    return _behind(c, _COMMANDED, punctuation)

"""Clean-up of recognised text as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rx import B0, B1, S, word

# fixed values
FILLERS = "um uh uhh umm ummm ah ahh er erm em hmm hm huh mhm mm".split()
DOUBLES = "the a an and or but of to in on at for with from into onto i my your our their".split()
NOT_FRAGMENTS = """a an as at be by do go he i if in is it me my no of on or so to up us we
all and any are but can for get had has her him his how its let may new not now off old
one our out own put say see she the too top try two use was way who why yes yet you""".split()

_P = "[A-Za-z0-9']"
#: "$1$3": a phrase said twice; kept where its first word starts a third time.
RESTART = f"(?i){B0}(({_P}+)(?: {_P}+){{1,5}})(?:( \\1{B1})(?={S}+\\2(?!{_P}))| \\1{B1})"
#: "$1$4$6": a syllable before the word that it starts; real short words are put back.
FALSE_START = f"(?i){B0}(?:((({'|'.join(w for w in NOT_FRAGMENTS if len(w) > 1)})){S}+(\\3[a-zA-Z]+))|([a-zA-Z]{{2,3}}){S}+(\\5[a-zA-Z]+)){B1}"


def _each(c: Column, *rules: tuple[str, str]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


def remove_fillers(c: Column) -> Column:
    return F.regexp_replace(c, f"(?i){B0}(?:{'|'.join(FILLERS)}){B1}[,;]?{S}*", "")


def collapse_stutters(c: Column) -> Column:
    return F.regexp_replace(c, f"(?i){B0}([A-Za-z0-9_]{{1,3}})-(?:\\1-)*\\1{B1}", "$1")


def drop_false_starts(c: Column) -> Column:
    return F.regexp_replace(c, FALSE_START, "$1$6")


def collapse_restarts(c: Column) -> Column:
    return F.regexp_replace(c, RESTART, "$1$3")


def collapse_doubled_words(c: Column) -> Column:
    return F.regexp_replace(c, f"(?i){B0}({'|'.join(DOUBLES)}){S}+\\1{B1}", "$1")


def tidy_punctuation(c: Column) -> Column:
    return _each(c, (r"\.{3,}", "…"), (f"{S}*,{S}*,", ","), (rf"{S}*\.{S}*\.", "."), (rf",{S}*\.", "."), (rf"\.{S}*,", "."),
                 (f"{S}+([.,;:!?…])", "$1"), (f"([.,;:!?…]){S}*(?=[A-Z])", "$1 "), ("…", "..."))


def trim_space(c: Column) -> Column:
    return _each(c, (f"^{S}+|{S}+$", ""))


#: Letters whose capital in full case mapping is several letters, but which have one of their own: ß, and Greek ones with an iota.
_OWN_LOW = "ß" + "".join(map(chr, (*range(0x1F80, 0x1F88), *range(0x1F90, 0x1F98), *range(0x1FA0, 0x1FA8), 0x1FB3, 0x1FC3, 0x1FF3)))
_OWN_CAPITAL = "ẞ" + "".join(map(chr, (*range(0x1F88, 0x1F90), *range(0x1F98, 0x1FA0), *range(0x1FA8, 0x1FB0), 0x1FBC, 0x1FCC, 0x1FFC)))


def capital(c: Column) -> Column:
    """One letter's capital, which is one letter; a letter that has none (such as a ligature) stays."""
    up = F.upper(c)
    return F.when(F.length(up) == 1, up).otherwise(F.translate(c, _OWN_LOW, _OWN_CAPITAL))


def finalize_text(c: Column) -> Column:
    t = trim_space(F.regexp_replace(c, f"{S}{{2,}}", " "))
    # by way of an array, so that the chain before this is evaluated once
    return F.get(F.transform(F.array(t), lambda x: F.concat(capital(F.substring(x, 1, 1)), F.substring(x, 2, 2**31 - 1))), F.lit(0))


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"[^\s   -     　﻿]")


def clean_before_dictionary(c: Column) -> Column:
    rules = (remove_fillers, collapse_stutters, drop_false_starts, collapse_restarts, collapse_doubled_words, tidy_punctuation)
    return reduce(lambda x, f: f(x), rules, c)


def clean_transcript(c: Column, dictionary=None) -> Column:
    """All rules in order; a blank text is returned as it is.

    dictionary: a Column function (see operators.dictionary.dictionary_udf) that runs
    between the punctuation and the final step.
    """
    t = clean_before_dictionary(c)
    return F.when(is_blank(c), c).otherwise(finalize_text(dictionary(t) if dictionary else t))


def itn_punctuation(c: Column) -> Column:
    """Spoken marks, brackets, quotes and breaks."""
    breaks = [(word("new paragraph") + r"[ \t]*[.,;:!?]*", "\n\n"), (word("new ?line") + r"[ \t]*[.,;:!?]*", "\n")]
    marks = [(word("full stop"), "."), (word("question mark"), "?"), (word("exclamation (?:mark|point)"), "!"), (word("semi ?colon"), ";"),
             (word("comma"), ","), (word("period"), "."), (word("colon"), ":"), (word("open paren(?:thesis)?"), "("), (word("close paren(?:thesis)?"), ")"),
             (word("open quote"), "\x01"), (word("close quote"), "\x02"), (word("hyphen|dash"), "-")]
    spaces = [(r"[ \t]+([,.;:!?])", "$1"), (rf"\({S}+", "("), (rf"{S}+\)", ")"), ("\x01[ \t]+", '"'), ("[ \t]+\x02", '"'), ("[\x01\x02]", '"'),
              (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n")]
    return _each(c, *breaks, *marks, *spaces)


def has_speech(c: Column) -> Column:
    return c.rlike(r"[\p{L}\p{N}]")


def generate_variants(c: Column) -> Column:
    """Spellings of a term, in order, without the term itself."""
    low, up = F.lower(c), F.upper(c)
    spaced, solid = F.regexp_replace(c, "-", " "), F.regexp_replace(c, r"[\s-]", "")
    # a letter is upper-cased where it starts an ASCII word
    chars = F.split(low, "")
    title = F.array_join(F.transform(chars, lambda x, i: F.when((i == 0) | ~F.get(chars, i - 1).rlike("[A-Za-z0-9_]"), F.upper(x)).otherwise(x)), "")
    words = F.split(low, r"[\s-]+")
    n = F.size(words)
    join = lambda a: F.when(c.contains("-"), F.array_join(a, "-")).otherwise(F.array_join(a, " "))
    first, tail, head, last = F.get(words, F.lit(0)), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.get(words, n - 1)
    capital = F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, 2, 2**31 - 1))
    mixed = F.array(join(F.concat(F.array(F.upper(first)), tail)), join(F.concat(F.array(capital), tail)), join(F.concat(head, F.array(F.upper(last)))))
    long = F.array(join(F.concat(F.transform(head, F.upper), F.array(last))))
    basic = F.array(low, up, spaced, F.regexp_replace(c, r"\s", "-"), F.lower(solid), F.upper(solid), spaced, title)
    none = F.array().cast("array<string>")
    every = F.concat(basic, F.when(n >= 2, mixed).otherwise(none), F.when(n >= 3, long).otherwise(none))
    return F.array_remove(F.array_distinct(every), c)

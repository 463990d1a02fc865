"""Spoken sentences made from the numbers of the driver tables, for round trips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import spoken

_SMALL = list(spoken.SMALL)
_TENS = ["", "", *spoken.TENS]
_ORD = ["", *(w for w, n in spoken.ORDINALS.items() if n < 20)]
_TENTHS = ["", "", *(w for w, n in spoken.ORDINALS.items() if n >= 20)]


def _pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (n + 1).cast("int"))


def _below_100(n: Column) -> Column:
    ten, one = F.floor(n / 10), n % 10
    return F.when(n < 20, _pick(_SMALL, F.least(n, F.lit(19)))).when(one == 0, _pick(_TENS, ten)).otherwise(F.concat_ws(" ", _pick(_TENS, ten), _pick(_SMALL, one)))


def _below_1000(n: Column) -> Column:
    h, r = F.floor(n / 100), n % 100
    return F.when(h == 0, _below_100(r)).otherwise(F.concat(_pick(_SMALL, h), F.lit(" hundred"), F.when(r > 0, F.concat(F.lit(" and "), _below_100(r))).otherwise("")))


def words(n: Column) -> Column:
    """Number words of 0 to 999,999."""
    n = n.cast("long")
    t, r = F.floor(n / 1000), n % 1000
    return F.when(t == 0, _below_1000(r)).otherwise(F.concat(_below_1000(t), F.lit(" thousand"), F.when(r > 0, F.concat(F.lit(" "), _below_1000(r))).otherwise("")))


def ordinal(n: Column) -> Column:
    """Ordinal words of 1 to 99."""
    n = n.cast("long")
    return F.when(n < 20, _pick(_ORD, F.least(n, F.lit(19)))).when(n % 10 == 0, _pick(_TENTHS, F.floor(n / 10))).otherwise(F.concat_ws(" ", _pick(_TENS, F.floor(n / 10)), _pick(_ORD, n % 10)))

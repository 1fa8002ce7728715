"""English number words -> digits ("three hundred and twenty-one oak" -> "321 oak").

Off by default in address normalization. A fold over the words of the string with built-in
functions; only strings that hold a number word are folded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: number words
UNITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
         "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
SCALES = {"thousand": 1_000, "million": 1_000_000}

HUNDRED = "hundred"
START = "struct(cast(array() as array<string>) as out, 0L as total, 0L as current, '' as last, false as held)"


def _table(values: dict[str, int | str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


_VALUES = {w: i for i, w in enumerate(UNITS)} | {w: 20 + 10 * i for i, w in enumerate(TENS)} | SCALES
_KINDS = dict.fromkeys(UNITS, "unit") | dict.fromkeys(TENS, "tens") | dict.fromkeys(SCALES, "scale") | {HUNDRED: HUNDRED}


def _step(state: Column, word: Column) -> Column:
    """The state after one more word.

    ``last`` is the kind of the number word before ('' outside a number), ``held`` an "and" after
    hundreds or thousands that belongs to the number only if units or tens follow.
    """
    out, total, current, last, held = (state[n] for n in ("out", "total", "current", "last", "held"))
    value, kind = F.coalesce(_table(_VALUES)[word], F.lit(0)).cast("bigint"), F.coalesce(_table(_KINDS)[word], F.lit(""))
    inside, small = last != "", kind.isin("unit", "tens")
    holds = (word == "and") & last.isin(HUNDRED, "scale") & ~held
    # a unit goes on after tens, tens and units after hundreds and scales
    goes_on = inside & F.when(small, last.isin(HUNDRED, "scale") | ((last == "tens") & (kind == "unit") & value.between(1, 9))).otherwise(
        kind.isin(HUNDRED, "scale") & ~held)
    starts = small & ~goes_on
    closed = F.concat(out, F.when(inside, F.array((total + current).cast("string"))).otherwise(F.array().cast("array<string>")),
                      F.when(held, F.array(F.lit("and"))).otherwise(F.array().cast("array<string>")))
    at_least = F.greatest(current, F.lit(1).cast("bigint"))
    new_total = F.when(goes_on & (kind == "scale"), total + at_least * value).when(goes_on | holds, total).otherwise(F.lit(0).cast("bigint"))
    new_current = (F.when(goes_on & small, current + value).when(goes_on & (kind == HUNDRED), at_least * 100)
                   .when(holds, current).when(starts, value).otherwise(F.lit(0).cast("bigint")))
    new_out = F.when(goes_on | holds, out).when(starts, closed).otherwise(F.concat(closed, F.array(word)))
    return F.struct(new_out.alias("out"), new_total.alias("total"), new_current.alias("current"),
                    F.when(goes_on | starts, kind).when(holds, last).otherwise("").alias("last"), holds.alias("held"))


def words_to_digits(c: Column) -> Column:
    """Number words of a lower-case string as digits; other strings as they are."""
    # "twenty-one" is two words
    apart = F.regexp_replace(c, rf"\b({'|'.join(TENS)})-({'|'.join(UNITS[1:10])})\b", "$1 $2")
    # a last empty word closes an open number
    words = F.concat(F.split(F.trim(apart), r"\s+"), F.array(F.lit("")))
    folded = F.aggregate(words, F.expr(START), _step, lambda s: F.trim(F.array_join(s["out"], " ")))
    return F.when(c.rlike(rf"\b({'|'.join(UNITS + TENS)})\b"), folded).otherwise(c)

"""Reading raw cells: a number, a marker, or both, into value, flag and whether the value is kept.

A cell is an optional number followed by an optional marker. Blank means missing. A bare
number is valid. A known marker gives its flag; with a number before it the number is kept
(`value_retained`), so that later analyses can see what was rejected. A number with an
unknown marker is unparseable and has no value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING, VALID, UNPARSEABLE, NO_RAIN = "missing", "valid", "unparseable", "no_rain"
OUT_OF_RANGE = "out_of_range"

# The archives' markers and the flags they stand for, flags that rules give, and a number's form.
INVALIDATIONS = {"#": "instrument_check_invalid", "*": "program_check_invalid", "x": "manual_check_invalid", "X": "manual_check_invalid"}
NOTES = {"NR": NO_RAIN, "nr": NO_RAIN, "A": "rain_present", "NA": "not_applicable", "na": "not_applicable", "ND": "below_detection_limit", "nd": "below_detection_limit"}
ODDS = {"N/A": "not_applicable", "-": MISSING, "--": MISSING}
RULED = ("calm", "variable_direction", "instrument_fault", OUT_OF_RANGE)
_NUMBER = r"^(-?(?:[0-9]+\.?[0-9]*|\.[0-9]+))"

#: Every marker; where a note and an invalidation stand together, the invalidation counts.
MARKERS = INVALIDATIONS | NOTES | ODDS | {pair: INVALIDATIONS[i] for n in NOTES for i in INVALIDATIONS for pair in (n + i, i + n)}
#: Every flag that a reading may have.
FLAGS = sorted({VALID, MISSING, UNPARSEABLE, *MARKERS.values(), *RULED})


def mapping(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def parse_cell(raw: Column | str, markers: dict[str, str] | None = None) -> Column:
    """struct(value double, flag string, value_retained boolean) of a raw text cell."""
    text = F.trim(F.coalesce(F.col(raw) if isinstance(raw, str) else raw, F.lit("")))
    number = F.nullif(F.regexp_extract(text, _NUMBER, 1), F.lit(""))
    marker = F.trim(F.regexp_replace(text, _NUMBER, ""))
    known = F.try_element_at(mapping(MARKERS if markers is None else markers), marker)
    flag = F.when(text == "", F.lit(MISSING)).when(marker == "", F.lit(VALID)).otherwise(F.coalesce(known, F.lit(UNPARSEABLE)))
    keep = number.isNotNull() & (flag != UNPARSEABLE)
    return F.struct(F.when(keep, number.try_cast("double")).alias("value"), flag.alias("flag"), (keep & (flag != VALID)).alias("value_retained"))


def usable(value: Column, flag: Column) -> Column:
    """Whether a reading counts: valid, or no rain, with a value."""
    return flag.isin(VALID, NO_RAIN) & value.isNotNull()

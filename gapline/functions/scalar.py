"""Row-wise clean-up and derivation as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------- numbers
def nan_to_null(col) -> Column:
    col = _c(col)
    return F.when(~F.isnan(col), col)


def lenient_double(col) -> Column:
    """Numeric text or null; NaN is missing."""
    return nan_to_null(F.trim(_c(col).cast("string")).try_cast("double"))


def strict_double(col) -> Column:
    """Numeric text; anything else raises under ANSI."""
    return nan_to_null(_c(col).cast("double"))


def matrix_float(col) -> Column:
    """Model-matrix cell: infinite and non-numeric values become null, float precision."""
    x = _c(col).cast("string").try_cast("double")
    inf = F.lit(float("inf"))
    return F.when(~F.isnan(x) & (x < inf) & (x > -inf), x).cast("float")


def positive_flag(col) -> Column:
    """1 where the number is above zero; missing counts as 0."""
    return (F.coalesce(lenient_double(col), F.lit(0.0)) > 0).cast("int")


def zero_flag(col) -> Column:
    return (F.coalesce(lenient_double(col), F.lit(0.0)) == 0).cast("int")


def within(col, bounds: tuple[float, float] | None) -> Column:
    """The value inside closed bounds, else null."""
    col = _c(col)
    return col if bounds is None else F.when(col.between(F.lit(float(bounds[0])), F.lit(float(bounds[1]))), col)


def clip(col, low: float, high: float) -> Column:
    # least and greatest skip nulls
    col = _c(col)
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(float(low))), F.lit(float(high))))


# ---------------------------------------------------------------- derived signals
def mean_pressure(sys, dia) -> Column:
    return _c(dia) + (_c(sys) - _c(dia)) / F.lit(3.0)


def shock_index(pulse, sys) -> Column:
    return F.when(_c(sys) != 0, F.try_divide(_c(pulse), _c(sys)))


def pulse_pressure(sys, dia) -> Column:
    return _c(sys) - _c(dia)


def body_mass_index(weight, height_cm) -> Column:
    metres = _c(height_cm) / F.lit(100.0)
    return F.try_divide(_c(weight), metres * metres)


# ---------------------------------------------------------------- text
def safe_name(text) -> Column:
    """A plain column name: other characters to `_`, no repeats or edges, 80 long, else `unknown`."""
    text = F.trim(_c(text).cast("string"))
    text = F.regexp_replace(text, r"[^0-9A-Za-z_+]+", "_")
    text = F.regexp_replace(text, r"_+", "_")
    text = F.regexp_replace(text, r"^_|_$", "")
    text = F.substring(text, 1, 80)
    return F.coalesce(F.when(text != "", text), F.lit("unknown"))


def signed_hms(seconds) -> Column:
    """`[-]HH:MM:SS.s` of a signed number of seconds."""
    seconds = _c(seconds)
    size = F.abs(seconds)
    hours = F.floor(size / 3600)
    rest = size - hours * 3600
    minutes = F.floor(rest / 60)
    tail = F.bround(rest - minutes * 60, 1)
    sign = F.when(seconds < 0, F.lit("-")).otherwise(F.lit(""))
    shown = F.format_string("%s%02d:%02d:%04.1f", sign, hours, minutes, tail)
    return F.when(seconds.isNotNull(), shown)


def once(value: Column, use) -> Column:
    """`use(value)` with the value evaluated a single time per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def duration_minutes(text) -> Column:
    """`H:M:S`, `H:M`, `M:S` (first part 24 or more, second below 60) or a bare number, in minutes."""
    text = F.replace(F.trim(_c(text).cast("string")), F.lit(","), F.lit("."))
    numbers = F.transform(F.split(text, ":"), lambda part: F.trim(part).try_cast("double"))

    def minutes(parts: Column) -> Column:
        a, b, c = (F.get(parts, F.lit(i)) for i in range(3))
        pair = F.when((a >= 24) & (b < 60), a + b / 60).when(a.isNotNull(), a * 60 + b)
        return F.when(F.size(parts) == 3, a * 60 + b + c / 60).when(F.size(parts) == 2, pair).when(F.size(parts) == 1, a)

    return once(numbers, minutes)


def stage_minutes(hours, begin=None, end=None) -> Column:
    """Hours first; otherwise the span between two durations (the end itself when it is smaller)."""
    value = _c(hours) * 60
    if begin is None or end is None:
        return value
    # null unless both are known
    span = once(F.struct(_c(begin).alias("b"), _c(end).alias("e")),
                lambda x: F.when(x["e"] >= x["b"], x["e"] - x["b"]).when(x["b"].isNotNull(), x["e"]))
    return F.coalesce(value, span)


def first_match(text, rules: Sequence[tuple[str, Sequence[Sequence[str]]]]) -> Column:
    """Name of the first rule with an alternative whose words all occur in the upper-cased text."""
    text = F.upper(_c(text).cast("string"))
    result = F.lit(None).cast("string")
    for name, alternatives in reversed(list(rules)):
        hit = F.lit(False)
        for words in alternatives:
            every = F.lit(True)
            for word in words:
                every = every & F.contains(text, F.lit(word))
            hit = hit | every
        result = F.when(hit, F.lit(name)).otherwise(result)
    return result


def contains_any(text, words: Sequence[str]) -> Column:
    """1 where the lower-cased text holds one of the words, else 0."""
    text = F.lower(F.coalesce(_c(text).cast("string"), F.lit("")))
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit.cast("int")


def translate(col, names: Mapping[str, str]) -> Column:
    """Dictionary lookup; a value without an entry passes through."""
    col = _c(col)
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), col) if pairs else col


def gender_code(text) -> Column:
    """0 female, 1 male, else null."""
    text = F.lower(F.trim(_c(text).cast("string")))
    return (
        F.when((text == "0") | F.startswith(text, F.lit("f")), 0.0)
        .when((text == "1") | F.startswith(text, F.lit("m")), 1.0)
        .when(F.contains(text, F.lit("נקבה")), 0.0)
        .when(F.contains(text, F.lit("זכר")), 1.0)
    )


def pose_text(text) -> Column:
    text = F.lower(F.trim(F.coalesce(_c(text).cast("string"), F.lit(""))))
    return F.btrim(text, F.lit(" .,:;!?"))


def yes_no(text, yes: str, no: str) -> Column:
    text = _c(text)
    return F.when(text == yes, 1).when(text == no, 0)


def composite_key(*cols, sep: str = "|") -> Column:
    return F.concat_ws(sep, *[_c(c).cast("string") for c in cols])


def hash_rank(seed, *cols) -> Column:
    """A text that orders rows at random but the same way in every run and engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(c).cast("string") for c in cols]))

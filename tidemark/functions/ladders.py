"""Ordered values, dates and small arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import constants as K


def rank_of(value: Column, ladder: tuple[str, ...]) -> Column:
    """Place of a value on a ladder, from 0; null if it isn't there."""
    at = F.array_position(F.array(*[F.lit(x) for x in ladder]), value)
    return F.when(at > 0, (at - 1).cast("int"))


def bumped(severity: Column, steps: Column | int) -> Column:
    """A severity moved by steps and kept on the ladder."""
    steps = F.lit(steps) if isinstance(steps, int) else steps
    at = F.least(F.lit(5), F.greatest(F.lit(1), rank_of(severity, K.SEVERITIES) + 1 + steps)).cast("int")
    return F.element_at(F.array(*[F.lit(x) for x in K.SEVERITIES]), at)


def lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def named(rank: Column) -> Column:
    """The severity of a rank, moved onto the ladder if beyond its ends."""
    at = (F.least(F.lit(len(K.SEVERITIES) - 1), F.greatest(F.lit(0), rank)) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(x) for x in K.SEVERITIES]), at)


def severity_rank(signal: Column, tier: Column, radius: Column) -> Column:
    """Rank of a signal's base severity, up a step for critical things with reach, down one for mere mentions; on the ladder."""
    base = lookup({k: K.SEVERITIES.index(v[2]) for k, v in K.SIGNALS.items()}, signal)
    step = F.when((tier == "critical") & (radius >= 8), 1).when((tier == "mention-only") | (radius <= 1), -1).otherwise(0)
    return F.least(F.lit(len(K.SEVERITIES) - 1), F.greatest(F.lit(0), base + step))


def severity(signal: Column, tier: Column, radius: Column) -> Column:
    return named(severity_rank(signal, tier, radius))


def retirement_rank(rank: Column, executing: Column, graded: Column) -> Column:
    """Rank for a retired model id: critical where it is run, high where it is asked about, else a step below the usual rank."""
    return F.when(executing > 0, 4).when(graded > 0, 3).otherwise(F.greatest(F.lit(0), rank - 1))


def retirement_severity(signal: Column, tier: Column, radius: Column, executing: Column, graded: Column) -> Column:
    return named(retirement_rank(severity_rank(signal, tier, radius), executing, graded))


def shutdown_date(raw: Column) -> Column:
    """A date in one of the forms vendors write, or an ISO date within the text; null otherwise."""
    text = F.trim(raw)
    forms = [F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in ("M/d/yy", "M/d/yyyy", "yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy")]
    return F.coalesce(*forms, F.to_date(F.try_to_timestamp(F.regexp_extract(text, r"(20\d{2}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd"))))


def days_since(moment: Column, now: Column) -> Column:
    """Whole days between two moments, rounded down."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(moment)) / 86400).cast("int")


def due_date(severity_: Column, today: Column) -> Column:
    return F.date_add(today, lookup(K.DUE_DAYS, severity_))


def clamped(value: Column) -> Column:
    """A factor within 0 and 1; null for what is no number."""
    number = value.cast("double") if not isinstance(value, str) else F.col(value)
    return F.when(number.isNotNull() & ~F.isnan(number), F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)))


#: A factor as a decimal; further places are rounded.
_FACTOR = "decimal(11,10)"


def fit_score(factors: dict[str, Column]) -> Column:
    """Weighted mean of the known factors, weights renormalised; null with fewer than three, or without the central one.

    The mean is taken in decimals, so that one halfway between two thousandths is rounded up whatever the order of the sums.
    """
    known = {k: clamped(v).cast(_FACTOR) for k, v in factors.items()}
    count = sum((v.isNotNull().cast("int") for v in known.values()), F.lit(0))
    weights = {k: F.lit(K.FIT_WEIGHTS[k]).cast("decimal(4,2)") for k in known}
    total = sum((F.when(v.isNotNull(), weights[k]).otherwise(0) for k, v in known.items()), F.lit(0))
    mass = sum((F.coalesce(v * weights[k], F.lit(0)) for k, v in known.items()), F.lit(0))
    return F.when((count >= K.FIT_LEAST_KNOWN) & known["does_taught_job"].isNotNull(), F.round(mass / total, 3).cast("double"))


def session_numbers(spec: Column) -> Column:
    """Array of the session numbers of a spec like ``3,5,9-11``; null where a part can't be read."""
    parts = F.filter(F.split(spec, ","), lambda p: F.trim(p) != "")
    whole = F.forall(parts, lambda p: p.rlike(r"^\s*\d+\s*(-\s*\d+\s*)?$"))
    low = lambda p: F.regexp_extract(p, r"(\d+)", 1).try_cast("int")
    high = lambda p: F.coalesce(F.regexp_extract(p, r"-\s*(\d+)", 1).try_cast("int"), low(p))
    ranges = F.transform(F.filter(parts, lambda p: p.rlike(r"\d")), lambda p: F.sequence(F.least(low(p), high(p)), F.greatest(low(p), high(p))))
    return F.when(whole, F.array_sort(F.array_distinct(F.flatten(ranges))))


def compacted(numbers: Column) -> Column:
    """The shortest spec of a sorted distinct array of numbers: ranges and single numbers."""
    first = F.filter(numbers, lambda n: ~F.array_contains(numbers, n - 1))
    last = F.filter(numbers, lambda n: ~F.array_contains(numbers, n + 1))
    text = F.zip_with(first, last, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("-"), b.cast("string"))))
    return F.array_join(text, ",")

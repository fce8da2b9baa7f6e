"""Column expressions that turn the many written shapes of a time into wall-clock parts, stated zones and instants.

All arithmetic is on microseconds since 1970, so nothing depends on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.runtime import stage

# Abbreviations of the zones in use, in minutes east of Greenwich.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "EAT": 180,
    "NST": -210, "NDT": -150, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "NZST": 720, "NZDT": 780, "JST": 540, "IST": 330, "NPT": 345,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_ZONE = r"(?:\s*(\[?[A-Za-z]+(?:/[A-Za-z_+\-0-9]+)*\]?|[+-]\d{2}(?::?\d{2})?))?"
#: pattern, replacement by year|month|day|hour|minute|second|fraction|half of the day|zone
_SHAPES = [
    (rf"^(\d{{4}})[-:/](\d{{1,2}})[-:/](\d{{1,2}})(?:[Tt]|\s+){_CLOCK}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt_ ](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?(?:[Tt]|\s+){_CLOCK}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})\s+([A-Za-z]{{3}})[a-z]*\.?,?\s+(\d{{4}}),?\s+{_CLOCK}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    (rf"^([A-Za-z]{{3}})[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_CLOCK}\s*([AaPp][Mm])?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
]
_EPOCH = r"^\d{1,12}(?:\.\d+)?$"
_EPOCH_MS = r"^\d{13}$"


def known_zones(spark: SparkSession) -> list[str]:
    """IANA names that the JVM can convert; about 600, fixed by the time zone database."""
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def is_known_zone(spark: SparkSession, column: str) -> Column:
    return F.expr(f"{column} IN ({', '.join(repr(z) for z in known_zones(spark))})")


def _micros(fraction: Column) -> Column:
    return F.rpad(F.substring(F.coalesce(fraction, F.lit("")), 1, 6), 6, "0").cast("bigint")


def read_times(df: DataFrame, text: str) -> DataFrame:
    """``df`` with what the column ``text`` says by itself, null where it does not say it.

    epoch_us: the instant of a bare number. wall_us: the wall clock, counted as if it were UTC. zone_text: the zone as
    written, '' if none is. Dates without a time of day and impossible dates give nulls in all three. The steps are
    separate projections so that each pattern is matched once.
    """
    t, p, c = F.col("_t"), F.col("_p"), F.col
    numbers = lambda x: F.when(x.rlike(r"^\d+$"), x).cast("int")
    months = F.create_map(*(x for k, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(k + 1))))
    hour = p[3].cast("int")
    staged = stage(df, _t=F.trim(c(text)))
    staged = stage(staged, _s=F.coalesce(*(F.when(t.rlike(shape), F.regexp_replace(t, shape, to)) for shape, to in _SHAPES)))
    staged = stage(staged, _p=F.split("_s", r"\|"))
    staged = stage(
        staged,
        _m=F.coalesce(F.try_element_at(months, F.lower(p[1])), numbers(p[1])),
        _h=F.when(p[7] == "", F.when(hour < 24, hour)).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(F.upper(p[7]) == "PM", 12).otherwise(0)),
        _i=numbers(p[4]),
        _c=F.when(p[5] == "", 0).otherwise(numbers(p[5])),
    )
    staged = stage(staged, _d=F.concat_ws("-", p[0], F.lpad(c("_m").cast("string"), 2, "0"), F.lpad(p[2], 2, "0")).try_cast("date"))
    wall = ((F.unix_date("_d").cast("bigint") * 24 + c("_h")) * 60 + c("_i")) * F.lit(60_000_000).cast("bigint") + c("_c").cast("bigint") * 1_000_000
    number = F.when(t.rlike(_EPOCH), F.split(t, r"\.")[0]).cast("bigint") * 1_000_000 + _micros(F.get(F.split(t, r"\."), F.lit(1)))
    staged = stage(
        staged,
        epoch_us=F.when(t.rlike(_EPOCH), number).when(t.rlike(_EPOCH_MS), F.when(t.rlike(_EPOCH_MS), t).cast("bigint") * 1000),
        wall_us=F.when((c("_i") < 60) & (c("_c") < 60) & c("_d").isNotNull() & p.isNotNull(), wall + _micros(p[6])),
    )
    staged = stage(staged, zone_text=F.when(c("wall_us").isNotNull(), F.regexp_replace(p[8], r"[\[\]]", "")))
    return staged.drop("_t", "_s", "_p", "_m", "_d", "_h", "_i", "_c")


def offset_minutes(zone: Column) -> Column:
    """Minutes of a numeric offset or a known abbreviation; null for anything else."""
    parts = F.regexp_extract(zone, r"^([+-])(\d{2}):?(\d{2})?$", 1), F.regexp_extract(zone, r"^([+-])(\d{2}):?(\d{2})?$", 2), F.regexp_extract(zone, r"^([+-])(\d{2}):?(\d{2})?$", 3)
    hours = F.when(parts[1] != "", parts[1]).cast("int")
    minutes = F.when(parts[2] != "", parts[2]).cast("int")
    size = hours * 60 + F.coalesce(minutes, F.lit(0))
    number = F.when((hours <= 18) & (F.coalesce(minutes, F.lit(0)) < 60), F.when(parts[0] == "-", -size).otherwise(size))
    table = F.create_map(*(x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(number, F.try_element_at(table, F.upper(zone)))


def local_us(utc_us: Column, zone: Column) -> Column:
    """The wall clock that ``zone`` shows at an instant."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc_us), zone))


def with_zone_instant(df: DataFrame, wall: str, zone: str, out: str) -> DataFrame:
    """``df`` with the one instant at which ``zone`` shows ``wall``; null where the clock shows it twice or never.

    The offsets a day before and after bracket any change, so both candidate instants are known; each counts if the
    zone really shows the wall clock there.
    """
    day, w, z = 86_400_000_000, F.col(wall), F.col(zone)
    staged = stage(df, _early=F.when(z.isNotNull(), w - (local_us(w - day, z) - (w - day))), _late=F.when(z.isNotNull(), w - (local_us(w + day, z) - (w + day))))
    early, late = F.col("_early"), F.col("_late")
    staged = stage(staged, _a=local_us(early, z) == w, _b=F.when(early != late, local_us(late, z) == w))
    a, b = F.col("_a"), F.col("_b")
    return stage(staged, **{out: F.when(early == late, F.when(a, early)).when(a & ~b, early).when(b & ~a, late)}).drop("_early", "_late", "_a", "_b")


def zone_offset_us(wall_us: Column, zone: Column) -> Column:
    """The offset in force in ``zone`` around a wall clock (the later one at a change)."""
    return local_us(wall_us, zone) - wall_us

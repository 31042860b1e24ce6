"""Timestamps in any form, precision and zone to one UTC instant.

All formats are compiled into one regular expression, an alternation with named groups. One
``regexp_replace`` rewrites a value into its components, which are then checked against the
calendar and put together by integer day arithmetic. Nothing leaves the JVM.

Defined results
* null, blank, unreadable text and impossible dates or times (month 13, 30 February, hour 25,
  year 0, second 60) give null;
* fractions finer than a microsecond are cut off;
* no time of day: noon; no day: noon of the 15th; no month: noon of 1 July;
* a zone or offset in the value wins, then ``zone``, then ``fallback_zone``; with none of them a
  wall-clock value has no instant and gives null; epoch numbers need no zone;
* in a repeated hour the earlier instant is taken, a skipped time moves forward by the gap;
* ``nn/nn/nnnn`` follows ``date_order`` (``mdy`` or, else, ``dmy``), ``nn.nn.nnnn`` is day first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# English month names and the zone abbreviations that stand for one offset.
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0,
    "bst": 3600, "cet": 3600, "west": 3600, "cest": 7200, "eet": 7200, "eest": 10800, "msk": 10800,
    "ndt": -9000, "nst": -12600, "adt": -10800, "ast": -14400, "edt": -14400, "est": -18000,
    "cdt": -18000, "cst": -21600, "mdt": -21600, "mst": -25200, "pdt": -25200, "pst": -28800,
    "akdt": -28800, "akst": -32400, "hst": -36000,
    "jst": 32400, "kst": 32400, "acst": 34200, "acdt": 37800, "aest": 36000, "aedt": 39600,
    "awst": 28800, "nzst": 43200, "nzdt": 46800,
}

#: Characters stripped from both ends: white space of any script, controls and NUL.
STRIP = r"^[\s\x00-\x1f\x85\p{Z}\x{feff}]+|[\s\x00-\x1f\x85\p{Z}\x{feff}]+$"

_SEP = "\x01"
_FIELDS = ("y", "n", "x", "w", "d", "h", "i", "s", "f", "a", "z", "e", "g")
# y year, n month number, x and w the two numbers of a slashed date, d day, h hour, i minute,
# s second, f fraction, a AM/PM, z zone, e epoch digits, g epoch fraction.


@dataclass(frozen=True)
class Format:
    """One way of writing a time; ``{y}`` and so on stand for the named groups."""

    name: str
    pattern: str


_TIME = r"{h:\d{1,2}}[:.\-]{i:\d{2}}(?:[:.\-]{s:\d{2}}(?:[.,]{f:\d{1,12}})?)?"
_AMPM = r"(?:[\s\p{Z}]*{a:[AaPp]\.?[Mm]\.?}(?![A-Za-z]))?"
_ZONE = r"(?:[\s\p{Z}]*{z:[A-Za-z]{1,5}|[+\-]\d{2}:?\d{2}|[+\-]\d{2}})?"
_SPACE = r"[\s\p{Z}]+"
_MONTH = "{n:" + "|".join(f"{m}|{m[:3]}" for m in reversed(MONTHS)) + "|sept}"
_DAY_NAME = r"(?:[A-Za-z]{2,9}\.?,?[\s\p{Z}]+)?"

FORMATS = (
    Format("year first", r"{y:\d{4}}[-:/.]{n:\d{1,2}}[-:/.]{d:\d{1,2}}(?:(?:T|[\s\p{Z}]+|[-_])" + _TIME + _AMPM + _ZONE + ")?"),
    Format("compact", r"{y:\d{4}}{n:\d{2}}{d:\d{2}}(?:[T_\-\s]?{h:\d{2}}{i:\d{2}}{s:\d{2}}(?:\.{f:\d{1,12}})?" + _ZONE + ")?"),
    Format("month", r"{y:\d{4}}[-:/.]{n:\d{1,2}}"),
    Format("year", r"{y:\d{4}}"),
    Format("slashes", r"{x:\d{1,2}}/{w:\d{1,2}}/{y:\d{4}}(?:,?" + _SPACE + _TIME + _AMPM + _ZONE + ")?"),
    Format("dots", r"{d:\d{1,2}}\.{n:\d{1,2}}\.{y:\d{4}}(?:,?" + _SPACE + _TIME + _AMPM + _ZONE + ")?"),
    Format("day and month name", _DAY_NAME + r"{d:\d{1,2}}\.?[\s\p{Z}-]+" + _MONTH + r"\.?[\s\p{Z}-]+{y:\d{4}}(?:,?" + _SPACE + _TIME + _AMPM + _ZONE + ")?"),
    Format("month name and day", _DAY_NAME + _MONTH + r"\.?" + _SPACE + r"{d:\d{1,2}},?" + _SPACE + r"{y:\d{4}}(?:,?" + _SPACE + _TIME + _AMPM + _ZONE + ")?"),
    Format("epoch", r"{e:-?(?:\d{9,10}|\d{13}|\d{16}|\d{19})}"),
    Format("epoch with fraction", r"{e:-?\d{9,10}}\.{g:\d{1,12}}"),
)


def compile_formats(formats: tuple[Format, ...] = FORMATS) -> tuple[str, str]:
    """The alternation of all formats and the replacement that lists its components.

    Java forbids using a group name twice, so the k-th alternative's groups carry the suffix k;
    the replacement names all of a component's groups, of which at most one took part.
    Epoch numbers have 9, 10, 13, 16 or 19 digits and so share no length with compact forms.
    """
    import re

    alternatives, used = [], {f: [] for f in _FIELDS}
    for k, form in enumerate(formats):

        def group(match: "re.Match[str]", k: int = k) -> str:
            used[match[1]].append(f"{match[1]}{k}")
            return f"(?<{match[1]}{k}>"

        body = re.sub(r"\{([a-z]):", group, form.pattern)
        # the closing brace of a component: the one that balances it
        out, depth, stack = [], 0, []
        i = 0
        while i < len(body):
            c = body[i]
            if body.startswith("(?<", i) and body[i + 3].isalpha():
                stack.append(depth)
            if c == "\\":
                n = i + 2
                if body[i + 1] in "px" and n < len(body) and body[n] == "{":
                    n = body.index("}", n) + 1
                out.append(body[i:n])
                i = n
                continue
            if c == "{":
                depth += 1
            elif c == "}":
                if stack and stack[-1] == depth:
                    stack.pop()
                    c = ")"
                else:
                    depth -= 1
            out.append(c)
            i += 1
        alternatives.append("".join(out))
    pattern = r"(?i)^(?:" + "|".join(f"(?:{a})" for a in alternatives) + ")$"
    replacement = _SEP + _SEP.join("".join("${" + n + "}" for n in used[f]) for f in _FIELDS)
    return pattern, replacement


def _known_zones(spark: SparkSession) -> list[str]:
    """Region names the JVM knows (about 600, a fixed set)."""
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def _literal_map(entries: dict[str, int]) -> Column:
    """A constant map, folded into one literal by the optimizer."""
    return F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])


def days_from_civil(y: str, m: str, d: str) -> str:
    """SQL for the days since 1970-01-01 of a Gregorian date (years from 1), in integers only."""
    yy = f"({y} - if({m} <= 2, 1, 0))"
    return (
        f"(365 * {yy} + {yy} div 4 - {yy} div 100 + {yy} div 400"
        f" + (153 * (({m} + 9) % 12) + 2) div 5 + {d} - 719469)"
    )


def normalise_timestamps(
    df: DataFrame,
    value: str,
    out: str,
    zone: Column | None = None,
    fallback_zone: Column | None = None,
    date_order: Column | None = None,
    readable: str | None = None,
) -> DataFrame:
    """Add ``out``: the microseconds since 1970-01-01 UTC that ``value`` names, else null.

    ``readable`` optionally names a further boolean column: the value names a real date and time,
    whether or not a zone is known. Helper columns start with ``__ts_`` and are dropped again, so
    tables with other columns of any name pass through unchanged.

    A filter on ``out`` placed straight on the result would be pushed below the stages and repeat
    them; aggregate or write first (the callers here drop repeated rows after reading the times).
    """
    pattern, replacement = compile_formats()
    none = F.lit(None).cast("string")
    zone, fallback_zone = none if zone is None else zone, none if fallback_zone is None else fallback_zone
    order = none if date_order is None else date_order
    kept = df.columns

    def stage(df: DataFrame, **columns: str | Column) -> DataFrame:
        return df.withColumns({f"__ts_{k}": F.expr(v) if isinstance(v, str) else v for k, v in columns.items()})

    at = {f: f"__ts_p[{i + 1}]" for i, f in enumerate(_FIELDS)}
    num = {f: f"__ts_v[{i + 1}]" for i, f in enumerate(_FIELDS)}
    text = F.regexp_replace(F.col(f"`{value}`"), STRIP, "")
    df = stage(
        df, zone=F.trim(zone), fall=fallback_zone, mdy=F.coalesce(F.lower(F.trim(order)) == "mdy", F.lit(False)),
        p=F.split(F.regexp_replace(text, pattern, replacement), _SEP),
    )
    df = stage(df, p=f"if(size(__ts_p) = {len(_FIELDS) + 1}, __ts_p, null)")
    df = stage(
        df, v="transform(__ts_p, x -> try_cast(nullif(x, '') AS bigint))",
        m="transform(slice(__ts_p, %d, 4), x -> try_cast(rpad(substr(nullif(x, ''), 1, 6), 6, '0') AS bigint))" % (_FIELDS.index("f") + 2),
        z=f"lower({at['z']})",
        name=F.try_element_at(_literal_map({m[:3]: k + 1 for k, m in enumerate(MONTHS)}), F.expr(f"lower(substr({at['n']}, 1, 3))")),
    )
    # __ts_m holds f, a, z and e read as fractions; g is the last component
    df = stage(
        df, y=num["y"], n=f"coalesce({num['n']}, __ts_name, if(__ts_mdy, {num['x']}, {num['w']}))",
        d=f"coalesce({num['d']}, if(__ts_mdy, {num['w']}, {num['x']}))",
        h=f"case when {at['a']} = '' then {num['h']} when {num['h']} between 1 and 12 then {num['h']} % 12 + if(lower({at['a']}) like 'p%', 12, 0)"
          f" when {num['h']} is not null then 99 end",
        i=num["i"], s=num["s"], f="__ts_m[0]", e=num["e"], el=f"length(ltrim('-', {at['e']}))",
        g=f"try_cast(rpad(substr({at['g']}, 1, 6), 6, '0') AS bigint)",
        off="try_cast(substr(replace(__ts_z, ':', ''), 2, 2) AS bigint) * 60 + coalesce(try_cast(nullif(substr(replace(__ts_z, ':', ''), 4, 2), '') AS bigint), 0)",
        abbr=F.try_element_at(_literal_map(ABBREVIATIONS), F.expr("__ts_z")),
    )
    df = stage(
        df,
        real="__ts_e is not null or coalesce(__ts_y >= 1 and coalesce(__ts_n, 1) between 1 and 12 and coalesce(__ts_d, 1) >= 1"
             " and coalesce(__ts_d, 1) <= case when __ts_n in (4, 6, 9, 11) then 30 when __ts_n = 2 then"
             " if(__ts_y % 4 = 0 and (__ts_y % 100 != 0 or __ts_y % 400 = 0), 29, 28) else 31 end"
             " and coalesce(__ts_h, 0) <= 23 and coalesce(__ts_i, 0) <= 59 and coalesce(__ts_s, 0) <= 59, false)",
        sec="if(__ts_h is null, 43200, __ts_h * 3600 + __ts_i * 60 + coalesce(__ts_s, 0))",
        mm="coalesce(__ts_n, 7)", dd="coalesce(__ts_d, if(__ts_n is null, 1, 15))",
        # minutes of an offset in the value; null where there is none or it names no zone
        off="case when __ts_z rlike '^[+-]' then if(__ts_off <= 1080 and __ts_off % 60 <= 59, if(__ts_z like '-%', -60, 60) * __ts_off, null) else __ts_abbr end",
        goff="if(__ts_zone rlike '^[+-][0-9]{2}:?[0-9]{2}$', if(__ts_zone like '-%', -60, 60)"
             " * (cast(substr(__ts_zone, 2, 2) AS bigint) * 60 + cast(right(__ts_zone, 2) AS bigint)), null)",
    )
    zones = ", ".join(f"'{z}'" for z in _known_zones(df.sparkSession))
    df = stage(
        df, local=f"if(__ts_real and __ts_y is not null, ({days_from_civil('__ts_y', '__ts_mm', '__ts_dd')} * 86400 + __ts_sec) * 1000000 + coalesce(__ts_f, 0), null)",
        region=f"case when __ts_zone in ({zones}) then __ts_zone when __ts_fall in ({zones}) then __ts_fall end",
    )
    instant = F.expr(
        "case when __ts_e is not null then case when __ts_el <= 10 then __ts_e * 1000000 + if(__ts_e < 0, -1, 1) * coalesce(__ts_g, 0)"
        " when __ts_el = 13 then __ts_e * 1000 when __ts_el = 16 then __ts_e else __ts_e div 1000 end"
        " when length(__ts_z) > 0 then __ts_local - __ts_off * 1000000"
        " when __ts_goff is not null then __ts_local - __ts_goff * 1000000"
        " else unix_micros(to_utc_timestamp(timestamp_micros(__ts_local), __ts_region)) end"
    )
    added = [instant.alias(out)]
    if readable:
        added.append(F.expr("coalesce(__ts_real and (length(__ts_z) = 0 or __ts_off is not null), false)").alias(readable))
    return df.select(*[F.col(f"`{k}`") for k in kept if k not in (out, readable)], *added)

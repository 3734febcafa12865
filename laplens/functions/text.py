"""Text clean-up, lookups and inference by pattern."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Session-type spellings and their normal form, for run logs and for file headers.
SESSION_TYPES = {
    "log": {
        "WUP": "WUP", "WUP1": "WUP", "WUP2": "WUP",
        "FP": "FP", "FP1": "FP", "FP2": "FP", "F1": "FP", "F2": "FP", "L1": "FP", "L2": "FP",
        "QP": "QP", "QP1": "QP", "QP2": "QP", "Q1": "QP", "Q2": "QP",
        "SP": "SP", "RACE1": "RACE1", "R1": "RACE1", "RACE2": "RACE2", "R2": "RACE2",
        "TEST_D1": "TEST_D1", "DAY1": "TEST_D1", "D1": "TEST_D1",
        "TEST_D2": "TEST_D2", "DAY2": "TEST_D2", "D2": "TEST_D2",
    },
    "header": {
        "FP": "FP", "F1": "FP", "F2": "FP", "QP": "QP", "Q1": "QP", "Q2": "QP",
        "WU": "WUP", "WU1": "WUP", "WU2": "WUP", "WUP": "WUP", "WUP1": "WUP", "WUP2": "WUP",
        "R1": "RACE1", "R2": "RACE2", "RACE1": "RACE1", "RACE2": "RACE2",
        "D1": "TEST_D1", "D2": "TEST_D2", "L1": "TEST_D1", "L2": "TEST_D2", "SP": "SP",
        "INLAPR1": "RACE1", "INLAPR2": "RACE2", "D0": "WARMUP", "ACCENSIONE": "WARMUP",
    },
}
# Circuit spellings per profile.
CIRCUITS = {
    "log": {"PHILLIPISLAND": "PHILLIP ISLAND", "PHI": "PHILLIP ISLAND", "AUSTRALIA": "PHILLIP ISLAND",
            "WORKSHOP": "PHILLIP ISLAND", "PHILLIP_ISLAND": "PHILLIP ISLAND"},
    "header": {"PHILLIPISLAND": "PHILLIP ISLAND", "PHILLIPISISLAND": "PHILLIP ISLAND",
               "PHI": "PHILLIP ISLAND", "AUSTRALIA": "PHILLIP ISLAND"},
}
# Session type read from a file name, first match wins.
NAME_PATTERNS = [
    (r"\bFP\b|F1\b|FREE", "FP"), (r"\bSP\b|SPRINT", "SP"), (r"\bQP\b|QUALI", "QP"),
    (r"WUP2|WU2\b", "WUP2"), (r"WUP1?|WU1\b", "WUP1"), (r"\bR1\b|RACE1|RA1", "RACE1"),
    (r"\bR2\b|RACE2|RA2", "RACE2"), (r"RACE|\bR[D]?\d", "RACE1"),
]
# Session type read from a header code, first match wins.
CODE_PATTERNS = [("L1", "FP"), ("SP", "SP"), ("Q", "QP"), ("W", "WUP1"), ("R1", "RACE1"), ("R2", "RACE2")]
# Lap-time cells that mean "no time".
NO_TIME = ["", "-", "—", "None", "P6", "P15", "DNS", "DNF", "NC"]
# Rider -> number.
RIDER_NUMBERS = {"DA77": 77, "JA52": 52}
# Texts read as true.
TRUE_TEXT = ["YES", "Y", "1", "TRUE"]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it and wherever the result is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settled(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns that are computed once a row. Filters on them stay above, so no condition computes them again."""
    row = F.struct(*[c.alias(n) for n, c in cols.items()])
    kept = [c for c in df.columns if c not in cols]
    return df.select("*", F.explode(F.array(row)).alias("_settled")).select(*[f"`{c}`" for c in kept], *[F.col("_settled")[n].alias(n) for n in cols])


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Value of a small constant table, null where absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def normal_session(*candidates: Column, profile: str = "log") -> Column:
    """First candidate the table knows, else the last non-empty candidate as it is."""
    upper = [F.upper(F.trim(c)) for c in candidates]
    known = [lookup(u, SESSION_TYPES[profile]) for u in upper]
    raw = [F.when(u != "", u) for u in reversed(upper)]
    return F.coalesce(*known, *raw)


def normal_circuit(c: Column, profile: str = "log") -> Column:
    u = F.upper(F.trim(c))
    return F.coalesce(lookup(u, CIRCUITS[profile]), u)


def normal_round(key: Column, header: Column | None = None) -> Column:
    """``R01`` / ``T3`` style keys to ``ROUND1`` / ``TEST3``; a header text is tried when the key has none."""
    def expand(c: Column) -> Column:
        u = F.upper(F.trim(c))
        kind = F.regexp_extract(u, r"^(R|T)0*(\d+)(?:[^0-9]|$)", 1)
        num = F.regexp_extract(u, r"^(R|T)0*(\d+)(?:[^0-9]|$)", 2)
        return (F.when(kind == "R", F.concat(F.lit("ROUND"), num))
                .when(kind == "T", F.concat(F.lit("TEST"), num))
                .when(u.rlike(r"^(TEST\d+|ROUND\d+|WORKSHOP)$"), u))
    if header is None:
        return F.coalesce(expand(key), F.upper(F.trim(key)))
    return F.coalesce(expand(key), expand(header), F.trim(header))


def infer_session_type(name: Column, code: Column) -> Column:
    n, k = F.upper(name), F.upper(code.cast("string"))
    out = F
    for pattern, kind in NAME_PATTERNS:
        out = out.when(n.rlike(pattern), F.lit(kind))
    for part, kind in CODE_PATTERNS:
        out = out.when(k.contains(part), F.lit(kind))
    return out.otherwise(F.lit("FP"))


def infer_rider(name: Column, number: Column, marks: dict[str, list[str]]) -> Column:
    """``marks``: rider -> texts that identify it in a name; the last of them is its number."""
    n, num = F.upper(name), F.trim(number.cast("string"))
    out = F
    for rider, texts in marks.items():
        hit = F.lit(False)
        for t in texts:
            hit = hit | n.contains(t)
        out = out.when(hit, F.lit(rider))
    for rider, texts in marks.items():
        out = out.when(num == texts[-1], F.lit(rider))
    return out.when(num != "", F.concat(F.lit("#"), num)).otherwise(F.lit("UNKNOWN"))


def rider_number(rider: Column, numbers: dict[str, int] | None = None, default: int | None = 0) -> Column:
    """Number of a rider: that of the first known one whose number the text holds, else ``default``."""
    out = F
    for number in (numbers or RIDER_NUMBERS).values():
        out = out.when(rider.contains(str(number)), F.lit(number))
    return out.otherwise(F.lit(default).cast("int"))


def rider_of_number(number: Column, numbers: dict[str, int] | None = None) -> Column:
    """Rider with that number, ``#number`` for others, null without one."""
    text = F.trim(number.cast("string"))
    known = lookup(text, {str(n): rider for rider, n in (numbers or RIDER_NUMBERS).items()})
    return F.coalesce(known, F.when(text != "", F.concat(F.lit("#"), text)))


def trailing_number(name: Column, header: Column | None = None) -> Column:
    """Digits after the last ``-`` or ``#`` (an extension may follow), else the header value, else 1."""
    found = F.regexp_extract(name, r"[-#](\d+)(?:\.[A-Za-z]+)?$", 1).try_cast("long")
    return F.coalesce(found, *([header.cast("string").try_cast("long")] if header is not None else []),
                      F.lit(1).cast("long"))


def path_event_key(path: Column, pattern: str = r"^(R\d+|T\d+|TEST\d+|WORKSHOP)(?:[^0-9A-Za-z].*)?$") -> Column:
    """Event key from the parent folder, else from the grandparent."""
    parts = F.split(path, r"[/\\]")
    hits = [F.regexp_extract(F.upper(F.coalesce(F.try_element_at(parts, F.lit(-k)), F.lit(""))), pattern, 1)
            for k in (2, 3)]
    return F.coalesce(*[F.when(h != "", h) for h in hits])


def log_circuit(text: Column) -> Column:
    r"""Circuit in a log line like ``Path for measurement: ...\R03_SOME_NAME.26\X.MES``."""
    path = F.regexp_extract(text, r"Path for measurement:\s*([^\r\n]+)", 1)
    name = F.regexp_extract(path, r"[/\\][RT]\d+_([^/\\.]+)\.\d+[/\\]", 1)
    return F.when(name != "", F.initcap(F.replace(name, F.lit("_"), F.lit(" "))))


def parse_date(c: Column, strict: bool = False) -> Column:
    """Text in the known day formats to ``yyyy-MM-dd``; other text is kept, or null when ``strict``."""
    # yy.MMdd is rewritten first, so that the day-first formats cannot claim it
    t = F.regexp_replace(F.trim(c), r"^(\d{2})\.(\d{2})(\d{2})$", "20$1-$2-$3")
    formats = ["dd/MM/yyyy", "yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy"]
    # a format is only tried on texts with its mark, since a failed attempt costs far more than a good one
    tried = lambda x: [F.when(F.contains(x, F.lit(next(m for m in "/-." if m in f))), F.try_to_date(x, f)) for f in formats]
    text = F.date_format(bound(t, lambda x: F.coalesce(*tried(x))), "yyyy-MM-dd")
    return text if strict else F.coalesce(text, c)


def lap_seconds(c: Column) -> Column:
    """``1:37.455``, ``1'38,7`` or a plain number of seconds; markers such as DNF are null.

    One replacement brings the split forms to ``minutes:seconds``; anything else must be a number.
    """
    def seconds(plain: Column) -> Column:
        first, rest = (F.split_part(plain, F.lit(":"), F.lit(i)) for i in (1, 2))
        # a colon without decimals was not a lap time, so nothing replaced it
        split = F.when(F.contains(rest, F.lit(".")), first.try_cast("double") * 60 + rest.try_cast("double"))
        return F.when(F.contains(plain, F.lit(":")), split).when(~plain.isin(NO_TIME), plain.try_cast("double"))

    # the usual form needs no replacement, which costs most
    usual = lambda x: F.substring_index(x, ":", 1).try_cast("double") * 60 + F.substring_index(x, ":", -1).try_cast("double")
    other = lambda x: bound(F.regexp_replace(x, r"^(\d+)[:'](\d+)[.,](\d+).*$", "$1:$2.$3"), seconds)
    return bound(F.trim(c), lambda x: F.round(F.when(x.rlike(r"^[0-9]+:[0-9]+\.[0-9]+$"), usual(x)).otherwise(other(x)), 3))


def lap_text(c: Column, minute_mark: str = ":", digits: int = 3, missing: str = "—") -> Column:
    """Seconds to ``M:SS.mmm``. Rounded before splitting, so ``:60.000`` cannot appear."""
    units = 10 ** digits

    def shown(ticks: Column) -> Column:
        mins = F.floor(ticks / (60 * units)).cast("long")
        rest = ticks - mins * 60 * units
        return F.concat(mins.cast("string"), F.lit(minute_mark),
                        F.lpad(F.floor(rest / units).cast("string"), 2, "0"), F.lit("."),
                        F.lpad((rest % units).cast("string"), digits, "0"))

    return F.coalesce(bound(F.round(c * units).cast("long"), shown), F.lit(missing))


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~t.isin("", "N/A", "nan", "NaN", "None"), t)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def lenient_double(c: Column, decimal_comma: bool = False) -> Column:
    """Number from text, null when unreadable. A comma groups thousands, or marks decimals."""
    return F.replace(F.trim(c), F.lit(","), F.lit("." if decimal_comma else "")).try_cast("double")


def lenient_long(c: Column) -> Column:
    return lenient_double(c).try_cast("long")


def truthy(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c.cast("string"))).isin(TRUE_TEXT), F.lit(False))


def number_before_paren(c: Column, default: float, lo: float, hi: float) -> Column:
    """``123.4 (note)`` -> 123.4; ``default`` when unreadable or outside [lo, hi]."""
    v = F.trim(F.split_part(c, F.lit("("), F.lit(1))).try_cast("double")
    return F.when(v.between(lo, hi), v).otherwise(F.lit(float(default)))


def short_number(c: Column, missing: str = "—") -> Column:
    """Two decimals with trailing zeros cut."""
    text = F.regexp_replace(F.format_string("%.2f", F.round(c, 2)), r"\.?0+$", "")
    return F.when(c.isNull(), F.lit(missing)).otherwise(text)


def tags(c: Column, separators: str = "[,;\n]+") -> Column:
    """Free text to lower-case tags."""
    return F.filter(F.transform(F.split(c, separators), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def first_of(df, names: list[str]) -> Column:
    """First non-null among those of ``names`` the frame has, matched without case."""
    have = {c.lower(): c for c in df.columns}
    found = [F.col(f"`{have[n.lower()]}`") for n in names if n.lower() in have]
    return F.coalesce(*found) if found else F.lit(None)


def headers(names: list[str | None]) -> list[str]:
    """Clean sheet headers: line breaks to spaces, blanks named by position, repeats numbered."""
    seen: dict[str, int] = {}
    out = []
    for i, raw in enumerate(names):
        name = " ".join((raw or "").replace("\n", " ").split()) or f"_col{i}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out

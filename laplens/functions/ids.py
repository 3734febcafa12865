"""Keys and labels built from column values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from laplens.functions.text import bound


def token(c: Column) -> Column:
    """Upper-case, keep only letters and digits."""
    return F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9]", "")


def token_or_unk(c: Column) -> Column:
    return bound(token(c), lambda t: F.when(t != "", t).otherwise(F.lit("UNK")))


def whole_number(c: Column, default: int) -> Column:
    """Text or number read as a double and cut to an integer; ``default`` where it cannot be read."""
    return F.coalesce(c.cast("string").try_cast("double").try_cast("long"), F.lit(default).cast("long"))


def session_id(round_: Column, circuit: Column, session: Column, rider: Column) -> Column:
    return F.concat_ws("_", *[token_or_unk(c) for c in (round_, circuit, session, rider)])


def run_id(round_: Column, circuit: Column, session: Column, rider: Column, run_no: Column) -> Column:
    return F.concat(session_id(round_, circuit, session, rider), F.lit("_R"), whole_number(run_no, 1))


def lap_id(run: Column, lap_no: Column) -> Column:
    return F.concat(run, F.lit("_L"), whole_number(lap_no, 0))


def event_id(round_: Column, circuit: Column) -> Column:
    return F.concat_ws("_", token_or_unk(round_), token_or_unk(circuit))


def split_report_id(c: Column) -> dict[str, Column]:
    """``YYYYMMDD-ROUND-RIDER`` into its date, round and rider."""
    dash = F.lit("-")
    return {
        "report_date": F.to_date(F.split_part(c, dash, F.lit(1)), "yyyyMMdd"),
        "round": F.split_part(c, dash, F.lit(2)),
        "rider": F.split_part(c, dash, F.lit(3)),
    }


def labelled(parts: dict[str, Column], sep: str = " | ") -> Column:
    """``label: value`` for every non-null value, joined."""
    return F.concat_ws(sep, *[F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), c.cast("string")))
                              for k, c in parts.items()])


def paired(a: Column, b: Column, missing: str = "-") -> Column:
    """Two columns shown as ``a/b``."""
    return F.concat_ws("/", F.coalesce(a.cast("string"), F.lit(missing)),
                       F.coalesce(b.cast("string"), F.lit(missing)))

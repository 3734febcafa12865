"""Channels by role: loggers name the same sensor differently."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of one sensor in the order in which they are preferred.
ALIASES = {
    "speed": ["SPEED_FRONT"],
    "brake": ["BRAKE_FRONT"],
    "gas": ["GAS_SMOOTH", "GAS", "TPS", "TPS_A", "SEN_TPSA1"],
    "dtps": ["DTPS_A", "DTPS", "TPS_DELTA", "DELTA_TPS"],
    "acc": ["ACC_Y"],
    "sus_f": ["SUSP_FRONT"],
    "sus_r": ["SUSP_REAR"],
    "tyre_f": ["PRESS_TYRE_F", "TYRE_PRESS_F", "TYREPRESS_F", "TYRE_F_PRESS", "PRESS_F_TYRE", "PRESSURE_TYRE_F", "TYRE_PRESSURE_F", "TPRES_F",
               "TYREPRES_F", "PRESS_FL", "TIRE_PRESS_F", "TYRE_F", "TIRE_F", "PRESS_FRONT_TYRE", "FRONT_TYRE_PRESS"],
    "tyre_r": ["PRESS_TYRE_R", "TYRE_PRESS_R", "TYREPRESS_R", "TYRE_R_PRESS", "PRESS_R_TYRE", "PRESSURE_TYRE_R", "TYRE_PRESSURE_R", "TPRES_R",
               "TYREPRES_R", "PRESS_RL", "TIRE_PRESS_R", "TYRE_R", "TIRE_R", "PRESS_REAR_TYRE", "REAR_TYRE_PRESS"],
}
# A name that holds one part of every group will do where no alias is found.
FUZZY = {
    "tyre_f": [["TYRE", "TIRE"], ["PRESS"], ["_F", "FL", "FRONT"]],
    "tyre_r": [["TYRE", "TIRE"], ["PRESS"], ["_R", "RL", "REAR"]],
}


def resolve_channels(channels: DataFrame, keys: list[str], aliases: dict[str, list[str]] | None = None,
                     fuzzy: dict[str, list[list[str]]] | None = None, channel: str = "channel") -> DataFrame:
    """(keys, role, channel): for each role the group's channel with the earliest alias, whatever its case, else the first in
    name order that fits the role's fuzzy rule. Roles without a channel have no row; one channel may play several."""
    aliases, fuzzy = (ALIASES, FUZZY) if aliases is None else (aliases, fuzzy or {})
    upper = F.upper(channel)
    fits = []
    for role in {**aliases, **fuzzy}:
        at = F.array_position(F.array(*[F.lit(a.upper()) for a in aliases.get(role, [])]), upper) if aliases.get(role) else F.lit(0).cast("long")
        near = F.lit(role in fuzzy)
        for group in fuzzy.get(role, []):
            near = near & F.greatest(*[F.contains(upper, F.lit(g)) for g in group], F.lit(False))
        fits.append(F.struct(F.lit(role).alias("role"), F.when(at > 0, at).when(near, 1000).alias("place")))
    rows = channels.select(*keys, channel, F.explode(F.array(*fits)).alias("_fit")).select(*keys, channel, "_fit.*").filter("place IS NOT NULL")
    return rows.groupBy(*keys, "role").agg(F.min_by(channel, F.struct("place", channel)).alias(channel))

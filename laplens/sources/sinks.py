"""Writing derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                rename: dict[str, str] | None = None, valid: str | None = None, dry_run: bool = False) -> dict:
    """Replace the table at ``path`` and report rows written and rows refused by ``valid``.

    With ``dry_run`` the same counts are computed and nothing is written. The counts come from the pass
    that writes, so the input is read once. ``fmt="sheet"`` writes CSV with a header line per file.
    """
    seen = Observation()
    ok = F.coalesce(F.expr(valid), F.lit(False)) if valid else F.lit(True)
    watched = df.observe(seen, F.count_if(ok).alias("written"), F.count_if(~ok).alias("failed"))
    out = watched.filter(ok)
    if rename:
        out = out.withColumnsRenamed(rename)
    if dry_run:
        out.write.format("noop").mode("overwrite").save()
    else:
        kind, options = ("csv", {"header": True}) if fmt == "sheet" else (fmt, {})
        writer = out.write.format(kind).options(**options).mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    return dict(seen.get)

"""Logger bundles: a ``X.MES`` folder with a text header, a channel catalog, a lap file and one
integer file per channel. Every step takes and returns DataFrames; files are rows (path, content).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 17  # samples handed to Spark per Arrow batch


def find_bundles(spark: SparkSession, root: str, pattern: str = "*", content: bool = True) -> DataFrame:
    """Files of all bundles under ``root`` with run name, file extension and folders. ``pattern`` limits the files that
    are opened, for example ``*.DDD`` for the catalogs; without ``content`` none is, and only the listing is read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", pattern).load(root))
    return with_parts(files.select("path", "length", *(["content"] if content else [])))


def with_parts(files: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    return files.withColumns({
        "run": F.regexp_extract("path", r"([^/]+)\.MES/[^/]+$", 1),
        "ext": F.regexp_extract("path", r"\.([^./]+)$", 1),
        "parent": F.try_element_at(parts, F.lit(-3)),
        "grandparent": F.try_element_at(parts, F.lit(-4)),
    }).filter("run <> ''")


SECTION_START = r"\r?\n[ \t]*(?=\[[^\r\n]*\][ \t]*(?:\r?\n|$))"


def ini_rows(files: DataFrame, first_section: str = "") -> DataFrame:
    """``key=value`` lines of each file with their section and position.

    The text is cut before every ``[section]`` line, then into lines, so each line knows its section
    without looking back and nothing is shuffled.
    """
    keep = [c for c in files.columns if c != "content"]
    text = F.concat(F.lit("\n"), F.decode("content", "ISO-8859-1"))
    blocks = files.select(*keep, F.posexplode(F.split(text, SECTION_START)).alias("_b", "_block"))
    name = F.regexp_extract("_block", r"^\[([^\r\n]*)\][ \t]*(?:\r?\n|$)", 1)
    headed = F.startswith(F.col("_block"), F.lit("["))
    lines = blocks.select(*keep, "_b", F.when(headed, name).otherwise(F.lit(first_section)).alias("section"),
                          F.posexplode(F.split("_block", "\r?\n")).alias("_l", "_line"))
    at = F.instr(F.col("_line"), "=")
    return lines.filter(at > 0).select(
        *keep, (F.col("_b").cast("long") * F.lit(1 << 32) + F.col("_l")).alias("pos"), "section",
        F.trim(F.substring(F.col("_line"), F.lit(1), at - 1)).alias("key"),
        # everything after the first "=" is the value
        F.trim(F.substring(F.col("_line"), at + 1, F.length("_line"))).alias("value"))


def read_header(files: DataFrame) -> DataFrame:
    """Header entries per run with their section."""
    return ini_rows(files.filter(F.upper("ext") == "HED").select("run", "content"), "GENERAL")


def flat_header(rows: DataFrame) -> DataFrame:
    """Flat keys: the last GENERAL value, else the first one anywhere."""
    general = F.when(F.col("section") == "GENERAL", F.col("pos"))
    return rows.groupBy("run", "key").agg(
        F.coalesce(F.max_by("value", general), F.min_by("value", "pos")).alias("value"))


def header_columns(rows: DataFrame, keys: dict[str, str]) -> DataFrame:
    """One row per run; ``keys``: output column -> flat key or ``SECTION.key``. One aggregation for all."""
    def pick(key: str) -> Column:
        if "." in key:
            section, own = key.split(".", 1)
            return F.max_by("value", F.when((F.col("section") == section) & (F.col("key") == own), F.col("pos")))
        mine = F.when(F.col("key") == key, F.col("pos"))
        return F.coalesce(F.max_by("value", F.when(F.col("section") == "GENERAL", mine)), F.min_by("value", mine))
    wanted = {k.split(".", 1)[-1] for k in keys.values()}
    return rows.filter(F.col("key").isin(sorted(wanted))).groupBy("run").agg(*[pick(k).alias(o) for o, k in keys.items()])


def header_picks(files: DataFrame, text: Column, keys: dict[str, str]) -> DataFrame:
    """``files`` with a column (place, value) for each of ``keys``, as in :func:`header_columns`, from the header in ``text``; of several files
    the greatest place counts. The lines stay in their row, so only what was asked for moves on."""
    start, own = F.lit(1 << 62), sorted({k for k in keys.values() if "." not in k})
    tails = sorted({k.split(".", 1)[1] for k in keys.values() if "." in k})
    blocks = F.transform(F.split(F.concat(F.lit("\n"), text), SECTION_START), lambda b, i: F.struct(
        F.when(F.startswith(b, F.lit("[")), F.regexp_extract(b, r"^\[([^\r\n]*)\][ \t]*(?:\r?\n|$)", 1)).otherwise(F.lit("GENERAL")).alias("section"),
        (i.cast("long") * F.lit(1 << 32)).alias("at"), F.split(b, "\r?\n").alias("lines")))
    part = lambda x, a, n: F.trim(F.substring(x, a, n))
    lines = F.flatten(F.transform(F.col("_blocks"), lambda b: F.filter(F.transform(b["lines"], lambda x, i: F.struct(
        b["section"].alias("section"), (b["at"] + i).alias("pos"), part(x, F.lit(1), F.instr(x, "=") - 1).alias("key"), x.alias("line"))),
        lambda x: F.contains(x["line"], F.lit("=")) & ~F.startswith(x["line"], F.lit("=")) & x["key"].isin(sorted({k.split(".", 1)[-1] for k in keys.values()})))))
    value = lambda x: part(x["line"], F.instr(x["line"], "=") + 1, F.length(x["line"])).alias("value")
    general = lambda x: F.when(x["section"] == "GENERAL", start + x["pos"]).otherwise(-x["pos"])
    flat = F.transform(F.filter("_lines", lambda x: x["key"].isin(own)), lambda x: F.struct(
        x["key"].alias("name"), F.struct(general(x).alias("place"), value(x)).alias("of")))
    named = F.transform(F.filter("_lines", lambda x: x["key"].isin(tails)), lambda x: F.struct(F.concat(x["section"], F.lit("."), x["key"]).alias("name"), F.struct(x["pos"].alias("place"), value(x)).alias("of")))

    def last(c: str) -> Column:  # of each name in a sorted list
        return F.map_from_entries(F.filter(c, lambda x, i: F.coalesce(F.get(c, i + 1)["name"] != x["name"], F.lit(True))))

    out = files.withColumn("_blocks", blocks).withColumn("_lines", lines).withColumns({"_flat": F.sort_array(flat), "_named": F.sort_array(named)})
    out = out.withColumns({"_flat": last("_flat"), "_named": last("_named")})
    return out.withColumns({o: F.try_element_at(F.col("_named" if "." in k else "_flat"), F.lit(k)) for o, k in keys.items()}).drop("_blocks", "_lines", "_flat", "_named")


def hex_float(c: Column) -> Column:
    """Big-endian IEEE-754 single from hex text; 1.0 where it cannot be read."""
    text = F.lpad(F.trim(c), 8, "0")
    n = F.conv(text, 16, 10).cast("long")
    sign = F.when(F.shiftright(n, 31) == 1, -1.0).otherwise(1.0)
    exp = F.shiftright(n, 23).bitwiseAND(F.lit(255))
    frac = n.bitwiseAND(F.lit(0x7FFFFF))
    value = (F.when(exp == 0, frac * F.lit(2.0 ** -149))
             .when(exp == 255, F.when(frac == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
             .otherwise((1 + frac / F.lit(2.0 ** 23)) * F.pow(F.lit(2.0), exp - 127)))
    return F.when(text.rlike("^[0-9A-Fa-f]{8}$"), sign * value).otherwise(F.lit(1.0))


def read_catalog(files: DataFrame) -> DataFrame:
    """Channels of each run: name, file extension, offset, scale, multiplier, signedness."""
    rows = ini_rows(files.filter(F.upper("ext") == "DDD").select("run", "content"))
    rows = rows.filter(F.col("section").rlike("^[0-9A-Fa-f]+$"))
    line = lambda k: F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("pos")))
    wide = rows.groupBy("run", "section").agg(line("3").alias("l3"), line("4").alias("l4"), line("6").alias("l6"))
    p3, p6 = F.split("l3", ","), F.split("l6", ",")
    mult = F.when(F.size(p3) > 6, hex_float(F.get(p3, 6))).otherwise(F.lit(1.0))
    return wide.select(
        "run", F.trim(F.split_part("l4", F.lit(","), F.lit(1))).alias("channel"),
        F.coalesce(F.get(p6, 3), F.lit("")).alias("ext"),
        F.coalesce(F.get(p3, 0).try_cast("long"), F.lit(0)).alias("offset"),
        F.when(F.size(p3) > 3, hex_float(F.get(p3, 3))).otherwise(F.lit(1.0)).alias("scale"),
        F.when(F.coalesce(mult, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(mult).alias("mult"),
        (F.coalesce(F.col("l6").startswith("FFFFFFFE"), F.lit(False)) | F.coalesce(F.get(p6, 1) == "I", F.lit(False))).alias("signed"),
    ).filter("channel <> ''")


def _decode_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small files share an output batch, long ones are cut into several."""
    held, rows = [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.concat_arrays([h[i] for h in held]) for i in range(4)],
                                          ["run", "channel", "idx", "value"])
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for r in range(batch.num_rows):
            run, channel, off, scale, mult, signed, data = (
                cols[c][r].as_py() for c in ("run", "channel", "offset", "scale", "mult", "signed", "content"))
            raw = np.frombuffer(data or b"", dtype="<i2" if signed else "<u2", count=len(data or b"") // 2)
            for lo in range(0, len(raw), CHUNK):
                part = raw[lo:lo + CHUNK].astype("float64")
                n = len(part)
                held.append((pa.repeat(run, n), pa.repeat(channel, n), pa.array(np.arange(lo, lo + n, dtype="int64")),
                             pa.array((part - off) * scale * mult)))
                rows += n
                if rows >= CHUNK:
                    yield flush()
                    held, rows = [], 0
    if held:
        yield flush()


def read_samples(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per sample in physical units: ``(raw - offset) * scale * mult``."""
    chans = catalog.filter("ext <> ''").withColumn("_ext", F.upper("ext")).drop("ext")
    data = files.select("run", F.upper("ext").alias("_ext"), "content")
    ready = data.join(chans, ["run", "_ext"]).select("run", "channel", "offset", "scale", "mult", "signed", "content")
    return ready.mapInArrow(_decode_samples, "run string, channel string, idx long, value double")


LAP_WORDS = 3  # count, reserved, start


def _decode_laps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs, laps, starts, ends = [], [], [], []
        for run, content in zip(batch.column("run").to_pylist(), batch.column("content").to_pylist()):
            words = np.frombuffer(content, dtype="<u4", count=len(content) // 4)
            if len(words) < LAP_WORDS or words[0] > len(words) - LAP_WORDS:
                continue
            found = words[LAP_WORDS:LAP_WORDS + int(words[0])]
            runs += [run] * len(found)
            laps += list(range(len(found)))
            starts += [int(words[2])] * len(found)
            ends += found.astype("int64").tolist()
        yield pa.RecordBatch.from_pydict({"run": pa.array(runs, pa.string()), "lap_no": pa.array(laps, pa.int64()),
                                          "start_ms": pa.array(starts, pa.int64()), "end_ms": pa.array(ends, pa.int64())})


def read_laps(files: DataFrame) -> DataFrame:
    """Cumulative lap ends in ms with the file's start; lap 0 is the out-lap. A file that is shorter than the laps it
    announces is left to :func:`damaged`."""
    laps = files.filter(F.upper("ext") == "LAP").select("run", "content")
    return laps.mapInArrow(_decode_laps, "run string, lap_no long, start_ms long, end_ms long")


def damaged(files: DataFrame) -> DataFrame:
    """Bundle files that cannot be decoded, with the reason (everything else goes on)."""
    ext, size = F.upper("ext"), F.length("content")
    first = F.hex(F.substring("content", 1, 4))  # the little-endian lap count
    count = F.conv(F.concat(*[F.substring(first, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")
    reason = (F.when((ext == "LAP") & (size < 4 * LAP_WORDS), "lap file too short")
              .when((ext == "LAP") & (count > F.floor(size / 4) - LAP_WORDS), "fewer laps than announced")
              .when((ext == "DDD") & (size == 0), "empty catalog").when((ext == "HED") & (size == 0), "empty header"))
    return files.withColumn("reason", reason).filter("reason is not null").select("run", "ext", "reason")

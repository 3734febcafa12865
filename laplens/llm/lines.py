"""Line dedup by a segment-partition edit join.

Distinct lines are found first, equal ones merged before the shuffle. Each is cut into ``max_edits + 1``
segments; two lines within the threshold agree in one segment of the shorter, up to a shift that the lengths
bound. A line is indexed under its segments and probes the indexes of its own and of smaller lengths with the few
substrings that the shift bound leaves. Lines of crowded segments meet under a second exact condition instead. Pairs that share a key are verified with the banded edit
distance of Spark, which stops beyond the threshold.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laplens.llm.common import text_of, unused
from laplens.session import fresh_path, hold, release

#: Characters that a line needs for each edit before a near copy counts: at most one in ten differs.
NEAR_CHARS = 10


def numbered(docs: DataFrame, row_col: str) -> DataFrame:
    """``docs`` with a number for each row in ``row_col``, written before use, so that it is the same whenever it is read."""
    return hold(docs.withColumn(row_col, F.monotonically_increasing_id()), "rows", compression="zstd")


def split_lines(rows: DataFrame, row_col: str, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(row, id, mark, pos, line, hi, lo): non-blank lines of ``min_chars`` or more characters, outer blanks off, with a 128-bit
    name. ``mark`` is a hash of the row's text."""
    text = text_of(text_col)
    # Trimming walks the whole line, so it is done once, and only where there is something to take off.
    blank_end = lambda x: reduce(or_, [f(x, F.lit(c)) for f in (F.startswith, F.endswith) for c in " \t\r"])
    bare = F.transform(F.split(text, "\n"), lambda x: F.when(blank_end(x), F.btrim(x, F.lit(" \t\r"))).otherwise(x))
    begun = F.startswith("line", F.lit("\x0b")) | F.startswith("line", F.lit("\x0c"))
    lines = (rows.select(F.col(row_col).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), F.posexplode(bare).alias("pos", "line"))
             .filter((F.length("line") >= min_chars) & (F.col("line") != "") & (~begun | (F.length(F.btrim("line", F.lit(" \t\x0b\x0c\r"))) > 0))))
    return lines.withColumns({"hi": F.xxhash64("line"), "lo": F.xxhash64(F.lit(1), "line")})


def segment_keys(line: Column, length: Column, max_edits: int) -> tuple[Column, Column]:
    """Index keys of a line, and the keys it probes. A key names the indexed length, the segment and its text.

    For a probed length smaller by d, segment i (of k + 1, counted from 0) may lie i or less off its place and, seen
    from the end, k - i or less off. Among equal lengths a shift to the left is another line's shift to the right, and
    lines that agree without a shift share an index key."""
    k = max_edits
    start = lambda n, i: F.floor(n * i / (k + 1)).cast("int") + 1
    key = lambda n, i, at: F.xxhash64(n, F.lit(i), F.substring(line, at, start(n, i + 1) - start(n, i)))
    index = [key(length, i, start(length, i)) for i in range(k + 1)]
    probes = []
    for d in range(k + 1):
        for i in range(k + 1):
            for shift in range(max(-i, d - (k - i)), min(i, d + k - i) + 1):
                if d or shift > 0:
                    probes.append(key(length - d, i, start(length - d, i) + shift))
    none = F.expr("CAST(array() AS ARRAY<BIGINT>)")  # without edits
    return F.array(*index), F.array(*probes) if probes else none


def bigram_bits(line: Column, max_edits: int) -> Column:
    """Two words of bits (a, b): each pair of neighbouring characters flips one of about 126 bits. An edit flips four at most."""
    half = 63 // (4 * max_edits + 1) * (4 * max_edits + 1)
    zero = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))

    def flip(bits: Column, i: Column) -> Column:
        h = F.pmod(F.xxhash64(F.substring(line, i, F.lit(2))), F.lit(2 * half)).cast("int")
        bit = lambda low: F.when((h >= low) & (h < low + half), F.call_function("shiftleft", F.lit(1).cast("long"), h - low)).otherwise(F.lit(0).cast("long"))
        return F.struct(bits["a"].bitwiseXOR(bit(0)).alias("a"), bits["b"].bitwiseXOR(bit(half)).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(line) - 1, F.lit(1))), zero, flip)


def bit_blocks(length: Column, max_edits: int) -> Column:
    """Keys from a length and the bits, cut into ``4 * max_edits + 1`` blocks: those of lines within the threshold agree in one at least."""
    blocks = 4 * max_edits + 1
    width = 63 // blocks
    cut = lambda word, j: F.shiftright(word, j * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    return F.array(*[F.xxhash64(length, F.lit(j), cut(F.col("a"), j), cut(F.col("b"), j)) for j in range(blocks)])


def crowd_pairs(names: DataFrame, lines: DataFrame, max_edits: int) -> DataFrame:
    """Pairs among ``names`` that agree in a block of bigram bits and differ in few of the bits, which all pairs within the threshold
    do; the second is the longer by up to ``max_edits``. A line makes one row a block, and one a block and length that it probes."""
    bits = hold(names.join(lines.select("hi", "lo", "line"), ["hi", "lo"])
                .select("hi", "lo", F.length("line").alias("n"), bigram_bits(F.col("line"), max_edits).alias("bits")).select("hi", "lo", "n", "bits.*"), "bits")
    left = bits.select("hi", "lo", "a", "b", F.posexplode(bit_blocks(F.col("n"), max_edits)).alias("block", "key"))
    right = bits.withColumn("d", F.explode(F.array(*[F.lit(d) for d in range(max_edits + 1)])))
    right = right.select(*[F.col(c).alias(c + "2") for c in ("hi", "lo", "a", "b")], "d", F.posexplode(bit_blocks(F.col("n") - F.col("d"), max_edits)).alias("block2", "key"))
    x, y = F.col("a").bitwiseXOR(F.col("a2")), F.col("b").bitwiseXOR(F.col("b2"))
    close = ((F.col("d") > 0) | smaller("hi", "lo", "hi2", "lo2")) & (F.bit_count(x) + F.bit_count(y) <= 4 * max_edits)
    blocks = 4 * max_edits + 1
    for i in range(blocks - 1):  # a pair meets in the first block in which it agrees, not in every one
        own = F.shiftright(x.bitwiseOR(y), i * (63 // blocks)).bitwiseAND(F.lit((1 << 63 // blocks) - 1).cast("long"))
        close = close & ((F.col("block") <= i) | (own != 0))
    return left.join(right, "key").filter(close).select("hi", "lo", "hi2", "lo2")


def smaller(hi: str, lo: str, hi2: str, lo2: str) -> Column:
    return (F.col(hi) < F.col(hi2)) | (F.col(hi) == F.col(hi2)) & (F.col(lo) < F.col(lo2))


def near_pairs(lines: DataFrame, max_edits: int, crowd: int = 10) -> DataFrame:
    """Pairs of names of distinct lines (hi, lo, hi2, lo2) that share a key. Where more than ``crowd`` lines are indexed under one
    segment, as variants of one text are, the lines that have or probe it meet by :func:`crowd_pairs` instead."""
    lines = lines.select("hi", "lo", "line", F.length("line").alias("n"))
    index, probes = segment_keys(F.col("line"), F.col("n"), max_edits)
    left = lines.select("hi", "lo", F.explode(index).alias("key"))
    right = lines.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.explode(probes).alias("key"))
    crowded = hold(left.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("hi").alias("one")).filter(F.col("n") > crowd).select("key", "one"), "crowded")
    # Of a crowded key one line stays, to tell which lines probe it; the others leave their key and only name themselves. So the
    # keys of all lines are computed and moved once.
    kind = F.when(F.col("one").isNull(), 0).when(F.col("hi") == F.col("one"), 1).otherwise(2)
    kept = left.join(crowded, "key", "left").select("hi", "lo", kind.alias("kind"), "key")
    kept = kept.withColumn("key", F.when(F.col("kind") == 2, F.xxhash64("key", "hi", "lo")).otherwise(F.col("key")))
    x, y = kept.alias("x"), kept.alias("y")
    itself = (F.col("x.kind") > 0) & (F.col("y.kind") > 0) & (F.col("x.hi") == F.col("y.hi")) & (F.col("x.lo") == F.col("y.lo"))
    equal = (x.join(y, F.col("x.key") == F.col("y.key")).filter(smaller("x.hi", "x.lo", "y.hi", "y.lo") | itself)
             .select(*[F.when(~itself, F.col("x." + c)).alias(c) for c in ("hi", "lo")], F.col("y.hi").alias("hi2"), F.col("y.lo").alias("lo2")))
    own = F.col("kind") == 1
    differ = (F.col("hi") != F.col("hi2")) | (F.col("lo") != F.col("lo2"))
    other = kept.join(right, "key").filter(own | differ).select(*[F.when(~own, F.col(c)).alias(c) for c in ("hi", "lo")], "hi2", "lo2")
    met = hold(other.unionByName(equal).distinct(), "met")
    pairs, names = met.filter("hi IS NOT NULL"), met.filter("hi IS NULL").select(F.col("hi2").alias("hi"), F.col("lo2").alias("lo"))
    if not crowded.isEmpty():
        pairs = pairs.unionByName(crowd_pairs(names, lines, max_edits)).distinct()
    return pairs


def row_verdicts(rows: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 2,
                 min_chars: int | None = None, crowd: int = 10) -> DataFrame:
    """(row, id, pos, why) of the lines to take out of ``rows``, whose numbers are in ``row_col``; see :func:`line_verdicts`."""
    spark = rows.sparkSession
    found = split_lines(rows, row_col, id_col, text_col, 1 if min_chars is None else min_chars)
    place = F.struct(F.col("id").isNull().alias("no"), F.col("id").alias("id"), F.col("pos").alias("pos"), F.col("mark").alias("mark"),
                     F.col("row").alias("row"))
    distinct = found.groupBy("hi", "lo").agg(F.first("line").alias("line"), F.min(place).alias("first"))
    # Bucketed by name: the text of candidates is then looked up without moving the other lines again.
    name, buckets = f"lines_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, "lines")
    (distinct.write.bucketBy(buckets, "hi", "lo").option("path", path).option("compression", "zstd").saveAsTable(name))
    lines = spark.table(name)
    shortest = NEAR_CHARS * max_edits if min_chars is None else min_chars
    pairs = near_pairs(lines.filter(F.length("line") >= shortest), max_edits, crowd)
    other = lines.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.col("line").alias("line2"), F.col("first").alias("first2"))
    close = F.levenshtein("line", "line2", max_edits) >= 0
    near = pairs.join(lines, ["hi", "lo"]).join(other, ["hi2", "lo2"]).filter(close)
    after = F.col("first") > F.col("first2")
    near = hold(near.select(F.when(after, F.col("hi")).otherwise(F.col("hi2")).alias("hi"),
                            F.when(after, F.col("lo")).otherwise(F.col("lo2")).alias("lo")).distinct().withColumn("near", F.lit(True)), "near-lines")
    firsts = lines.select("hi", "lo", F.col("first.row").alias("first_row"), F.col("first.pos").alias("first_pos"))
    firsts = hold(firsts.join(near, ["hi", "lo"], "left"), "firsts", compression="zstd")
    spark.sql(f"DROP TABLE {name}")
    lines.held_path = path
    release(lines, near)
    places = found.select("row", "id", "pos", "hi", "lo").join(firsts, ["hi", "lo"])
    is_first = (F.col("first_row") == F.col("row")) & (F.col("first_pos") == F.col("pos"))
    return places.filter(F.col("near").isNotNull() | ~is_first).select(
        "row", "id", "pos", F.when(~is_first, F.lit("exact")).otherwise(F.lit("near")).alias("why"))


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, pos, why) of the lines to take out, ``why`` being 'exact' or 'near'; one row per line of a row of ``docs``.

    The corpus order of lines is that of (id, position), nulls last; among rows that share an id, or have none, a hash of the
    text and then the row decide. A line goes when an equal line comes before it, or a line within ``max_edits`` edits
    does that has its first occurrence before this line's. Blank lines stay. Equal lines of any length go; near ones need
    :data:`NEAR_CHARS` characters for each edit allowed, as in shorter lines an edit may be all the difference. A number as
    ``min_chars`` replaces both bounds: shorter lines then stay altogether."""
    row = unused(docs, "__row")
    return row_verdicts(numbered(docs.select(id_col, text_col), row), row, id_col, text_col, **options).drop("row")


def removed_lines(rows: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``rows`` (see :func:`numbered`) that loses lines: row, ``exact`` and ``near``, the sorted positions of
    lost lines."""
    gone = row_verdicts(rows, row_col, id_col, text_col, **options).groupBy("row").agg(
        F.array_sort(F.collect_set(F.when(F.col("why") == "exact", F.col("pos")))).alias("exact"),
        F.array_sort(F.collect_set(F.when(F.col("why") == "near", F.col("pos")))).alias("near"))  # a document's own lines
    return hold(gone, "removed")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int | None = 40, **options) -> DataFrame:
    """``docs`` with repeated and nearly repeated lines taken out of ``text_col`` (see :func:`line_verdicts`). Here lines under
    ``min_chars`` characters stay unless it is None, as it is in the pipeline.

    No row is lost: a document of repeated lines only ends with an empty text. A null text stays null. Every row loses lines
    of its own, also where ids repeat or are null. Other columns pass through unchanged, whatever their names. An empty table
    stays empty."""
    own_row, lost_row, own_gone = unused(docs, "__row"), unused(docs, "__lost"), unused(docs, "__gone")
    rows = numbered(docs, own_row)
    gone = (removed_lines(rows, own_row, id_col, text_col, min_chars=min_chars, **options)
            .select(F.col("row").alias(lost_row), F.concat("exact", "near").alias(own_gone)))
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda line, i: ~F.array_contains(F.col(own_gone), i)), "\n")
    return (rows.join(gone, F.col(own_row) == F.col(lost_row), "left")
            .withColumn(text_col, F.when(F.col(own_gone).isNull(), F.col(text_col)).otherwise(kept)).drop(own_row, lost_row, own_gone))

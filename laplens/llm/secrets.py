"""Secret scan with corpus-wide ownership frequency.

Three patterns give the base spans. The method adds bare strings that look like keys, and judges every
candidate by who has it: candidate hashes are counted over distinct repositories and distinct owners. A value
that many owners or many repositories share is a copied example; one that a single owner holds looks live. All spans are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laplens.llm.common import text_of
from laplens.session import hold

# Fixed values of the contract: kinds in their order, with patterns. A run of 24 or more characters of a class is
# the match of its greedy pattern that is long enough, so those two carry the length; the first is filtered after.
KINDS = ("assign", "access", "hex", "bare")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BARE = r"[A-Za-z0-9+/_=-]{28,}"
MIN_ASSIGN = 6



def matched(docs: DataFrame, id_col: str, owner_col: str, text_col: str) -> DataFrame:
    """row (a number of its own), id, owner, and per kind the matches with the lengths of the text before each, written once."""
    every = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    patterns = (ASSIGN, ACCESS, HEX, BARE)
    found = (docs.select(F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"), text_of(text_col).alias("text"))
             .select("*", *[every(p).alias(f"m{k}") for k, p in enumerate(patterns)]))
    # the text between matches comes from splitting at the same pattern
    gaps = [F.when(F.size(f"m{k}") > 0, F.transform(F.split("text", p, -1), F.length)).alias(f"g{k}") for k, p in enumerate(patterns)]
    value = F.when(F.size("m0") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).alias("v0")
    return hold(found.select(F.monotonically_increasing_id().alias("row"), "id", "owner", *[f"m{k}" for k in range(4)], *gaps, value), "matches")


def placed(found: DataFrame) -> DataFrame:
    """(row, id, owner, kind, start, stop, hash): base spans, and bare candidates that overlap none, in code points. Places are running sums over the
    matches of a text, so that the cost is in proportion to their number."""
    none = F.expr("CAST(array() AS ARRAY<STRUCT<kind: INT, nth: INT, gap: INT, size: INT, value: STRING>>)")
    lists = []
    for k in range(4):
        m, g, v = F.col(f"m{k}"), F.col(f"g{k}"), F.col("v0" if k == 0 else f"m{k}")
        lists.append(F.when(F.size(m) > 0, F.transform(F.arrays_zip(m.alias("m"), F.slice(g, 1, F.size(m)).alias("g"), v.alias("v")), lambda z, i: F.struct(
            F.lit(k).alias("kind"), i.alias("nth"), z["g"].alias("gap"), F.length(z["m"]).alias("size"), z["v"].alias("value")))).otherwise(none))  # noqa: B023
    rows = found.select("row", "id", "owner", F.explode(F.concat(*lists)).alias("s")).select("row", "id", "owner", "s.*")
    upto = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(upto)).withColumn("start", F.col("stop") - F.col("size"))
    value = F.col("value")
    keyed = (F.col("kind") < 3) | (value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]"))
    rows = rows.filter(keyed & ((F.col("kind") > 0) | (F.length(value) >= MIN_ASSIGN)))
    base = F.col("kind") < 3
    order = Window.partitionBy("row").orderBy("start", "kind", "stop")
    reach = F.max(F.when(base, F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # read backwards: a frame that runs to the end would be gone through again for every row
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"), F.desc("stop"))
    ahead = F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"reach": F.coalesce(reach, F.lit(0)), "ahead": ahead})
    rows = rows.filter(base | ((F.col("reach") <= F.col("start")) & (F.col("ahead").isNull() | (F.col("ahead") >= F.col("stop")))))
    return rows.select("row", "id", "owner", "kind", "start", "stop", F.sha2("value", 256).alias("hash"))


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, owner, repo) to hash, owners, repos: distinct counts, merged step by step before each shuffle."""
    return (candidates.select("hash", "owner", "repo").distinct()
            .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
            .groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos")))


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", owner_col: str = "source", text_col: str = "text",
                 shared_from: int = 3, copied_from: int = 10) -> DataFrame:
    """One row per row of ``docs``: id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``n_bare``,
    ``n_live``, ``n_few`` and ``n_shared``. A document is a repository of the owner in ``owner_col``.

    Every span falls in one of three classes: shared, where ``shared_from`` or more owners or ``copied_from`` or more repositories hold its
    value; live, where one owner does; few for the rest. All are listed. Spans are of whole matches, in code points, end
    exclusive, by start, then kind. A null text is empty and has no spans; null owners are one owner. Rows that repeat an id count as
    one repository; each row without an id is one. Other columns are not read. An empty table gives no rows. The cost of a very long
    text is in proportion to its length; its spans are sorted in one task."""
    found = matched(docs, id_col, owner_col, text_col)
    spans = hold(placed(found.filter(F.greatest(*[F.size(f"m{k}") for k in range(4)]) > 0)), "spans")
    repo = F.struct("id", F.when(F.col("id").isNull(), F.col("row")).alias("row"))
    counts = hold(ownership(spans.select("hash", F.coalesce("owner", F.lit("")).alias("owner"), repo.alias("repo"))), "owners")
    shared = (F.col("owners") >= shared_from) | (F.col("repos") >= copied_from)
    live = F.when(shared, "shared").when(F.col("owners") == 1, "live").otherwise("few")
    judged = spans.join(counts, "hash").select("row", "kind", "start", "stop", live.alias("class"))
    many = lambda c: F.count_if(c)
    per_row = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "stop"))).alias("every"),  # the spans of one text
        *[many(F.col("kind") == k).alias(n) for k, n in enumerate(("n_assign", "n_access", "n_hex", "n_bare"))],
        *[many(F.col("class") == c).alias(f"n_{c}") for c in ("live", "few", "shared")])
    none = F.expr("CAST(array() AS ARRAY<STRUCT<start: BIGINT, kind: INT, stop: BIGINT>>)")
    out = found.select("row", "id").join(per_row, "row", "left").withColumn("every", F.coalesce("every", none))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    base = F.filter("every", lambda s: s["kind"] < 3)
    return out.select(F.col("id").alias(id_col), n("n_assign"), n("n_access"), n("n_hex"), F.sha2(_listed(base), 256).alias("base_sha256"),
                      _listed(F.col("every")).alias("spans"), n("n_bare"), n("n_live"), n("n_few"), n("n_shared"))

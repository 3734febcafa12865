"""MinHash near-dedup with SetSketch registers.

A text's set of word shingles is sketched by registers, each the exponentially truncated minimum of a hash over the
set. Registers of a union are the larger of both, and registers agree the oftener the more alike two sets are. Bands of
registers put alike texts into common buckets. Pairs from a bucket are first judged by the joint likelihood of their
registers, and only clear misses go; the others are verified on full sets.

No bucket is expanded into all its pairs. First all its members meet one hub, and the links found are contracted to
components. Only members of buckets that still hold several components go on. For them a
prefix filter finds the rest exactly: in an order of shingles from rare to frequent, two sets that are linked share one
of their first few. What many copies have in common comes last in that order, so a copy meets only those that share
its own changes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laplens.llm.common import unused
from laplens.session import hold, release, ship

WIDTH = 5
REGISTERS, BAND, ROUNDS = 192, 6, 2
BASE, RATE = 1.005, 20.0
#: Shingles hashed at a time, and words remembered by a task; they only bound memory.
BLOCK = 2048
MEMO = 500_000
#: Entries of the frequency table that orders shingles; its size is fixed.
SLOTS = 1 << 18

_RNG = np.random.default_rng(20_240_601)
_MULT = _RNG.integers(0, 2 ** 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2 ** 63, REGISTERS, dtype=np.uint64) * np.uint64(2)
_PLACE = _RNG.integers(0, 2 ** 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Each round deals all registers anew into bands of BAND.
_BANDS = np.stack([band for _ in range(ROUNDS) for band in _RNG.permutation(REGISTERS).reshape(-1, BAND)])
_BAND_MULT = _RNG.integers(0, 2 ** 63, _BANDS.shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Names(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, names: Names) -> np.ndarray:
    """The sorted set of 64-bit hashes of a text's shingles: runs of five words, or all words where there are fewer."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(names.__getitem__, words), np.uint64, n)
    k = min(n, WIDTH)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total += _mix(h[i: n - k + 1 + i]) * _PLACE[i]
    return np.unique(_mix(total))


def registers(values: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set that is not empty."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), BLOCK):
        part = values[at: at + BLOCK, None] * _MULT
        part += _ADD
        np.minimum(low, part.min(axis=0), out=low)
    x = -np.log1p(-np.minimum((low.astype(np.float64) + 0.5) / 2.0 ** 64, 1 - 2.0 ** -53)) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, 65_535).astype("<u2")


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One key per band for each row of registers."""
    out = np.empty((len(regs), len(_BANDS)), np.uint64)
    for i, (band, mult) in enumerate(zip(_BANDS, _BAND_MULT)):
        out[:, i] = _mix((_mix(regs[:, band].astype(np.uint64) + np.uint64(i << 20)) * mult).sum(axis=1, dtype=np.uint64))
    return out.view(np.int64)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)


def clear_miss(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, floor: float, evidence: float = 14.0) -> np.ndarray:
    """Pairs whose registers speak against a similarity of ``floor`` or more: the log likelihood at the best similarity
    exceeds the best one from ``floor`` up by more than ``evidence``."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)  # of two sets of these sizes, the largest similarity
    best, above = np.full(len(a), -np.inf), np.full(len(a), -np.inf)
    for j in np.concatenate([np.linspace(0, floor, 24, endpoint=False), np.linspace(floor, 1, 12)]):
        s = np.minimum(j, top)
        p, q = _p(u - v * s), _p(v - u * s)
        log = (more * np.log(np.maximum(p, 1e-12)) + less * np.log(np.maximum(q, 1e-12)) + same * np.log(np.maximum(1 - p - q, 1e-12)))
        best = np.maximum(best, log)
        if j >= floor:
            above = np.maximum(above, log)
    return best - above > evidence


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), name (128-bit name of the set) and regs; the last two are null for empty sets."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def sketch(batches):
        import xxhash

        names = Names()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t, names) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(list(map(len, sets)), pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary())], ["id", "n", "name", "regs"])

    return source.mapInArrow(sketch, f"id {kind}, n long, name binary, regs binary")


def bands(reps: DataFrame) -> DataFrame:
    """(key, id, n) for each band of (id, n, regs)."""
    kind = reps.schema["id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                regs = np.frombuffer(b"".join(part.column(2).to_pylist()), "<u2").reshape(-1, REGISTERS)
                rows = pa.array(np.repeat(np.arange(part.num_rows), len(_BANDS)))
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(regs).ravel()), part.column(0).take(rows), part.column(1).take(rows)],
                                                 ["key", "id", "n"])

    return reps.select("id", "n", "regs").mapInArrow(cut, f"key long, id {kind}, n long")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): each node of (a, b) with the smallest node of its component. Alternates linking all larger and all smaller
    neighbours to the least one, until nothing changes; every turn is a written table."""
    current = hold(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")

    def content(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    state = content(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = hold(large, "edges")
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
                 .unionByName(lower.select("a", F.col("m").alias("b"))).distinct())
        small = hold(small, "edges")
        release(current, large)
        seen, current = content(small), small
        if seen == state:
            return current.select(F.col("a").alias("id"), F.col("b").alias("comp"))
        state = seen


def verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those with 100 * intersection >= percent * union on full sets."""
    kind = reps.schema["id"].dataType.simpleString()

    def likely(batches):
        for batch in batches:
            cols = [batch.column(i) for i in range(6)]
            a, b = (np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(-1, REGISTERS) for c in cols[2:4])
            na, nb = (c.to_numpy(zero_copy_only=False).astype(float) for c in cols[4:6])
            keep = pa.array(~clear_miss(a, b, na, nb, percent / 100)) if batch.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([cols[0].filter(keep), cols[1].filter(keep)], ["a", "b"])

    side = lambda s: reps.select(F.col("id").alias(s), F.col("regs").alias("r" + s), F.col("n").alias("n" + s))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    sketched = pairs.join(side("b"), "b").join(side("a"), "a").filter(fits).select("a", "b", "ra", "rb", "na", "nb")
    open_pairs = sketched.mapInArrow(likely, f"a {kind}, b {kind}")

    def check(batches):
        names, sets = Names(), {}

        def of(i, text):
            if i not in sets:
                if len(sets) > 64:
                    sets.clear()
                sets[i] = shingles(text, names)
            return sets[i]

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keep = []
                for i, j, x, y in zip(*(c.to_pylist() for c in part.columns)):
                    s, t = of(i, x), of(j, y)
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(common > 0 and 100 * common >= percent * (len(s) + len(t) - common))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], ["a", "b"])

    text = lambda s: texts.select(F.col("id").alias(s), F.col("text").alias("t" + s))
    full = open_pairs.join(text("b"), "b").join(text("a"), "a").select("a", "b", "ta", "tb")
    return full.mapInArrow(check, f"a {kind}, b {kind}")


def _size_class(n):
    return np.floor(np.log(n) / math.log(1.05)).astype(np.int32)


def prefix_pairs(nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (id, n, comp, minor) of different components, one of them minor, that can be linked: all that
    share a shingle within the prefixes that their sizes leave. Shingles are ordered by their frequency among the nodes, as a
    table of fixed size counts it; any order is exact, this one is quick."""
    kind = nodes.schema["id"].dataType.simpleString()

    def cut(batches):
        names = Names()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t, names) for t in part.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(list(map(len, sets)), pa.int64()), *part.columns[2:4],
                    pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "comp", "minor", "set"])

    sets = hold(nodes.join(texts, "id").select("id", "n", "comp", "minor", "text")
                .mapInArrow(cut, f"id {kind}, n long, comp {kind}, minor boolean, set binary"), "sets")

    def count(batches):
        table = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                table += np.bincount((np.frombuffer(raw, np.uint64) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        slots = np.nonzero(table)[0]
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(table[slots])], ["slot", "n"])

    counted = sets.select("set").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    often = np.zeros(SLOTS, np.int64)
    often[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    shared = nodes.sparkSession.sparkContext.broadcast(often)

    def prefix(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                owner, keys, places = [], [], []
                for i, (n, raw) in enumerate(zip(part.column(1).to_pylist(), part.column(4).to_pylist())):
                    own = np.frombuffer(raw, np.uint64)
                    first = np.lexsort((own, shared.value[(own % np.uint64(SLOTS)).astype(np.int64)]))[: len(own) - -(-percent * len(own) // 100) + 1]
                    owner.append(np.full(len(first), i))
                    keys.append(own[first])
                    places.append(np.arange(len(first)))
                if owner:
                    rows = np.concatenate(owner)
                    n = part.column(1).to_numpy(zero_copy_only=False)[rows]
                    pos = np.concatenate(places)
                    top = np.minimum((100 + percent) * (n - pos) // percent - n, 100 * n // percent)  # the largest partner at this place
                    low = np.maximum(-(-percent * n // 100), 1)
                    yield pa.RecordBatch.from_arrays([
                        *(part.column(j).take(pa.array(rows)) for j in range(4)), pa.array(np.concatenate(keys).view(np.int64)), pa.array(pos.astype(np.int64)),
                        pa.array(_size_class(n)), pa.array(_size_class(low)), pa.array(_size_class(np.maximum(top, 1)))],
                        ["id", "n", "comp", "minor", "key", "pos", "class", "low", "top"])

    rows = hold(sets.mapInArrow(prefix, f"id {kind}, n long, comp {kind}, minor boolean, key long, pos long, class int, low int, top int"), "prefixes")
    release(sets)
    probe = rows.filter("minor AND low <= top").select("id", "n", "comp", "key", "pos", F.explode(F.sequence("low", "top")).alias("class"))
    other = rows.select("key", "class", *[F.col(c).alias(c + "2") for c in ("id", "n", "comp", "pos")])
    both = F.col("n") + F.col("n2")
    overlap = F.floor((percent * both + 99 + percent) / (100 + percent))
    meets = ((F.col("comp") != F.col("comp2")) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
             & (F.col("pos") <= F.col("n") - overlap) & (F.col("pos2") <= F.col("n2") - overlap))
    return probe.join(other, ["key", "class"]).filter(meets).select(F.col("id").alias("a"), F.col("id2").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id`` (smallest id reachable over links, its own included) and
    ``kept`` (it is the smallest).

    Texts with equal sets of shingles are one class, known by a 128-bit name, and its smallest id stands for it; classes are linked
    at a similarity of ``percent`` or more, verified on the sets of 64-bit shingle hashes. Null and empty texts have no
    shingles and are linked with nothing. Rows that repeat an id are one node with the links of each. Rows without an id are linked
    with nothing and kept, with a null component. Further columns are not read. An empty table gives no rows.

    Candidates: two sets of the threshold's similarity share no band with a probability of about 5 in 100,000; nothing else is
    left to chance, and no bucket is cut."""
    base = hold(sketches(docs, id_col, text_col), "sketches")
    named = base.filter(F.col("id").isNotNull() & F.col("name").isNotNull())
    classes = named.groupBy("name").agg(F.min("id").alias("rep"))
    members = hold(named.select("id", "name").join(classes, "name").select("id", "rep").distinct(), "members")
    ids = members.filter("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    # a repeated id may stand for several classes; each keeps a row of its own here
    reps = hold(named.join(classes, "name").filter("id = rep").dropDuplicates(["id", "name"]).select("id", "n", "regs"), "reps")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    rows = bands(reps)
    hubs = rows.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top")).filter("hub != top").select("key", "hub")
    crowded = hold(rows.join(hubs, "key"), "crowded")
    tested = hold(crowded.filter("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = hold(verified(tested, reps, texts, percent), "links")
    comp = components(links)

    # rows of the buckets that hold more than one component
    now = crowded.select("key", "id", "n").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    keys = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("key")
    left = hold(now.join(keys, "key", "left_semi"), "unsettled")
    main = (left.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("rows"))
            .groupBy("key").agg(F.max_by("comp", F.struct("rows", "comp")).alias("main")))
    nodes = hold(left.join(main, "key").groupBy("id", "n", "comp").agg(F.max(F.col("comp") != F.col("main")).alias("minor")), "nodes")
    edges = ids.unionByName(comp.select(F.col("id").alias("a"), F.col("comp").alias("b")))
    if not nodes.isEmpty():
        more = prefix_pairs(nodes, texts.filter(F.col("id").isNotNull()), percent)
        more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        edges = edges.unionByName(verified(hold(more, "pairs"), reps, texts, percent))

    final = components(edges)
    out = base.select("id", "n").join(final, "id", "left")
    component = F.coalesce("comp", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one id of each group: its smallest. All columns pass through; rows without an id stay."""
    own_id = unused(docs, "__id")
    gone = near_duplicates(docs, id_col, text_col, **options).filter("NOT kept").select(F.col(id_col).alias(own_id)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(own_id), "left_anti")

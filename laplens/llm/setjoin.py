"""N-gram Jaccard join, size-aware: small sets by subsets of fixed sizes, large ones by inverted lists.

Two sets of n and m shingles are linked when they share at least o(n, m) of them. A small set is written once under each of its subsets of
those sizes. Sets in one bucket of c-subsets share c shingles, so the smallest set of a bucket is linked with every member whose bound is
at most c, and members whose bound is higher are linked with nobody in it: a star per bucket loses no connection.

A large set is written into the inverted lists of its first shingles, in an order from rare to frequent, as many as its size leaves open.
Scanning the lists counts what two sets share there, and pairs that share too little of it cannot be linked. Members of a list first meet
one hub of it, the set that shares most; the links found are contracted to components, and only lists that still hold several
components are scanned for pairs of different components. So a group of copies costs a star, and no link between components is lost.

From which size on a set is large is chosen by cost: rows of subsets against rows of lists and their scans, added up from the sizes and
shingle frequencies of the documents themselves. Both ways are exact, so the boundary only decides the cost.
"""

from __future__ import annotations

from itertools import chain, combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laplens.llm.neardup import _PLACE, SLOTS, WIDTH, Names, _mix, components, shingles
from laplens.session import hold, release, ship

#: Sets of more shingles are always large.
SMALL = 20
#: Rows of a list beyond which its rows are dealt over several tasks.
HOT = 100_000
_SIZE = 0xD6E8FEB86659FD93


def overlap(n, m, percent: int):
    """Shingles that sets of n and m must share to be linked."""
    return -(-percent * (n + m) // (100 + percent))


def _overlap(n: str, m: str, percent: int) -> Column:
    """The same of two columns."""
    return F.floor((percent * (F.col(n) + F.col(m)) + (99 + percent)) / F.lit(100 + percent))


def subset_sizes(n: int, percent: int, limit: int) -> list[int]:
    """Sizes of the subsets under which a set of n is written, for partners of fewer than ``limit`` shingles."""
    partners = range(max(1, -(-percent * n // 100)), min(100 * n // percent, limit - 1) + 1)
    return sorted({overlap(n, m, percent) for m in partners})


def shingle_sets(texts: list[str | None], names: Names) -> list[np.ndarray]:
    """What :func:`shingles` gives for each text, worked out for all of them at once."""
    words = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
    ends = np.cumsum(list(map(len, words)))
    h = _mix(np.fromiter(map(names.__getitem__, chain.from_iterable(words)), np.uint64, int(ends[-1]) if len(ends) else 0))
    n = max(len(h) - WIDTH + 1, 0)
    total = np.full(n, WIDTH, np.uint64)
    for i, place in enumerate(_PLACE):
        total += h[i: i + n] * place
    total = _mix(total)
    return [np.unique(total[e - len(w): e - WIDTH + 1]) if len(w) >= WIDTH else shingles(t, names)
            for t, w, e in zip(texts, words, ends.tolist())]


def first_shingles(values: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """The shingles under which a set is listed: of two linked sets at least one is common to both. Sorted by slot frequency."""
    order = np.lexsort((values, often[(values % np.uint64(SLOTS)).astype(np.int64)]))
    return values[order[: len(values) - -(-percent * len(values) // 100) + 1]]


def sets_of(docs: DataFrame) -> DataFrame:
    """For each row (id, h, text): n, ``name`` (128-bit name of its set) and ``small`` (the set, where it is small). Further rows hold the
    slot frequencies of the shingles of a task."""
    kind = docs.schema["id"].dataType.simpleString()
    names_ = ["id", "h", "n", "name", "small", "slots", "counts"]

    def read(batches):
        import xxhash

        names, table = Names(), np.zeros(SLOTS, np.int64)
        none = lambda n: pa.nulls(n, pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets(part.column(2).to_pylist(), names)
                table += np.bincount((np.concatenate(sets) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(list(map(len, sets)), pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([s.tobytes() if 0 < len(s) <= SMALL else None for s in sets], pa.binary()), none(part.num_rows), none(part.num_rows)], names_)
        slots = np.flatnonzero(table)
        if len(slots):
            yield pa.RecordBatch.from_arrays([
                pa.nulls(1, batch.schema.field(0).type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), none(1), none(1),
                pa.array([slots.astype("<i4").tobytes()], pa.binary()), pa.array([table[slots].astype("<i8").tobytes()], pa.binary())], names_)

    return docs.mapInArrow(read, f"id {kind}, h long, n long, name binary, small binary, slots binary, counts binary")


def slot_counts(base: DataFrame) -> np.ndarray:
    """How often the shingles of each slot occur. The table's size is fixed."""

    def add(batches):
        table = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for slots, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table[np.frombuffer(slots, "<i4")] += np.frombuffer(counts, "<i8")
        slots = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(table[slots])], ["slot", "n"])

    parts = base.filter("slots IS NOT NULL").select("slots", "counts").coalesce(32)
    counted = parts.mapInArrow(add, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    often = np.zeros(SLOTS, np.int64)
    often[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    return often


def boundary(classes: DataFrame, often: np.ndarray, percent: int) -> int:
    """The size from which on sets are large, by the rows that either way costs. A list's length is estimated by its slot, less what falls
    into a slot by chance."""
    shared = classes.sparkSession.sparkContext.broadcast(np.maximum(often - int(often.mean()), 1))

    def cost(batches):
        rows, scans, count = (np.zeros(SMALL + 1, np.int64) for _ in range(3))
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                own = np.frombuffer(raw, np.uint64)
                first = first_shingles(own, shared.value, percent)
                count[len(own)] += 1
                rows[len(own)] += len(first)
                scans[len(own)] += int(shared.value[(first % np.uint64(SLOTS)).astype(np.int64)].sum())
        n = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (n, count[n], rows[n], scans[n])], ["n", "count", "rows", "scans"])

    small = classes.filter("small IS NOT NULL").select("small").mapInArrow(cost, "n long, count long, rows long, scans long")
    figures = small.groupBy("n").agg(F.sum("count").alias("count"), F.sum(F.col("rows") + F.col("scans")).alias("scan")).collect()  # SMALL rows
    light = {r.n: r["count"] * sum(comb(r.n, c) for c in subset_sizes(r.n, percent, SMALL + 1)) for r in figures}
    heavy = {r.n: r.scan for r in figures}

    def total(x: int) -> int:
        return sum(v for n, v in light.items() if n < x) + sum(v for n, v in heavy.items() if 100 * n >= percent * x)

    return min(range(1, SMALL + 2), key=lambda x: (total(x), x))


def light_links(classes: DataFrame, limit: int, percent: int) -> DataFrame:
    """Links (a, b) among classes (node, n, small) of fewer than ``limit`` shingles, a star in each bucket of subsets, confirmed on the sets."""

    def subsets(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                node, size, many, key = [], [], [], []
                for i, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = _mix(np.frombuffer(raw, np.uint64))
                    n = len(own)
                    for c in subset_sizes(n, percent, limit):
                        left_out = np.array(list(combinations(range(n), n - c)), np.int64).reshape(comb(n, c), n - c)
                        sums = own.sum(dtype=np.uint64) - own[left_out].sum(axis=1, dtype=np.uint64)
                        key.append(_mix(_mix(sums) + np.uint64(c * _SIZE & 0xFFFFFFFFFFFFFFFF)))
                        node += [i] * len(sums)
                        size += [n] * len(sums)
                        many += [c] * len(sums)
                if node:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(many, pa.int64()),
                                                      pa.array(size, pa.int64()), pa.array(node, pa.int64())], ["key", "c", "n", "node"])

    small = classes.filter(F.col("n") < limit).select("node", "small")
    rows = small.mapInArrow(subsets, "key long, c long, n long, node long")
    hubs = hold(rows.groupBy("key").agg(F.min(F.struct("n", "node")).alias("hub"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
                .select("key", F.col("hub.n").alias("m"), F.col("hub.node").alias("hub")), "buckets")
    stars = rows.join(hubs, "key").filter((F.col("node") != F.col("hub")) & (_overlap("n", "m", percent) <= F.col("c")))
    pairs = stars.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    side = lambda s: classes.select(F.col("node").alias(s), F.col("small").alias("t" + s))
    return confirmed(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb"), percent, lambda raws, names: [np.frombuffer(r, np.uint64) for r in raws])


def confirmed(pairs: DataFrame, percent: int, read) -> DataFrame:
    """Of the pairs (a, b, ta, tb), those with 100 * intersection >= percent * union on full sets, which ``read`` makes of lists of ta and tb."""

    def check(batches):
        names, sets = Names(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                a, b, left, right = (c.to_pylist() for c in part.columns)
                new = {i: raw for i, raw in zip(a + b, left + right) if i not in sets}
                sets = {i: sets[i] for i in a + b if i in sets} | dict(zip(new, read(list(new.values()), names)))
                keep = []
                for s, t in ((sets[i], sets[j]) for i, j in zip(a, b)):
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(100 * common >= percent * (len(s) + len(t) - common))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], ["a", "b"])

    return pairs.mapInArrow(check, "a long, b long")


def inverted_lists(docs: DataFrame, classes: DataFrame, often: np.ndarray, least: int, percent: int) -> DataFrame:
    """Rows (key, node, n, p, pos) of the inverted lists with two members or more: each class of at least ``least`` shingles under its
    first ones; p is how many those are, pos the place among them. Very long lists are spread over several tasks, where they are kept without looking."""
    shared = docs.sparkSession.sparkContext.broadcast(often)
    kind = docs.schema["id"].dataType.simpleString()

    def cut(batches):
        names = Names()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets(part.column(2).to_pylist(), names)
                sizes = list(map(len, sets))
                firsts = [first_shingles(own, shared.value, percent).tobytes() if len(own) >= least else None for own in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(firsts, pa.binary())],
                                                 ["id", "h", "n", "first"])

    def spread(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                own = [np.frombuffer(raw, np.uint64) for raw in part.column(2).to_pylist()]
                if not own:
                    continue
                p = np.array(list(map(len, own)), np.int64)
                keys = np.concatenate(own)
                rows = np.repeat(np.arange(len(own)), p)
                node, n = (part.column(i).to_numpy(zero_copy_only=False)[rows] for i in (0, 1))
                crowd = shared.value[(keys % np.uint64(SLOTS)).astype(np.int64)] // HOT
                salt = np.where(crowd > 0, _mix(node.astype(np.uint64)) % np.maximum(crowd, 1).astype(np.uint64) + np.uint64(1), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(salt), pa.array(node), pa.array(n), pa.array(p[rows]),
                                                  pa.array(np.arange(len(keys)) - (np.cumsum(p) - p)[rows])], ["key", "salt", "node", "n", "p", "pos"])

    def shared_only(batches):
        """Rows arrive sorted by key; the last row of a batch waits for the next."""
        wait = None
        for batch in batches:
            if wait is not None:
                batch = pa.Table.from_batches([wait[0], batch]).combine_chunks().to_batches()[0]
            else:
                wait = None, np.zeros(0, bool)
            key, salt = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(key):
                continue
            same = np.r_[False, key[1:] == key[:-1]]
            keep = same | np.r_[same[1:], False] | (salt > 0)
            if len(wait[1]):
                keep[0] |= wait[1][0]
            last = len(key) - 1
            yield batch.slice(0, last).filter(pa.array(keep[:last])).drop_columns(["salt"])
            wait = batch.slice(last), np.array([keep[last]])
        if wait is not None and wait[0] is not None and wait[1][0]:
            yield wait[0].drop_columns(["salt"])

    firsts = docs.mapInArrow(cut, f"id {kind}, h long, n long, first binary").filter("first IS NOT NULL")
    one = classes.select(F.col("id").alias("rep"), F.col("h").alias("rep_h"), F.col("n").alias("rep_n"), "node")
    own = firsts.join(one, F.col("id").eqNullSafe(F.col("rep")) & (F.col("h") == F.col("rep_h")) & (F.col("n") == F.col("rep_n")))
    rows = own.select("node", "n", "first").mapInArrow(spread, "key long, salt int, node long, n long, p long, pos long")
    rows = rows.repartition("key", "salt").sortWithinPartitions("key")
    return rows.mapInArrow(shared_only, "key long, node long, n long, p long, pos long")


def heavy_links(docs: DataFrame, classes: DataFrame, often: np.ndarray, limit: int, percent: int) -> DataFrame:
    """Links (a, b) that, with the stars among small sets, connect all linked classes one of which has ``limit`` shingles or more."""
    rows = hold(inverted_lists(docs, classes, often, -(-percent * limit // 100), percent), "lists")
    # the hub of a list: the member with most of its first shingles in lists, so that of an original and its edits it is the original
    share = hold(rows.groupBy("node").agg((F.count(F.lit(1)) / F.max("p")).alias("share")), "shares")
    known = hold(rows.join(share, "node"), "lists")
    release(rows)
    texts = class_texts(docs, classes, share)
    hubs = hold(known.groupBy("key").agg(F.max(F.struct("share", "node", "n", "p")).alias("h"))
                .select("key", F.col("h.node").alias("hub"), F.col("h.n").alias("m"), F.col("h.p").alias("q")), "hubs")
    met = (known.join(hubs, "key").filter((F.col("node") != F.col("hub")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
           .groupBy("hub", "node", "n", "p", "m", "q").agg(F.count(F.lit(1)).alias("k")))
    # what two sets share beyond the shorter of their listed parts is at most what is left of one of them
    likely = F.col("k") >= _overlap("n", "m", percent) - F.greatest(F.col("n") - F.col("p"), F.col("m") - F.col("q"))
    tested = hold(met.filter(likely).select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct(), "pairs")
    links = hold(compared(tested, texts, percent), "links")

    comp = components(links).select(F.col("id").alias("node"), "comp")
    now = known.select("key", "node", "n", "pos").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_keys = hold(now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("key"), "open")
    left = hold(now.join(open_keys, "key", "left_semi"), "open")
    again = hold(scanned(left, limit, percent).join(tested, ["a", "b"], "left_anti"), "pairs")
    return links.unionByName(compared(again, texts, percent))


def scanned(left: DataFrame, limit: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a list within what their two sizes leave open: of two linked sets of n and m, one of the first
    n - o + 1 shingles of the one is among the first m - o + 1 of the other. The larger set asks, at each of its places, only for the
    size classes that the place leaves open; so sets whose own shingles fill their first places never meet in a list of common ones."""
    width = float(np.log(1.05))
    size_class = lambda n: F.floor(F.log(n) / width)
    low, top = F.ceil(percent * F.col("n") / F.lit(100)), F.least("n", F.floor((100 + percent) * (F.col("n") - F.col("pos")) / F.lit(percent)) - F.col("n"))
    asking = (left.filter((F.col("n") >= limit) & (low <= top))
              .select("key", "node", "n", "pos", "comp", F.explode(F.sequence(size_class(low), size_class(top))).alias("class")))
    listed = left.filter(F.col("pos") <= F.col("n") - _overlap("n", "n", percent))
    listed = listed.select("key", size_class(F.col("n")).alias("class"), *[F.col(c).alias(c + "2") for c in ("node", "n", "pos", "comp")])
    o = _overlap("n", "n2", percent)
    meets = ((F.col("comp") != F.col("comp2")) & (100 * F.col("n2") >= percent * F.col("n")) & (F.col("pos") <= F.col("n") - o) & (F.col("pos2") <= F.col("n2") - o)
             & ((F.col("n2") < F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("node2") < F.col("node")))))
    pairs = asking.join(listed, ["key", "class"]).filter(meets)
    return pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def class_texts(docs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, text) of the classes in ``rows``, written once."""
    listed = rows.select("node").distinct()
    one = classes.join(listed, "node").select("node", F.col("id").alias("rep"), F.col("h").alias("rep_h"))
    return hold(docs.join(one, F.col("id").eqNullSafe(F.col("rep")) & (F.col("h") == F.col("rep_h"))).select("node", "text"), "texts", compression="zstd")


def compared(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    side = lambda s: texts.select(F.col("node").alias(s), F.col("text").alias("t" + s))
    return confirmed(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb"), percent, shingle_sets)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles`` and ``component_id``, the smallest id reachable over links, its own included.

    Sets are sets of 64-bit hashes of five-word shingles. Rows with equal sets are one class, known by a 128-bit name; two classes are linked at
    a similarity of ``percent`` or more, counted on full sets. Every row is a document, so rows that repeat an id are not linked by that.
    A row without an id takes part, and its component is the smallest id of the others (null if none has one). A null text, or one without words, has no
    shingles, is linked with nothing and is its own component. Further columns are not read; an empty table gives no rows. A very long text is
    one set in one task."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    base = hold(sets_of(source), "sets")
    often = slot_counts(base)
    rows = base.filter("slots IS NULL").select("id", "h", "n", "name", "small")
    first = F.min(F.struct(F.col("id").isNull(), "id", "h"))
    classes = (rows.filter("name IS NOT NULL").groupBy("name").agg(first.alias("r"), F.min("id").alias("low"), F.first("n").alias("n"), F.first("small").alias("small"))
               .select(F.monotonically_increasing_id().alias("node"), "name", "low", F.col("r.id").alias("id"), F.col("r.h").alias("h"), "n", "small"))
    classes = hold(classes, "classes")
    limit = boundary(classes, often, percent)
    links = light_links(classes, limit, percent).unionByName(heavy_links(source, classes, often, limit, percent))
    comp = components(links).select(F.col("id").alias("node"), "comp")
    placed = hold(classes.select("node", "name", "low").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "placed")
    groups = hold(placed.groupBy("comp").agg(F.min("low").alias("component_id")), "groups")
    labels = hold(placed.join(groups, "comp").select("name", "component_id"), "labels")
    out = rows.select("id", "n", "name").join(labels, "name", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))

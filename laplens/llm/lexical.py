"""Ranked lexical search with pipelined term partitioning.

Documents are cut into blocks of bounded size, and each block's postings for the terms of the items are packed into one row
per term. The terms are dealt to a few owners by weight, rare ones first, with about the same number of postings each. A bundle of
items then passes the owners one after the other: in each stage a block's accumulators (per item, sparse: documents and
integer scores) meet, in a cogroup, the postings that the stage owns, and take in their contributions. After the last stage each
block selects its best documents per item, and the best of all blocks are ranked.

Between stages an accumulator goes only if it provably cannot reach the item's k best: k documents of the block already score
more than it would with the largest contribution of every term still to come. Results are those of the full sum.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laplens.llm.common import text_of
from laplens.session import hold, ship

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: No term's contribution exceeds its weight times this.
TOP = 1_000_000
#: Bounds of what a task holds: items and distinct terms of a bundle, accumulators of a block, and words of a block.
ITEMS, TERMS, CELLS, WORDS = 1_024, 200_000, 1 << 22, 1 << 22
#: Row of a block's own figures among the rows of its terms.
SELF = -1

# UTF-8 bytes: letters A-Z in lower case, other ASCII except digits and letters as spaces, everything else as it is.
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: str) -> list[bytes]:
    """The terms of a text, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_PLAIN).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(code, item, terms): distinct items with a number of their own and their distinct terms, written once."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.array_distinct(F.regexp_extract_all(F.translate(text_of("text"), upper, upper.lower()), F.lit(TERM), F.lit(0)))
    own = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).distinct()
    return hold(own.select(F.monotonically_increasing_id().alias("code"), "item", words.alias("terms")), "items")


def postings(docs: DataFrame, vocabulary: dict[bytes, int], rows: int) -> DataFrame:
    """Blocks of at most ``rows`` documents: (block, term, size, total, at, tf, ids). A term's row holds the places of its
    documents in the block and its occurrences there. The row ``SELF`` holds the documents' ids and, in ``tf``, their lengths."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most the terms of one bundle
    kind = docs.schema["id"].dataType

    def pack(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        code = shared.value.get
        ids_type = pa.list_(to_arrow_type(kind))
        names = ["block", "term", "size", "total", "at", "tf", "ids"]
        block = TaskContext.get().partitionId() << 32

        def rows_of(ids, lengths, found):
            n = np.array(lengths, np.int64)
            cells = np.concatenate(found) if found else np.zeros(0, np.int64)
            cell, tf = np.unique(cells, return_counts=True)  # term above, place in the block below
            term, at, tf = cell >> 32, (cell & 0xFFFFFFFF).astype("<i4"), tf.astype("<i8")
            starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
            ends = np.r_[starts[1:], len(term)] if len(starts) else starts
            heads = term[starts].tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * (len(heads) + 1), pa.int64()), pa.array([SELF, *heads], pa.int32()),
                pa.array([int((n > 0).sum()), *(ends - starts).tolist()], pa.int64()), pa.array([int(n.sum()), *[0] * len(heads)], pa.int64()),
                pa.array([b"", *(at[a:b].tobytes() for a, b in zip(starts, ends))], pa.binary()),
                pa.array([n.astype("<i8").tobytes(), *(tf[a:b].tobytes() for a, b in zip(starts, ends))], pa.binary()),
                pa.array([ids, *[None] * len(heads)], ids_type)], names)

        ids, lengths, found, words = [], [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = terms_of(text or "")
                codes = np.fromiter(map(code, own, repeat(-1)), np.int64, len(own))
                codes = codes[codes >= 0]
                if len(codes):
                    found.append(codes << 32 | len(ids))
                ids.append(i)
                lengths.append(len(own))
                words += len(own)
                if len(ids) >= rows or words >= WORDS:
                    yield from rows_of(ids, lengths, found)
                    ids, lengths, found, words, block = [], [], [], 0, block + 1
        if ids:
            yield from rows_of(ids, lengths, found)

    return docs.mapInArrow(pack, f"block long, term int, size long, total long, at binary, tf binary, ids array<{kind.simpleString()}>")


def add_stage(state: DataFrame | None, owned: DataFrame, plan: list[tuple[int, list[tuple[int, int]], int]], n_docs: int, n_words: int,
              k: int) -> DataFrame:
    """One stage: accumulators (block, code, at, score) after the contributions of the terms in ``owned``.

    ``plan`` lists each item of the bundle: code, (term, weight) pairs of this stage, and the most that later stages can add."""
    shared = owned.sparkSession.sparkContext.broadcast(plan)  # bounded as the bundle is
    names = ["block", "code", "at", "score"]

    def advance(left, right):
        block = right.column("block")[0].as_py()
        where, often, n = {}, {}, None
        for term, at, tf in zip(*(right.column(c).to_pylist() for c in ("term", "at", "tf"))):
            if term == SELF:
                n = np.frombuffer(tf, "<i8")
            else:
                where[term], often[term] = np.frombuffer(at, "<i4"), np.frombuffer(tf, "<i8")
        m = 100 - 90 + (90 * n * n_docs) // max(n_words, 1)
        worth = {t: (1_000_000_000 * tf) // (1000 * tf + 8 * m[where[t]]) for t, tf in often.items()}
        before = dict(zip(left.column("code").to_pylist(), zip(left.column("at").to_pylist(), left.column("score").to_pylist()))) if left.num_rows else {}
        out = []
        for code, terms, rest in shared.value:
            score = np.zeros(len(n), np.int64)
            if code in before:
                at, value = before[code]
                score[np.frombuffer(at, "<i4")] = np.frombuffer(value, "<i8")
            for term, w in terms:
                if term in where:
                    score[where[term]] += w * worth[term]
            at = np.flatnonzero(score)
            if len(at) > k:
                own = score[at]
                at = at[own + rest >= np.partition(own, len(own) - k)[len(own) - k]]
            if len(at):
                out.append((block, code, at.astype("<i4").tobytes(), score[at].astype("<i8").tobytes()))
        columns = list(zip(*out)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names)

    if state is None:
        state = owned.sparkSession.createDataFrame([], "block long, code long, at binary, score binary")
    return state.groupBy("block").cogroup(owned.groupBy("block")).applyInArrow(advance, "block long, code long, at binary, score binary")


def best_of_blocks(state: DataFrame, heads: DataFrame, k: int) -> DataFrame:
    """(code, id, score): each block's best ``k`` documents of each item, equal scores by id, without an id last."""
    kind = heads.schema["ids"].dataType.elementType

    def select(left, right):
        from pyspark.sql.pandas.types import to_arrow_type

        ids = right.column("ids")[0].as_py() if right.num_rows else []
        out = []
        for code, at, score in zip(*(left.column(c).to_pylist() for c in ("code", "at", "score"))):
            found = zip(np.frombuffer(score, "<i8").tolist(), np.frombuffer(at, "<i4").tolist())
            best = sorted(found, key=lambda f: (-f[0], ids[f[1]] is None, ids[f[1]] if ids[f[1]] is not None else 0))[:k]
            out += [(code, ids[a], s) for s, a in best]
        columns = list(zip(*out)) or [[]] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), to_arrow_type(kind), pa.int64()))], ["code", "id", "score"])

    return state.groupBy("block").cogroup(heads.groupBy("block")).applyInArrow(select, f"code long, id {kind.simpleString()}, score long")


def search_bundle(docs: DataFrame, bundle: DataFrame, k: int, stages: int) -> DataFrame | None:
    """(code, id, score) with each block's best for the items of one bundle; None where no item has a term."""
    items = [(r.code, [t.encode() for t in r.terms]) for r in bundle.collect()]  # a bundle, of bounded size
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    if not vocabulary:
        return None
    rows = hold(postings(docs, vocabulary, max(CELLS // len(items), 64)), "postings")
    figures = {r.term: r for r in rows.groupBy("term").agg(F.sum("size").alias("size"), F.sum("total").alias("total")).collect()}  # one per term
    if SELF not in figures:
        return None
    n_docs, n_words = figures[SELF].size, figures[SELF].total
    df = {t: f.size for t, f in figures.items() if t != SELF}
    weights = {t: w for t in df if (w := weight(n_docs, df[t])) > 0}
    owner, seen, mass = {}, 0, sum(df[t] for t in weights)
    for t in sorted(weights, key=lambda t: (df[t], t)):
        owner[t] = min(stages * seen // mass, stages - 1)
        seen += df[t]
    coded = [(code, [vocabulary[t] for t in terms if vocabulary[t] in weights]) for code, terms in items]
    state = None
    for stage in sorted(set(owner.values())):
        plan = [(code, [(t, weights[t]) for t in terms if owner[t] == stage], sum(TOP * weights[t] for t in terms if owner[t] > stage))
                for code, terms in coded]
        own = [t for t in owner if owner[t] == stage]
        here = docs.sparkSession.createDataFrame([(t,) for t in [SELF, *own]], "term int")
        owned = rows.join(here, "term", "left_semi").select("block", "term", "at", "tf")
        state = hold(add_stage(state, owned, plan, n_docs, n_words, k), "accumulators")
    return None if state is None else best_of_blocks(state, rows.filter(F.col("term") == SELF).select("block", "ids"), k)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, stages: int = 4, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Each item's ``k`` best documents with a score above 0: item, ``rank`` (from 1), id and ``score``, equal scores by id.

    A term's weight falls with the documents that hold it, and its contribution grows with its occurrences and falls with the
    document's length, all in 64-bit integers. Every row of ``docs`` is a document, repeated ids included; without an id it ranks
    last among equal scores. A null text has no terms. Distinct rows of ``items`` (item and text) are ranked each by itself, equal ones
    once; an item without terms, or whose terms no document holds, has no rows. Further columns are not read. Very long texts are
    one document as others; a task holds one block of them. Items beyond ``ITEMS`` or ``TERMS`` go in several bundles, each a pass."""
    own_items = item_terms(items, item_col, item_text_col)
    n_items, n_terms = own_items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    bundles = max(1, -(-2 * n_items // ITEMS) if n_items > ITEMS else 1, -(-2 * n_terms // TERMS) if n_terms > TERMS else 1)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    found = docs.sparkSession.createDataFrame([], f"code long, id {kind}, score long")
    for b in range(bundles):
        best = search_bundle(source, own_items.filter(F.pmod(F.xxhash64("code"), F.lit(bundles)) == b), k, stages)
        found = found if best is None else found.unionByName(best)
    order = Window.partitionBy("code").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(own_items.select("code", F.col("item").alias(item_col)), "code").select(item_col, "rank", F.col("id").alias(id_col), "score")

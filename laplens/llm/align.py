"""Alignment of the tokens of two tokenizers, by lockstep merging.

Both tokenizations of a text cover the same bytes. Walking along both, a cut is where a token of each ends at the same byte; the
tokens between two cuts are a group, and every token of A in it is linked with every token of B in it. All documents of a batch are walked at
once: one NumPy state holds the pointers into A and B of all of them, each step moves the pointer that is behind, or both at a cut,
which emits the group that ends there, and documents that have ended leave the state. A long document is walked in several lanes at once: a
space between two other characters always begins a token in both tokenizers, so lanes may begin there.

Corpus counts of id pairs are added up from blocks of documents. Each block then asks for the counts of its own distinct
pairs, so what is joined is one row per block and pair, and not per document and pair.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laplens.llm.tokens import _byte_letters
from laplens.session import hold, ship

MARK = "▁"
#: Words of a lane, characters of a batch, remembered words (each of at most WORD characters), links expanded at a time, and
#: distinct pairs of a block of documents. They only bound memory.
LANE, CHARS, MEMO, WORD, LINKS, PAIRS = 64, 1 << 20, 400_000, 64, 1 << 21, 1 << 22

#: A space between two other characters.
_CUT = re.compile(r"(?<=\S) (?=\S)").split


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b_from: np.ndarray) -> np.ndarray:
    """Groups of all lanes as rows (first A, last A, first B, last B), in the order of A. ``a_ends`` and ``b_ends`` are the bytes up to the
    end of each token, over all lanes together; a lane has the tokens from ``a_from`` to before ``a_to`` and the same bytes on both sides."""
    some = a_to > a_from
    i, j, last = a_from[some], b_from[some], a_to[some]
    a_first, b_first = i.copy(), j.copy()
    out = [np.zeros((4, 0), np.int64)]
    while len(i):
        x, y = a_ends[i], b_ends[j]
        cut = x == y
        out.append(np.stack([a_first[cut], i[cut], b_first[cut], j[cut]]))
        i, j = i + (x <= y), j + (y <= x)
        a_first, b_first = np.where(cut, i, a_first), np.where(cut, j, b_first)
        open_ = i < last
        if not open_.all():
            i, j, last, a_first, b_first = (v[open_] for v in (i, j, last, a_first, b_first))
    groups = np.concatenate(out, axis=1)
    return groups[:, np.argsort(groups[0], kind="stable")]


class Aligner:
    """Both tokenizers in one worker, and what it remembers of words."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
            raise ValueError("A must be a byte-level tokenizer without normaliser or prefix space")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letters = _byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for piece, i in spec["model"]["vocab"].items():
            self.a_bytes[i] = bytes(letters[c] for c in piece)
        self.b = m = SentencePieceProcessor(model_file=b_path)
        if m.normalize("a  b ") != MARK + "a" + MARK * 2 + "b" + MARK:
            raise ValueError("B must keep all spaces and put one before the text")
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("B must begin a token at each space after another character")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.n_b = len(self.b_bytes)
        # Each id as text with what follows it: within a side, at its end.
        width = len(str(max(len(self.a_bytes), self.n_b))) + 1
        self.width = width
        self.said = [np.array([f"{i}{end}" for end in ends for i in range(n)], f"S{width}")
                     for n, ends in ((len(self.a_bytes), ",|"), (self.n_b, ",;"))]
        self.a_word: dict[str, bytes | None] = {}
        self.b_word: dict[str, bytes | None] = {}

    def learn(self, words: set[str]) -> list[str]:
        """Learn the ids of both sides for each word that follows a space; None where they do not spell it. Returns the new words that are
        too long to be remembered."""
        if len(self.a_word) > MEMO:
            self.a_word, self.b_word = {}, {}
        new = list(words.difference(self.a_word))
        coded = self.a.encode_batch_fast([" " + w for w in new], add_special_tokens=False)
        a_new, b_new = {}, {}
        for w, a, b in zip(new, coded, self.b.encode(new, num_threads=1)):
            a, raw = a.ids, (" " + w).encode("utf-8", "replace")
            good = b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
            a_new[w], b_new[w] = (np.array(a, "<i4").tobytes(), np.array(b, "<i4").tobytes()) if good else (None, None)
        long = [w for w in new if len(w) > WORD]
        self.a_word.update(a_new)
        self.b_word.update(b_new)
        return long

    def align(self, texts: list[str | None]) -> list[tuple]:
        """For each text: n_a, n_b, n_groups, n_links, digest, and the distinct linked id pairs with their numbers of links."""
        cut = [_CUT(t) if t else [] for t in texts]
        long = self.learn(set().union(*cut))
        a_of, b_of = self.a_word.__getitem__, self.b_word.__getitem__
        a_parts, b_parts, owner = [], [], []
        for d, words in enumerate(cut):
            try:
                own = [(b"".join(map(a_of, words[k: k + LANE])), b"".join(map(b_of, words[k: k + LANE]))) for k in range(0, len(words), LANE)]
            except TypeError:  # a word that is not spelt the same
                continue
            for a, b in own:
                a_parts.append(a)
                b_parts.append(b)
                owner.append(d)
        for w in long:
            del self.a_word[w], self.b_word[w]
        a_ids, b_ids = np.frombuffer(b"".join(a_parts), "<i4"), np.frombuffer(b"".join(b_parts), "<i4")
        a_cut, b_cut = (np.cumsum([0, *(len(p) // 4 for p in parts)]) for parts in (a_parts, b_parts))
        groups = lockstep(np.cumsum(self.a_len[a_ids]), np.cumsum(self.b_len[b_ids]), a_cut[:-1], a_cut[1:], b_cut[:-1])
        lanes, n = np.array(owner, np.int64), len(texts)
        n_a, n_b = (np.bincount(lanes, np.diff(c), n).astype(np.int64) for c in (a_cut, b_cut))
        doc = np.repeat(lanes, np.diff(a_cut))[groups[0]]
        p, q = groups[1] - groups[0] + 1, groups[3] - groups[2] + 1
        n_groups = np.bincount(doc, minlength=n)
        n_links = np.zeros(n, np.int64)
        np.add.at(n_links, doc, p * q)
        digests = self.digests(a_ids, b_ids, p, q, n_a, n_b)
        keys, times = self.pairs(a_ids, b_ids, groups, doc)
        ends = np.searchsorted(keys[0], np.arange(n + 1))
        return [(*row, keys[1][s:e], times[s:e]) for *row, s, e in
                zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), digests, ends[:-1].tolist(), ends[1:].tolist())]

    def digests(self, a_ids, b_ids, p, q, n_a, n_b) -> list[str]:
        """SHA-256 of each text's groups as written text."""
        base = np.cumsum(p + q) - (p + q)  # place of each group's first token when both sides are told in turn
        a_last, b_last = np.zeros(len(a_ids), bool), np.zeros(len(b_ids), bool)
        a_last[np.cumsum(p) - 1], b_last[np.cumsum(q) - 1] = True, True
        text = np.empty(len(a_ids) + len(b_ids), f"S{self.width}")
        text[np.arange(len(a_ids)) + np.repeat(base - (np.cumsum(p) - p), p)] = self.said[0][a_ids + a_last * len(self.a_bytes)]
        text[np.arange(len(b_ids)) + np.repeat(base + p - (np.cumsum(q) - q), q)] = self.said[1][b_ids + b_last * self.n_b]
        raw, at = memoryview(text.view(np.uint8)), 0
        out = []
        for n in (n_a + n_b).tolist():
            end = at + n * self.width
            out.append(hashlib.sha256(bytes(raw[at:end]).translate(None, b"\0")[:-1]).hexdigest() if n else "")
            at = end
        return out

    def pairs(self, a_ids, b_ids, groups, doc) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, pair key), sorted, and the links of each. Groups of one token on a side, or few on both, are expanded
        together; a large one is counted by its distinct ids, so nothing grows with the product of its sides."""
        p, q = groups[1] - groups[0] + 1, groups[3] - groups[2] + 1
        small = np.flatnonzero(p * q <= 1024)
        docs_, keys_, times_ = [], [], []
        at = 0
        size = np.cumsum(p[small] * q[small])
        while at < len(small):  # LINKS links at a time
            done = size[at - 1] if at else 0
            to = max(int(np.searchsorted(size, done + LINKS, "right")), at + 1)
            g = small[at:to]
            n = p[g] * q[g]
            row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(q[g], n)
            a = a_ids[np.repeat(groups[0][g], n) + row // width].astype(np.int64)
            b = b_ids[np.repeat(groups[2][g], n) + row % width]
            docs_.append(np.repeat(doc[g], n))
            keys_.append(a * self.n_b + b)
            times_.append(np.ones(len(a), np.int64))
            at = to
        for g in np.flatnonzero(p * q > 1024):
            a, ta = np.unique(a_ids[groups[0][g]: groups[1][g] + 1], return_counts=True)
            b, tb = np.unique(b_ids[groups[2][g]: groups[3][g] + 1], return_counts=True)
            docs_.append(np.full(len(a) * len(b), doc[g]))
            keys_.append((a.astype(np.int64)[:, None] * self.n_b + b).ravel())
            times_.append((ta[:, None] * tb).ravel())
        if not docs_:
            return np.zeros((2, 0), np.int64), np.zeros(0, np.int64)
        both = np.concatenate(docs_) << 33 | np.concatenate(keys_)  # two vocabularies of at most 2**16 and 2**17 ids
        if len(times_) and all(len(t) == 0 or t.max() == 1 for t in times_):
            both, times = np.unique(both, return_counts=True)
        else:
            both, inverse = np.unique(both, return_inverse=True)
            times = np.zeros(len(both), np.int64)
            np.add.at(times, inverse, np.concatenate(times_))
        return np.stack([both >> 33, both & ((1 << 33) - 1)]), times


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """Loaded once in a worker that serves several tasks."""
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Aligner(a_path, b_path)
    return _LOADED[a_path, b_path]


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, block, keys, times) for each row (id, text). A block is a run of rows of
    one task with about ``PAIRS`` distinct pairs per document in all."""
    ship(docs.sparkSession)
    kind = docs.schema["id"].dataType.simpleString()

    def parts(batch):
        """Runs of rows of about CHARS characters."""
        at, size = 0, 0
        for i, n in enumerate(map(len, (t or "" for t in batch.column(1).to_pylist()))):
            if size and size + n > CHARS:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n
        if at < batch.num_rows:
            yield batch.slice(at)

    def run(batches):
        from pyspark import TaskContext

        own = aligner(a_path, b_path)
        narrow = "<i4" if len(own.a_bytes) * own.n_b < 1 << 31 else "<i8"
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in parts(batch):
                rows = own.align(part.column(1).to_pylist())
                where = []
                for r in rows:
                    if held and held + len(r[5]) > PAIRS:
                        block, held = block + 1, 0
                    where.append(block)
                    held += len(r[5])
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()), pa.array(where, pa.int64()),
                    pa.array([k.astype(narrow).tobytes() for k in columns[5]], pa.binary()),
                    pa.array([t.astype("<i4" if narrow == "<i4" else "<i8").tobytes() for t in columns[6]], pa.binary())],
                    ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "keys", "times"])

    return docs.mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                "block long, keys binary, times binary")


def block_pairs(coded: DataFrame, kind: str) -> DataFrame:
    """(block, key, n): the distinct pairs of each block and the documents of it that hold them."""

    def count(batches):
        block, held = None, []

        def out():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(keys), 1 << 17):
                part = keys[at: at + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part.astype(np.int64)),
                                                  pa.array(n[at: at + (1 << 17)].astype(np.int64))], ["block", "key", "n"])

        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b != block:
                    if held:
                        yield from out()
                    block, held = b, []
                if raw:
                    held.append(np.frombuffer(raw, kind))
        if held:
            yield from out()

    return coded.select("block", "keys").mapInArrow(count, "block long, key long, n long")


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``, ``n_best`` (links whose pair is in as many
    documents as any pair of its A id), ``count_sum`` (documents that hold the pair, over all links) and ``groups_sha256``.

    ``a_path`` is a byte-level tokenizer's file, ``b_path`` a sentencepiece model that marks spaces and has byte pieces; every worker can read
    both. Special strings in texts are plain text. A null or empty text, and one that either tokenizer does not spell byte for byte, has no
    tokens: zeros and an empty digest. Each row is a document, repeated ids, equal texts and rows without an id included. Further columns are
    not read. An empty table gives no rows. A very long text is walked in many lanes; the task holds its tokens."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = aligner(a_path, b_path)
    n_b, narrow = own.n_b, "<i4" if len(own.a_bytes) * own.n_b < 1 << 31 else "<i8"
    if len(own.a_bytes) > 1 << 16 or n_b > 1 << 17:
        raise ValueError("vocabularies of more than 65,536 (A) or 131,072 (B) ids are not supported")
    kind = source.schema["id"].dataType.simpleString()
    coded = hold(aligned(source, a_path, b_path), "aligned", compression="zstd")
    asked = hold(block_pairs(coded, narrow), "pairs")
    # at most n_b rows share an A id
    a_id = F.floor(F.col("key") / n_b)
    counts = asked.groupBy("key").agg(F.sum("n").alias("docs"))
    counts = hold(counts.withColumn("best", F.max("docs").over(Window.partitionBy(a_id)) == F.col("docs")), "counts")
    answers = asked.select("block", "key").join(counts, "key")

    def fill(left, right):
        order = np.argsort(key := right.column("key").to_numpy())
        key, total, best = (x[order] for x in (key, right.column("docs").to_numpy(), right.column("best").to_numpy()))
        sums, bests = [], []
        for raw, often in zip(left.column("keys").to_pylist(), left.column("times").to_pylist()):
            at, times = np.searchsorted(key, np.frombuffer(raw, narrow)), np.frombuffer(often, narrow).astype(np.int64)
            sums.append(int((times * total[at]).sum()) if len(at) else 0)
            bests.append(int(times[best[at].astype(bool)].sum()) if len(at) else 0)
        columns = ["id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table([*(left.column(c) for c in columns), pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), left.column("groups_sha256")],
                        [*columns, "n_best", "count_sum", "groups_sha256"])

    filled = coded.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        fill, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return filled.withColumnRenamed("id", id_col)

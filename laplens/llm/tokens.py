"""Token counts with a whole-token shortcut, for byte-level BPE tokenizers.

Before any text is read, every string of the vocabulary is encoded alone by the library; those that come out as
one token are proven whole. A text is cut into pre-tokens; a whole one counts one token without merging. Only the
others are merged, by the library, and the result is remembered.
"""

from __future__ import annotations

import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laplens.session import ship

#: Texts cut at a time, and pre-token costs remembered by a worker (twice as many at most); both only bound memory.
BLOCK = 256
MEMO = 500_000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves,
    the others follow from 256 on in their order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str):
    """The library's tokenizer, single-threaded, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def prove_whole(path: str) -> tuple[frozenset[str], list[str]]:
    """Vocabulary strings that encode alone as exactly one token, and the special strings. Bounded by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
        raise ValueError("only byte-level tokenizers without normaliser or prefix space can be cut this way")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that depend on their surroundings are not supported")
    special = [t["content"] for t in spec["added_tokens"]]
    letters, strings = _byte_letters(), []
    for piece in spec["model"]["vocab"]:
        try:
            strings.append(bytes(letters[c] for c in piece).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):  # part of a character: no text has it as a pre-token
            continue
    strings = [s for s in strings if s and not any(x in s for x in special)]
    alone = load(path).encode_batch_fast(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, alone) if len(e.ids) == 1), special


class Counter:
    """Token counts in one worker.

    A single space between two other characters always begins a pre-token, so a text without neighbouring white space is cut
    at its spaces, and what follows a space is counted once and remembered. Other texts are cut into pre-tokens as a whole."""

    # Fixed value: the pre-token pattern of this kind of tokenizer.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str, whole: frozenset[str], special: list[str]):
        import regex

        self.cut = regex.compile(self.PATTERN).findall
        self.parts = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.crowded = re.compile(r"\s\s").search
        self.special, self.tokenizer, self.whole = special, load(path), whole
        self.cost: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def learn(self, chunks: set[str]) -> None:
        """Remember the cost of each chunk: one token per whole pre-token, and merges for the rest."""
        older, cost = self.older, self.cost
        if len(cost) > MEMO:
            self.older, self.cost = older, cost = cost, {}
        new = []
        for c in chunks.difference(cost):
            if c in older:
                cost[c] = older[c]
            else:
                new.append(c)
        pre = [self.cut(c) for c in new]
        rest = list(set().union(*pre).difference(self.whole))
        merged = {s: len(e) for s, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))}
        for c, p in zip(new, pre):
            cost[c] = sum(merged.get(x, 1) for x in p)

    def chunks(self, text: str) -> list[str]:
        if self.crowded(text):
            return self.cut(text)
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)] if first else [*map(" ".__add__, rest)]

    def counts(self, texts: list[str]) -> list[int]:
        cut, extra = [], []
        for text in texts:
            if any(s in text for s in self.special):
                extra.append(len(self.parts.findall(text)))
                cut.append([c for part in self.parts.split(text) for c in self.chunks(part)])
            else:
                extra.append(0)
                cut.append(self.chunks(text))
        self.learn(set().union(*cut))
        cost = self.cost.__getitem__
        return [n + sum(map(cost, c)) for n, c in zip(extra, cut)]


_LOADED: dict[str, Counter] = {}


def counter(path: str, whole: frozenset[str], special: list[str]) -> Counter:
    """Loaded once in a worker that serves several tasks."""
    if path not in _LOADED:
        _LOADED[path] = Counter(path, whole, special)
    return _LOADED[path]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``tokenizer`` is the path of a tokenizer file, readable by every worker. Counts are the library's, special strings inside texts
    included, without added begin or end tokens. A null text is empty and has 0 tokens. Repeated rows are counted each. Further
    columns are not read. An empty table gives no rows."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(prove_whole(tokenizer))  # at most the vocabulary

    def count(batches):
        own = counter(tokenizer, *shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(own.counts(texts), pa.int64())],
                    ["id", "n_bytes", "n_tokens"])

    counted = source.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

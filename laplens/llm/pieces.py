"""SentencePiece encoding and decoding over a trie of marked words.

The distinct marked words of a block of texts are sorted and walked depth-first, as a trie. Every prefix has
one forward state, which depends on the prefix alone, so it is computed once and serves all words that begin with
it. For merge models (BPE) the state of a prefix is the last piece of its encoding: it is the one suffix of
the prefix that is a piece, follows the encoding of what is before it, and is compatible with the piece there, that is,
the two encode as themselves. This replaces the maximum of summed scores of the Viterbi recursion, which gives the
pieces of unigram models but not those of merge models.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laplens.session import ship

MARK = "▁"
#: Texts handled together, words a worker remembers (twice as many at most) and first pieces of remembered pairs;
#: they only bound memory.
BLOCK = 256
MEMO = 400_000
PAIRS = 30_000


class Pieces:
    """One model in one worker: vocabulary, remembered words, encoder and decoder."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.byte_ids, self.bytes_of, self.piece_id, self.scores = {}, [], {}, []
        for i in range(n):
            piece = m.id_to_piece(i)
            self.scores.append(m.get_score(i))
            if m.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(MARK, " ").encode())
                self.piece_id[piece] = i
        self.unknown = m.unk_id()
        # Words may be cut before a mark where no piece has one after another character.
        self.inner_mark = any(MARK in p.lstrip(MARK) for p in self.piece_id)
        self.codes = {p: np.array([i], "<i4").tobytes() for p, i in self.piece_id.items()}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.said: dict[bytes, bytes] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.learn_merges()

    # -- merges ---------------------------------------------------------------------------------

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merge encoding of a short string, by definition: the best-scored pair first, the leftmost among equals. And the last
        pair merged."""
        parts, final = list(text), None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                t = self.piece_id.get(parts[i] + parts[i + 1])
                if t is not None and (best is None or self.scores[t] > best):
                    best, at = self.scores[t], i
            if at < 0:
                break
            final = parts[at], parts[at + 1]
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts, final

    def learn_merges(self) -> None:
        """How each piece is made, and a trie of the reversed pieces that encode as themselves."""
        self.made, self.late, self.tail = {}, {}, {}
        for piece, i in self.piece_id.items():
            if len(piece) > 1:
                parts, final = self.merged(piece)
                if parts != [piece]:
                    continue
                self.made[piece] = final
                self.late[piece] = -self.scores[i]
            node = self.tail
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = piece
        # Taking a pair apart from its end backwards needs merges that come after those of their parts, each at its own rank.
        counts: dict[float, int] = {}
        for r in self.late.values():
            counts[r] = counts.get(r, 0) + 1
        self.plain = {p for p, (a, b) in self.made.items()
                      if counts[self.late[p]] == 1 and all(len(x) == 1 or self.late[x] < self.late[p] for x in (a, b))}

    def compatible(self, before: str, piece: str) -> bool:
        """Do the two, in this order, encode as themselves? Undo the later of the merges at the seam, again and again: had a merge
        over the seam come before it, the encoding would differ."""
        if not ((len(before) == 1 or before in self.plain) and (len(piece) == 1 or piece in self.plain)):
            return self.merged(before + piece)[0] == [before, piece]
        vocabulary, scores, late = self.piece_id, self.scores, self.late
        limit, strict = float("inf"), True
        while True:
            over = vocabulary.get(before + piece)
            if over is not None and (-scores[over] < limit or not strict and -scores[over] == limit):
                return False
            a, b = late.get(before, -1.0), late.get(piece, -1.0)
            if a > b:
                limit, strict, before = a, True, self.made[before][1]
            elif b < 0:
                return True
            else:  # the merge over the seam lies further left, so it goes first at equal rank
                limit, strict, piece = b, False, self.made[piece][0]

    def walk(self, words: list[str]) -> None:
        """Encode sorted distinct words depth-first; ``last[j]`` is the last piece of the encoding of the first j characters."""
        last: list[str] = [""]
        prior, tail, pairs, compatible, none = "", self.tail, self.pairs, self.compatible, {}
        if len(pairs) > PAIRS:
            pairs.clear()
        for word in words:
            shared = 0
            for a, b in zip(prior, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1:]
            for j in range(shared + 1, len(word) + 1):
                node, i, fits = tail, j, []
                while i and (node := node.get(word[i - 1])):
                    i -= 1
                    if "" in node:
                        fits.append((i, node[""]))
                found = word[j - 1]  # a single character follows when no longer piece does
                for i, piece in reversed(fits):
                    if i == 0:
                        found = piece
                        break
                    before = last[i]
                    own = pairs.get(before)
                    if own is None:
                        own = pairs[before] = {}
                    ok = own.get(piece)
                    if ok is None:
                        ok = own[piece] = compatible(before, piece)
                    if ok:
                        found = piece
                        break
                last.append(found)
            prior = word
            out, j = [], len(word)
            while j:
                out.append(last[j])
                j -= len(last[j])
            self.words[word] = self.packed(out)

    def packed(self, parts: list[str]) -> bytes:
        """The ids of pieces given from the last to the first, as bytes."""
        return b"".join(map(self.code, reversed(parts)))

    def code(self, piece: str) -> bytes:
        known = self.codes.get(piece)
        if known is None:  # a character outside the vocabulary
            ids = [self.byte_ids[b] for b in piece.encode()] if self.byte_ids else [self.unknown]
            known = self.codes[piece] = np.array(ids, "<i4").tobytes()
        return known

    # -- texts ----------------------------------------------------------------------------------

    def marked(self, text: str) -> list[str]:
        """The normalised text, cut before each run of marks that follows another character."""
        if not text:
            return []
        norm = self.model.normalize(text)
        if self.inner_mark:
            return [norm]
        parts = norm.split(MARK)
        words, run = [], 0
        if parts[0]:
            words.append(parts[0])
        for p in parts[1:]:
            run += 1
            if p:
                words.append(MARK * run + p)
                run = 0
        if run:
            words.append(MARK * run)
        return words

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether they decode to it."""
        if len(self.words) > MEMO:
            self.older, self.words = self.words, {}
        cut = list(map(self.marked, texts))
        new = set().union(*cut).difference(self.words)
        again = new.intersection(self.older)
        self.words.update((w, self.older[w]) for w in again)
        self.walk(sorted(new - again))
        known = self.words.__getitem__
        coded = [list(map(known, words)) for words in cut]
        same = [self.spoken(ids) == t for ids, t in zip(coded, texts)]
        return [np.frombuffer(b"".join(ids), "<i4") for ids in coded], same

    def spoken(self, words: list[bytes]) -> str:
        """What :meth:`decode` says of the ids of words, given as bytes. The ids of each distinct word are decoded once and remembered."""
        said = self.said
        for ids in set(words).difference(said):
            said[ids] = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<i4")))
        text = self.unspaced(b"".join(map(said.__getitem__, words)))
        if len(said) > MEMO:
            said.clear()
        return text

    def decode(self, ids) -> str:
        """The text of ids: bytes of their pieces, marks as spaces, without the space that encoding puts before the text."""
        return self.unspaced(b"".join(map(self.bytes_of.__getitem__, ids)))

    @staticmethod
    def unspaced(raw: bytes) -> str:
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The model, loaded once in a worker that serves several tasks."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``ids`` (array of int), ``n_tokens`` and ``round_trip`` (the ids decode to the text).

    ``model`` is the path of a model file, readable by every worker. A null text is empty, and an empty text has no ids. Repeated rows
    are encoded each. Further columns are not read. An empty table gives no rows. ``round_trip`` is false where the model's
    normalisation changes a text or an unknown character has no byte pieces."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        own = pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                texts = [t or "" for t in part.column(1).to_pylist()]
                coded, same = own.encode(texts)
                ends = np.cumsum([0, *map(len, coded)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*coded, np.zeros(0, "<i4")]), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(np.diff(ends), pa.int64()), pa.array(same, pa.bool_())],
                                                 ["id", "ids", "n_tokens", "round_trip"])

    return source.mapInArrow(run, f"id {kind}, ids array<int>, n_tokens long, round_trip boolean").withColumnRenamed("id", id_col)


def decode_ids(coded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``coded``: id and ``text``. Null ids give a null text, no ids an empty one."""
    ship(coded.sparkSession)
    source = coded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        own = pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                texts = [None if i is None else own.decode(i) for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return source.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)

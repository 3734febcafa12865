"""Set joins, ranked search and token alignment against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from laplens.llm import align, lexical, setjoin
from laplens.llm.common import tokenizer_file
from laplens.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


# -- set join ---------------------------------------------------------------------------------------

def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i: i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def linked_components(rows, percent=80):
    """[(id, n, smallest id of the component)] by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return [(d, len(sets[i]), min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 9)}"
    return words


def set_rows():
    rng = random.Random(5)
    rows, passage = [], [f"p{i}" for i in range(60)]
    for length in (5, 6, 7, 9, 12, 14, 16, 20, 24, 40, 90, 400):
        for _ in range(4):
            base = [f"w{rng.randrange(10 ** 6)}" for _ in range(length)]
            rows += [" ".join(base), " ".join(base).upper(), " ".join(base[:-1]), " ".join(base[1:]), " ".join(base + ["end"])]
            rows += [" ".join(edited(rng, base, k)) for k in (1, 1, 2, 3)]
    rows += [" ".join([f"u{rng.randrange(10 ** 9)}" for _ in range(80)] + passage) for _ in range(15)]  # a shared passage
    rows += ["a b c", "A  b\nc", "a b", "", " \t", None, None, "one", "one", "a a a a a a a a"]
    rng.shuffle(rows)
    return [(i if i % 17 else None, t) for i, t in enumerate(rows)] + [(3, rows[4]), (3, rows[4])]


@pytest.mark.parametrize("limit", [None, 1, 8, setjoin.SMALL + 1])
def test_set_join_equals_all_pairs(spark, monkeypatch, limit):
    rows = set_rows()
    if limit:
        monkeypatch.setattr(setjoin, "boundary", lambda *_: limit)
        monkeypatch.setattr(setjoin, "HOT", 2)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, node string, n int")
    got = Counter(tuple(r) for r in setjoin.jaccard_join(docs).collect())
    assert got == Counter(linked_components(rows))


def test_edits_of_one_original_are_one_component(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base if i == 77 else edited(rng, base, 6))) for i in range(150)]
    want = linked_components(rows)
    assert len({c for *_, c in want}) < 10  # most are linked with the original only
    got = setjoin.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_the_boundary_follows_cost(spark):
    one = lambda n: np.arange(1, n + 1, dtype=np.uint64).tobytes()
    classes = spark.createDataFrame([(bytearray(one(n)),) for n in (4, 5, 6, 12, 18)], "small binary")
    rare, hot = np.zeros(setjoin.SLOTS, np.int64), np.zeros(setjoin.SLOTS, np.int64)
    hot[:64] = 10 ** 6
    # in crowded lists all sets up to 12 go by subsets; 18 is listed in any case, as a partner of larger ones
    assert setjoin.boundary(classes, rare, 80) < setjoin.boundary(classes, hot, 80) == 16


def test_set_join_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert setjoin.jaccard_join(docs).collect() == []
    assert setjoin.jaccard_join(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect() == [(1, 0, 1)]


# -- ranked search ----------------------------------------------------------------------------------

def ranked(docs, items, k=10):
    cut = lambda t: re.findall(lexical.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    terms = [Counter(cut(t)) for _, t in docs]
    n_docs, words = sum(1 for t in terms if t), sum(sum(t.values()) for t in terms)
    df = Counter(w for t in terms for w in t)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for (d, _), own in zip(docs, terms):
            m = 100 - 90 + (90 * sum(own.values()) * n_docs) // max(words, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10 ** 9 * own[w]) // (1000 * own[w] + 8 * m))
                        for w in set(cut(text)) if w in own)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k])]
    return Counter(out)


def search_rows():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdE", k=rng.choice([1, 2, 2, 3])))
    docs = [(i if i % 13 else None, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(300)]
    docs += [(1000 + i, "the same text, again") for i in range(30)] + [(5, docs[5][1]), (400, None), (401, ""), (402, "--- !!"), (403, "Ärger ÄRGER été x1 " * 3000)]
    items = [(i, " ".join(word() for _ in range(12))) for i in range(25)]
    items += [(50, "Same again"), (51, None), (52, ""), (53, "nowhere-found"), (54, "Ärger"), (None, "ab ac"), (50, "Same again"), (50, "été")]
    return docs, items


@pytest.mark.parametrize("stages,k,small", [(1, 10, False), (4, 10, True), (7, 3, True)])
def test_search_equals_scoring_everything(spark, monkeypatch, stages, k, small):
    docs, items = search_rows()
    if small:  # several bundles, many blocks
        monkeypatch.setattr(lexical, "ITEMS", 10)
        monkeypatch.setattr(lexical, "CELLS", 512)
    left = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, rank int")
    right = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, code int")
    got = lexical.lexical_search(left, right, k, stages)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == ranked(docs, items, k)


def test_search_in_nothing_and_for_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical.lexical_search(none, items).collect() == []
    assert lexical.lexical_search(docs, items.limit(0)).collect() == []


# -- alignment --------------------------------------------------------------------------------------

def aligned(texts):
    """Rows without id, by the definition: both encodings of whole texts, cuts by set intersection."""
    own = align.Aligner(tokenizer_file(A), tokenizer_file(B))
    parts, held = [], Counter()
    for t in texts:
        raw, groups = (" " + (t or "")).encode(), []
        a = own.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = own.b.encode(t) if t else []
        a_ends, b_ends = np.cumsum([len(own.a_bytes[i]) for i in a]), np.cumsum([len(own.b_bytes[i]) for i in b])
        if t and b"".join(own.a_bytes[i] for i in a) == raw == b"".join(own.b_bytes[i] for i in b):
            x = y = 0
            for end in sorted(set(a_ends.tolist()) & set(b_ends.tolist())):
                i, j = np.searchsorted(a_ends, end) + 1, np.searchsorted(b_ends, end) + 1
                groups.append((a[x:i], b[y:j]))
                x, y = i, j
        links = Counter((i, j) for p, q in groups for i in p for j in q)
        held.update(links.keys())
        parts.append((groups, links))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    for groups, links in parts:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        yield (sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), sum(links.values()),
               sum(m for pair, m in links.items() if held[pair] == best[pair[0]]), sum(m * held[pair] for pair, m in links.items()),
               hashlib.sha256(text.encode()).hexdigest() if groups else "")


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["", None, " ", "  a", "a  b ", "\n\nx\ty", "▁ab", "日本語 テキスト 🎉🎉🎉", "<|endoftext|> <s> </s> <0x41>", "a b  c", "x" * 3000, " " * 500,
       "\x00a b", "é ́x", " a  b", "\x1c a \x1c", "word " * 3000, "the same", "the same", "don't 'll 12345 $%^&"]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_equals_the_definition(spark, monkeypatch, small):
    if small:
        for name, value in (("LANE", 1), ("CHARS", 50), ("PAIRS", 10), ("MEMO", 5)):
            monkeypatch.setattr(align, name, value)
        monkeypatch.setattr(align, "_LOADED", {})
    rows = [(i if i % 5 else None, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, block int").repartition(3)
    got = align.align_tokens(docs, tokenizer_file(A), tokenizer_file(B))
    want = Counter((d, *r) for (d, _), r in zip(rows, aligned([t for _, t in rows])))
    assert Counter(tuple(r) for r in got.select("doc_id", *COLUMNS).collect()) == want


def test_alignment_query_equals_the_definition(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    want = {d.doc_id: r for d, r in zip(docs, aligned([d.text for d in docs]))}
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_token_alignment"](spark, FOLDER).select("doc_id", *COLUMNS).collect()} == want


def test_large_groups_are_counted_by_ids():
    own = align.Aligner(tokenizer_file(A), tokenizer_file(B))
    rng = np.random.default_rng(1)
    a_ids, b_ids = rng.integers(0, 50, 3000).astype("<i4"), rng.integers(0, 50, 2000).astype("<i4")
    groups = np.array([[0, 1000], [999, 2999], [0, 900], [899, 1999]])
    keys, times = own.pairs(a_ids, b_ids, groups, np.array([0, 1]))
    for d in range(2):
        a, b = (Counter(x[groups[2 * s][d]: groups[2 * s + 1][d] + 1].tolist()) for s, x in enumerate((a_ids, b_ids)))
        here = keys[0] == d
        assert dict(zip(keys[1][here].tolist(), times[here].tolist())) == {i * own.n_b + j: p * q for i, p in a.items() for j, q in b.items()}


def test_alignment_of_nothing(spark):
    assert align.align_tokens(spark.createDataFrame([], "doc_id long, text string"), tokenizer_file(A), tokenizer_file(B)).collect() == []

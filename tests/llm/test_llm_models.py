"""Operators with Python on the workers: quality, tokens, near-dedup, top-k, pieces, main text."""

import html
import random
import re
import string
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from laplens.llm import html_text, neardup, pieces, quality, tokens, topk

FOLDER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, source string, id string, x int, __id int, regs string"
ODD = ["", None, " ", "a", "  two  spaces ", "🙂🙂 naïve ﬁ　x", "tab\there\n\nand\r\nlines ", "'s 'll don't 12345 ½ ٣", "x" * 20_000, "日本語のテキスト",
       "a\x00b\x1c\x1d c\x85d e", "<|endoftext|> in <|endoftext|><|endoftext|>  text", "<0x0A><s></s><unk>", "​zero ééé"]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "s", "x", 1, 2, "y") for i, t in rows], DOCS)


def odd_rows():
    return [*enumerate(ODD), (3, "a"), (None, "no id"), (None, None)]


# -- quality --------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 100
    right = sum(r.predicted == r.quality for r in got) / len(got)
    poor = [r.predicted for r in got if r.quality == 0]
    assert right >= 0.95 and sum(poor) <= 0.1 * len(poor)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_labels_and_held_out_rows_do_not_leak(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    renamed = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("other")})
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in quality.quality_scores(*x).collect()) for x in ((docs, labels), (renamed, flipped)))
    assert a == b


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (3, 7), (5, 1), (5, 1)], "doc_id long, quality int")
    for own in (labels, labels.limit(0)):
        got = quality.quality_scores(docs_of(spark, odd_rows()), own).collect()
        assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out is False for r in got if r.doc_id is None)
    assert {r.score for r in got} == {0.5}  # nothing learnt
    kept = quality.keep_good(docs_of(spark, odd_rows()), labels.limit(0))
    assert kept.count() == len(odd_rows()) and kept.columns == docs_of(spark, []).columns
    assert quality.quality_scores(docs_of(spark, []), labels).count() == 0


def test_model_equals_the_densities():
    rng = np.random.default_rng(1)
    p = len(quality.FEATURES)
    means, covs = rng.normal(size=(2, p)), [np.cov(rng.normal(size=(p, 60))) for _ in range(2)]
    inv = [np.linalg.inv(np.linalg.cholesky(c)) for c in covs]
    m = quality.Model(list(means), inv, [-0.5 * np.linalg.slogdet(c)[1] for c in covs], np.ones(p), np.zeros(p))
    x = rng.normal(size=(20, p))
    dens = [[-0.5 * np.linalg.slogdet(c)[1] - 0.5 * (r - mu) @ np.linalg.solve(c, r - mu) for r in x] for mu, c in zip(means, covs)]
    assert np.allclose(m.scores(x), 1 / (1 + np.exp(np.array(dens[0]) - np.array(dens[1]))))


# -- tokens ---------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = odd_rows() + [(100 + i, r[0]) for i, r in enumerate(duckdb.connect().execute(f"SELECT text FROM '{FOLDER}/documents.parquet'").fetchall())]
    library = tokens.load(path)
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    got = tokens.count_tokens(docs_of(spark, rows), path)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert got.filter("over_limit != (n_tokens > 1024)").count() == 0
    assert tokens.count_tokens(docs_of(spark, []), path).count() == 0


def test_pre_tokens_agree_over_unicode():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = tokens.Counter(path, *tokens.prove_whole(path)), tokens.load(path)
    chars = [chr(c) for c in [*range(0x3100), *range(0xFE00, 0x10800), *range(0x1F000, 0x1F900)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c} 1{c}{c}\n" for c in chars]
    assert own.counts(texts) == [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_only_proven_strings_count_as_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, special = tokens.prove_whole(path)
    library = tokens.load(path)
    assert special == ["<|endoftext|>"] and 45_000 < len(whole) <= 50_257
    assert all(len(library.encode(s, add_special_tokens=False).ids) == 1 for s in sorted(whole)[::97])
    with pytest.raises(ValueError):
        tokens.prove_whole(public_tokenizers.path("word_bpe_49k.json"))


# -- near-dedup -----------------------------------------------------------------------------------


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_brute(rows, percent=75):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(n)
    for n, (i, s) in enumerate(sets):
        common = Counter(m for x in s for m in where[x] if m < n)
        for m, c in common.items():
            j, t = sets[m]
            if 100 * c >= percent * (len(s) + len(t) - c):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return Counter((i, len(shingle_set(t)), None if i is None else find(i), i is None or find(i) == i) for i, t in rows)


def near_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(5))
    rows, shared = [], [word() for _ in range(40)]
    for i in range(60):
        rows.append((i, " ".join(word() for _ in range(rng.randrange(1, 120)))))
    base = [word() for _ in range(100)]
    for i in range(100, 260):  # a large group, each with edits of its own, and a chain that drifts away
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(100)] = word()
        rows.append((i, " ".join(w)))
    for i in range(300, 340):
        base[rng.randrange(100)] = word()
        rows.append((i, " ".join(base)))
    rows += [(400 + i, " ".join([*shared, *(word() for _ in range(30))])) for i in range(40)]  # a passage many share
    rows += [(500, rows[5][1].upper()), (501, rows[5][1].replace(" ", "\n\t")), (502, "one two three"), (503, "One two  THREE"), (504, None), (505, ""),
             (506, " \t"), (None, rows[5][1]), (None, None), (5, rows[5][1]), (7, rows[8][1]), (507, "ÄÖ ü a b c"), (508, "äö ü a b c"),
             (509, "same " * 3000), (510, "same " * 5)]
    return rows


def test_near_dedup_equals_brute_force(spark):
    got = neardup.near_duplicates(docs_of(spark, near_rows()))
    assert Counter(tuple(r) for r in got.collect()) == near_brute(near_rows())


def test_near_dedup_of_no_rows(spark):
    docs = docs_of(spark, [])
    assert neardup.near_duplicates(docs).count() == 0
    out = neardup.drop_near_duplicates(docs_of(spark, [(1, "a b"), (2, "a b"), (None, "a b")]))
    assert out.columns == docs.columns and sorted((r.doc_id for r in out.collect()), key=repr) == [1, None]


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 2 ** 63, 4000, dtype=np.uint64)
    a, b = values[:2500], values[500:3000]  # similarity 2/3
    ra, rb, union = neardup.registers(a), neardup.registers(b), neardup.registers(values[:3000])
    assert (np.maximum(ra, rb) == union).all()
    assert abs((ra == rb).mean() - 2 / 3) < 0.12
    one = lambda x: np.stack([x])
    n = np.array([2500.0])
    assert not neardup.clear_miss(one(ra), one(rb), n, n, 0.66)[0]
    far = neardup.registers(values[2500:])
    assert neardup.clear_miss(one(ra), one(far), n, np.array([1500.0]), 0.75)[0]


def test_pairs_at_the_threshold_meet():
    rng = np.random.default_rng(5)
    met = tried = 0
    for _ in range(200):
        v = rng.integers(0, 2 ** 63, 800, dtype=np.uint64)
        a, b = v[:700], v[100:]  # similarity exactly 0.75
        keys = neardup.band_keys(np.stack([neardup.registers(a), neardup.registers(b)]))
        met += bool((keys[0] == keys[1]).any())
        assert not neardup.clear_miss(neardup.registers(a)[None], neardup.registers(b)[None], np.array([700.0]), np.array([700.0]), 0.75)[0]
        tried += 1
    assert met == tried


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(139, 200), (7, 7)]
    got = {r.id: r.comp for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {x: 100 for x in [*range(101, 140), 200]}


# -- top-k ----------------------------------------------------------------------------------------


def top_brute(rows, k=5):
    clean = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            clean[i, tuple(int(np.floor(256 * float(x))) if abs(x) < 1e300 else 0 for x in v)] = 1
    out = []
    for q, v in clean:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in clean if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s)]
    return Counter(out)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(700)]
    rows += [(700 + i, [0.5] * 8) for i in range(60)]  # ties
    rows += [(800, None), (850, [1.0, None] + [0.0] * 6), (900, [float("nan")] + [0.0] * 7), (901, [float("inf")] * 8), (None, [1.0] * 8), (950, [1.0, 2.0]),
             (951, [1.0, -2.0]), (1000, []), (1001, []), (1050, [9.0] * 3), (50, rows[50][1])]
    rows += [(1100, [-1e-20] * 8), (1102, [3e6] * 8)]
    table = spark.createDataFrame([(i, v, 3, 4) for i, v in rows], "vec_id long, embedding array<double>, v int, shard int")
    for sizes in ({}, {"shard_rows": 90, "block_rows": 7, "leaf": 16}):
        got = topk.top_k(table, F.col("vec_id") % 50 == 0, **sizes)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert Counter(tuple(r) for r in got.collect()) == top_brute(rows)


def test_top_k_of_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], schema), F.col("vec_id") % 50 == 0).count() == 0
    big = spark.createDataFrame([(0, [1e15, 1.0]), (1, [1e15, 1.0]), (2, [-1e15, 3.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(big, F.col("vec_id") % 50 == 0).collect()  # beyond 64 bits: the order holds, scores stop at the ends
    assert [r.vec_id for r in got] == [1, 2] and got[0].score > 9e18 and got[1].score < -9e18


def test_boxes_skip_leaves():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c, 1, (500, 4)) for c in (0, 50, 100)]).round()
    leaves = topk.build_tree(points, 50)
    assert sorted(np.concatenate(leaves)) == list(range(1500)) and max(map(len, leaves)) <= 50


# -- pieces ---------------------------------------------------------------------------------------


MODEL = "piece_bpe_32k.model"


def test_pieces_equal_the_library(spark):
    path = public_tokenizers.path(MODEL)
    rows = odd_rows() + [(100 + i, r[0]) for i, r in enumerate(duckdb.connect().execute(f"SELECT text FROM '{FOLDER}/documents.parquet' LIMIT 400").fetchall())]
    library = pieces.pieces(path).model
    got = pieces.encode_texts(docs_of(spark, rows), path)
    want = Counter((i, tuple(library.encode(t or ""))) for i, t in rows)
    found = got.collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == want
    assert all(r.n_tokens == len(r.ids) and r.round_trip for r in found)
    back = pieces.decode_ids(got.filter("doc_id >= 100"), path)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t for i, t in rows if i is not None and i >= 100}
    assert pieces.encode_texts(docs_of(spark, []), path).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode_ids(none, path).collect()} == {1: None, 2: ""}


def test_round_trip_shows_wrong_ids():
    own = pieces.Pieces(public_tokenizers.path(MODEL))
    texts = ["the cat sat", "a dog ran", "", "the cat  sat\n on é🙂", "\ufb01x"]
    coded, same = own.encode(texts)
    assert same == [own.decode(c.tolist()) == t for c, t in zip(coded, texts)] and same[:3] == [True] * 3
    right = own.words["▁cat"]
    own.words["▁cat"] = own.words["▁dog"]  # another word's ids
    coded, same = own.encode(texts)
    assert same[:4] == [False, True, True, False] and own.decode(coded[0].tolist()) == "the dog sat"
    own.words["▁cat"] = right
    assert own.encode(texts[:1])[1] == [True]
    wrong = pieces.Pieces(public_tokenizers.path(MODEL))
    wrong.code = lambda piece: np.array([own.piece_id["▁the"]], "<i4").tobytes()
    assert wrong.encode(texts)[1] == [False, False, True, False, False]


def test_prefix_states_equal_merging():
    own = pieces.pieces(public_tokenizers.path(MODEL))
    rng = random.Random(9)
    words = {"▁" * rng.randrange(0, 4) + "".join(rng.choice("abcdehinorstu") for _ in range(rng.randrange(1, 14))) for _ in range(3000)}
    words |= {"▁" * n for n in range(1, 40)} | {"aaaaaaaa", "▁▁▁x", "ﬁx", "é€🙂"}
    own.words.clear()
    own.walk(sorted(words))
    for w in words:
        assert own.words[w] == own.packed(own.merged(w)[0][::-1]), w


# -- main text ------------------------------------------------------------------------------------


def test_main_text_of_the_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>?", lambda m: " " if m.group()[:3] == "<br" else "", b)).split())
                 for b in re.split(r"</?(?:p|h1)(?:>|\Z)", inner)]
        assert got[r.page_id].text == "\n\n".join(p for p in parts if p) and got[r.page_id].n_chars == len(got[r.page_id].text)


PROSE = "The quick brown fox is in the house and it was not at the door when he had come to the town with his dog, and that was the end of it for us."


@pytest.mark.parametrize("page, text", [
    ("", ""), (None, ""), (" \n", ""), ("plain", "plain"), ("Hello world. This short notice\nhas no tags.", "Hello world. This short notice has no tags."), (f"<p>{PROSE}</p>", PROSE),
    (f"<article><h1>A &amp; B</h1><p>x<br>y&nbsp;&eacute;\n z</article>", "A & B\n\nx y é z"),
    (f"<nav><p>{PROSE}</nav><div><p>{PROSE}<p>Short.<p>{PROSE}</div><footer>{PROSE}</footer>", f"{PROSE}\n\nShort.\n\n{PROSE}"),
    (f"<div class='ad-box'>{PROSE}</div><main>In.<aside>no</aside><script>if (a<b) '</p>'</script><!-- <p>no -->x<style>p</style>", "In.\n\nx"),
    (f"<article>one<div id=comments><article><p>{PROSE}</article></div>two</article>", "one\n\ntwo"),
    (f"<article><header><h1>T</h1></header><form>f<input></form><p class=notice>n<p>kept<ul><li>a<li>b</ul>", "T\n\nkept\n\na\n\nb"),
    (f"<div>{PROSE}</div><div><a href='/x'>{PROSE}</a></div>", PROSE), ("<article>a < b &lt;p&gt; &am", "a < b <p> &am"),
    ("<article><p>cut <a href='x", "cut"), (f"<header><h1>no</h1></header><main><p hidden>no</p><p>yes", "yes"),
    ("<body class='has-ads'><form><div class=with-sidebar><main class='no-sidebar widget'>yes<form>no</form><article class=comment>no</article></main></form>", "yes"),
    ("<title>no</title><article>" + "long text " * 20_000, ("long text " * 20_000).strip()),
])
def test_main_text_rules(page, text):
    assert html_text.main_text(page) == text


NAV, LINKS, FOOTER = "<nav><a href=/>Home</a> Menu</nav>", "<div><a href=/a>Elsewhere on this site</a></div>", "<footer>Imprint of the site</footer>"
CODE = "for i in range(10): print(i); total += values[i] * weights[i]; counts[i] -= 1"
OTHER = "Nopea ruskea kettu hyppäsi laiskan koiran yli ja juoksi metsään, jossa kukaan ei enää nähnyt sitä, vaikka kaikki etsivät."


@pytest.mark.parametrize("page, text", [
    (f"{NAV}<h1>Headline</h1><p>{PROSE}</p>{FOOTER}", ["Headline", PROSE]),
    (f"{NAV}<h1>Headline</h1><p>A first one.</p><p>{PROSE}</p>{FOOTER}", ["Headline", "A first one.", PROSE]),
    (f"{NAV}<p>{PROSE}</p><p>Closing.</p><p>The end.</p><p>Really.</p>{FOOTER}", [PROSE, "Closing.", "The end.", "Really."]),
    (f"{NAV}<p>Short.</p><p>Also short.</p>{FOOTER}", ["Short.", "Also short."]),
    (f"{NAV}<p>{PROSE}</p><pre>{CODE}</pre><p>After code.</p><p>{OTHER}</p>{FOOTER}", [PROSE, CODE, "After code.", OTHER]),
    (f"{NAV}<p>{OTHER}</p><p>{OTHER}</p>", [OTHER, OTHER]),
    (f"<p>{PROSE}</p><aside>Buy.</aside><p>Between.</p><aside>Buy.</aside>{FOOTER}", [PROSE, "Between."]),
    (f"{LINKS}<p>More of it</p><p>Tie.</p><p>Near.</p><p>{PROSE}</p>", ["Tie.", "Near.", PROSE]),
    (f"{LINKS}<h2>Head</h2><h3>Sub</h3><p>Near.</p><p>{PROSE}</p>", ["Head", "Sub", "Near.", PROSE]),
    (f"<p>{PROSE}</p><p>Near.</p><p>Far.</p><p>Farther.</p>{LINKS}<p>Beyond</p>", [PROSE, "Near.", "Far."]),
])
def test_main_text_without_an_article(page, text):
    assert html_text.main_text(page) == "\n\n".join(text)


def test_main_text_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "a"), (1, None, None, "a"), (None, "u", "<article>x", "b")], "page_id long, url string, html string, text string")
    got = html_text.extract_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter(tuple(r) for r in got.collect()) == Counter({(1, None, "", 0): 2, (None, "u", "x", 1): 1})
    assert html_text.extract_text(pages.limit(0)).count() == 0

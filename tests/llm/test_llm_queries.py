"""The registered queries against their SQL, and the pipeline stage by stage, on the smallest tables."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle_check import compare, connect  # noqa: E402

import corpus_pipeline  # noqa: E402
from laplens.llm import lines, mixing, neardup, pieces, quality  # noqa: E402
from laplens.llm.common import tokenizer_file  # noqa: E402
from laplens.llm.queries import ORACLES, QUERIES  # noqa: E402
from laplens.session import hold  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) < set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_other_queries_return_a_row_per_row(spark, name):
    table = "pages" if name.startswith("op10") else "documents"
    assert QUERIES[name](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = hold(stage(spark, docs, FOLDER), "stage")
        out[name] = docs, result
        docs = result
    return out


def test_stages_keep_the_columns(spark, stages):
    names = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near-dedup", "source mix", "piece encoding"]
    assert all(out.columns == names for n, (_, out) in stages.items() if n != "piece encoding")


def test_quality_stage_drops_what_is_rejected(spark, stages):
    docs, out = stages["quality classifier"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = {r.doc_id for r in quality.quality_scores(docs, labels).filter("predicted = 1").collect()}
    assert {r.doc_id for r in out.collect()} == good and 0 < len(good) < docs.count()


def test_line_stage_takes_out_the_lines(stages):
    docs, out = stages["line dedup"]
    gone = {}
    for r in lines.line_verdicts(docs).collect():
        gone.setdefault(r.id, set()).add(r.pos)
    want = {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone.get(r.doc_id, ())) for r in docs.collect()}
    assert gone and {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {i: (t, len(t)) for i, t in want.items()}


def test_near_stage_keeps_one_of_each_group(stages):
    docs, out = stages["near-dedup"]
    kept = sorted(r.doc_id for r in neardup.near_duplicates(docs).filter("kept").collect())
    assert sorted(r.doc_id for r in out.collect()) == kept


def test_mix_stage_repeats_documents_as_drawn(stages):
    docs, out = stages["source mix"]
    want, texts = Counter(), {(r.doc_id, r.text) for r in docs.collect()}
    for r in mixing.mix(docs).collect():
        want.update(r.doc_id for d in r.draws if 2 * d.words >= r.size)
    got = out.collect()
    assert Counter(r.doc_id for r in got) == want
    assert all(r.n_chars == len(r.text) and (r.doc_id, r.text) in texts for r in got)  # none is cut


def test_last_stage_encodes_every_text(stages):
    docs, out = stages["piece encoding"]
    model = pieces.pieces(tokenizer_file("piece_bpe_32k.model")).model
    assert Counter((r.doc_id, tuple(r.ids)) for r in out.collect()) == Counter((r.doc_id, tuple(model.encode(r.text))) for r in docs.collect())


def test_run_is_all_stages(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == Counter((r.doc_id, tuple(r.ids)) for r in stages["piece encoding"][1].collect())

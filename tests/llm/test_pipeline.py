from __future__ import annotations

from collections import Counter

import corpus_pipeline as pipeline
import pytest
from llm import plain
from llm.plain import AWKWARD, awkward
from llm.test_tokens_files_packing import check_pieces

from tallyguard.llm import personal, toxicity
from tallyguard.llm.tokens import default_tokenizer

SF = "/root/testdata/sf0.001"
STAGES = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    """Stored documents, copies and near copies of some, and the awkward ones, with odd columns."""
    stored = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    copies = [(1000 + i, t) for i, t in stored[:20]] + [(2000 + i, t + " end") for i, t in stored[20:40]]
    return awkward(spark, stored + copies + [(i and i + 5000, t) for i, t in AWKWARD]).cache()


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stage_names_and_order():
    assert list(STAGES) == ["toxicity", "near_dedup", "decontamination", "personal_data", "packing"]


def test_toxicity_drops_what_scores_one_half_or_more(spark, docs):
    kept = STAGES["toxicity"](spark, docs, SF)
    assert kept.schema == docs.schema
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    hits = model.hits()
    wanted = []
    for name, text in pairs(docs):
        if model.probability(toxicity.np.array([toxicity.features(text, hits)]))[0] < 0.5:
            wanted.append((name, text))
    assert Counter(pairs(kept)) == Counter(wanted)


def test_near_dedup_keeps_one_of_each_component(spark, docs):
    kept = STAGES["near_dedup"](spark, docs, SF)
    assert kept.columns == docs.columns
    rows = pairs(docs)
    prints = [plain.simhash(t) for _, t in rows]
    roots = plain.components(prints)
    component = {}
    for (_, text), root in zip(rows, roots, strict=True):
        component[text] = root
    left = [component[t] for _, t in pairs(kept)]
    assert len(left) == len(set(left)) == len(set(roots))


def test_decontamination_drops_contaminated_documents(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = pairs(docs) + [(77, items[0][1])]
    kept = STAGES["decontamination"](spark, awkward(spark, rows), SF)
    wanted = [r for r, found in zip(rows, plain.overlap(rows, items), strict=True) if not found[4]]
    assert len(wanted) < len(rows)
    assert Counter(pairs(kept)) == Counter(wanted)


def test_personal_data_is_masked_and_nothing_else(spark, docs):
    masked = STAGES["personal_data"](spark, docs.withColumn("n_chars", docs["doc_id"]), SF)
    assert masked.columns == [*docs.columns, "n_chars"]
    before, after = pairs(docs), masked.collect()
    assert len(before) == len(after)
    clean = {(n, t) for n, t in before if not personal.candidates(t)}
    assert clean <= {(r.doc_id, r.text) for r in after}
    assert all(not plain.base_spans(r.text) for r in after)
    assert all(r.text is None or r.n_chars == len(r.text) for r in after)


def test_packing_holds_every_id(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    tokenizer.encode_special_tokens = True
    few = docs.where("doc_id between 5 and 30")
    rows = STAGES["packing"](spark, few, SF).collect()
    check_pieces(rows, pairs(few), lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("name", list(STAGES))
def test_an_empty_table_stays_empty(spark, name):
    assert STAGES[name](spark, awkward(spark, []), SF).count() == 0


def test_run(spark):
    pieces = pipeline.run(spark, SF)
    documents = spark.read.parquet(f"{SF}/documents.parquet").count()
    kept = pieces.select("doc_id").distinct().count()
    assert 0 < kept < documents
    sequences = pieces.groupBy("sequence_id").sum("length").collect()
    assert all(0 < r[1] <= 2048 and r[1] & (r[1] - 1) == 0 for r in sequences)

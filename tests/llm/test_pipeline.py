"""Every stage of the pipeline against a plain version of it, on the rows its predecessor kept."""

from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from accountloom.llm import toxicity
from accountloom.session import work_path
from tests.llm import brute, cases

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before the first stage and after each of them."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        path = work_path(spark, "test-stage")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "token-ID output"]


def test_toxicity_keeps_what_scores_low(spark, stages):
    model = toxicity.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    low = {r.doc_id for r in toxicity.classify(stages[0], model).where("predicted = 0").collect()}
    assert {i for i, _ in texts(stages[1])} == low and 0.7 * stages[0].count() < len(low) < stages[0].count()


def test_one_of_each_class_stays(stages):
    want = {i for i, (_, least) in brute.op5(texts(stages[1])).items() if i == least}
    assert sorted(i for i, _ in texts(stages[2])) == sorted(want)


def test_contaminated_documents_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i for i, x in brute.op3(texts(stages[2]), items).items() if not x[-1]}
    assert sorted(i for i, _ in texts(stages[3])) == sorted(want)


def test_sources_meet_their_targets(stages):
    size = lambda t: len(brute.WORD.findall(t or ""))
    before = [(r.source, size(r.text)) for r in stages[3].select("source", "text").collect()]
    after = [(r.source, size(r.text)) for r in stages[4].select("source", "text").collect()]
    sizes, taken = Counter(), Counter()
    for s, n in before:
        sizes[s] += n
    for s, n in after:
        taken[s] += n
    largest = {s: max(n for t, n in before if t == s) for s in sizes}
    target = brute.op2_targets(dict(sizes))
    assert all(target[s] - 1 <= taken[s] <= target[s] + largest[s] for s in sizes)
    assert set(Counter(i for i, _ in texts(stages[4])).values()) <= {1, 2}


def test_tokens_of_the_mixture(stages):
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in stages[5].collect())
    path = public_tokenizers.path("word_bpe_49k.json")
    one = brute.op7(sorted(set(texts(stages[4]))), path)
    at = 0
    for i in sorted(i for i, _ in texts(stages[4])):
        _, n, crc = one[i]
        assert got.pop(0) == (at, i, n, crc)
        at += n
    assert not got


def test_stages_take_awkward_rows(spark):
    """Nulls, empty and long texts and clashing columns pass through every stage; so does no row."""
    from accountloom.llm.common import read

    docs = spark.createDataFrame(cases.rows(), cases.SCHEMA)
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = work_path(spark, "test-stage")
        stage(spark, kept, SF).write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == docs.columns
    assert corpus_pipeline.tokens(spark, kept, SF).count() == kept.count() > 0
    none = read(spark, SF, "documents").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, none, SF).count() == 0

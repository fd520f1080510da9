from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tabloom.llm import mixing
from tabloom.llm.common import table
from tabloom.llm.queries import toxicity_chain
from tests.llm.test_dedup import classes, plain_print
from tests.llm.test_mixing import brute_targets
from tests.llm.test_tokens import ids_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returns, written and read as the next one's input."""
    docs, out = table(spark, FOLDER, "documents"), {}
    root = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, FOLDER).write.parquet(str(root / name))
        docs = spark.read.parquet(str(root / name))
        out[name] = (before, docs)
    return out


def rows(frame):
    return [(r.doc_id, r.text, r.source) for r in frame.collect()]


def test_stages_return_the_columns_of_documents(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == table(spark, FOLDER, "documents").columns


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    score = toxicity_chain(before, table(spark, FOLDER, "labels")).scorer()
    assert Counter(rows(after)) == Counter(r for r in rows(before) if round(score(r[1] or "")[-1], 6) < 0.5)


def test_one_of_equal_texts_stays(stages):
    before, after = stages["exact dedup"]
    last = {}
    for i, text, source in sorted(rows(before)):
        last[text] = (i, text, source)
    assert Counter(rows(after)) == Counter(last.values())


def test_one_of_near_copies_stays(stages):
    before, after = (rows(x) for x in stages["near dedup"])
    before.sort()
    prints = [plain_print(t) for _, t, _ in before]
    group = classes(len(before), [(i, j) for i in range(len(before)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    assert Counter(after) == Counter(before[g] for g in set(group))


def test_the_mix_nears_its_targets(stages):
    before, after = stages["mixing"]
    size = F.sum(mixing.word_count(F.col("text"))).alias("n")
    held, taken = ({r.source: r.n for r in x.groupBy("source").agg(size).collect()} for x in (before, after))
    copies, times = Counter(rows(after)), Counter(rows(before))
    assert set(copies) <= set(times) and all(n <= 3 * times[r] for r, n in copies.items())
    largest = defaultdict(int)
    for source, goal in brute_targets(held).items():
        assert abs(taken.get(source, 0) - goal) <= max(10, 0.05 * goal) + largest[source]


def test_every_id_is_packed_once(stages):
    before, after = stages["packing"]
    expected = Counter()
    for i, text, _ in rows(before):
        n = len(ids_of(text)) + 1
        expected.update((i, a, min(2048, n - a), n) for a in range(0, n, 2048))
    found = after.collect()
    assert Counter((r.doc_id, r.start, r.length, r.doc_tokens) for r in found) == expected
    fill = defaultdict(list)
    for r in found:
        fill[r.sequence_id].append((r.offset, r.length))
    for pieces in fill.values():
        ends = [a + n for a, n in sorted(pieces)]
        assert [a for a, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_run_gives_the_rows_of_the_last_stage(spark, stages):
    assert "pipeline" in queries() and ("pipeline" in oracle_sql()) == (corpus_pipeline.ORACLE_SQL is not None)
    columns = ["doc_id", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, corpus_pipeline.run(spark, FOLDER).select(*columns).collect())) == Counter(map(tuple, stages["packing"][1].select(*columns).collect()))


def test_every_stage_takes_odd_and_empty_tables(spark, make_docs):
    labels_of = FOLDER
    docs = table(spark, FOLDER, "documents")
    odd = make_docs([(1, None, None), (None, "a b c", "s"), (None, None, "s"), (2, "", None), (2, "", None), (3, "x " * 40_000, "t"), (3, "x " * 40_000, "t")])
    odd = odd.withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")}).select(*docs.columns)
    for frame in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, frame, labels_of)
            assert (result.count() > 0) == (frame is odd), name

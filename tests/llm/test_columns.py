"""Columns of a table that carry names an operator uses for helpers, in either case."""

import pytest
from pyspark.sql import functions as F

from tabloom.llm import exact_dedup, line_dedup, mixing, runs, secrets, simhash, syncmers, toxicity

NAMES = (
    "size source_size target copies taken copy mix_id mix_source fact_source _size _copies _copy _mix_id _mix_source _fact_source _source_size _target "
    "stay_id stay_print print _print _stay_id kept_id kept_sha _kept_id chain _chain rejected p_poor p_toxic id k h at third row digest recipe "
    "n_bytes n_tokens over_limit kept n_lines n_dropped drop runs collapsed longest text_ sketch next lead"
).split()
ROWS = [(1, "alpha beta gamma delta", "a"), (2, "alpha beta gamma delta", "b"), (3, "alpha beta gamma delta!", None), (None, None, "a"), (4, "secret token=abcdef123 é " * 9, "b")]


@pytest.fixture(scope="module")
def chain():
    import numpy as np

    return toxicity.Chain(["<alpha>"], [toxicity.Link("poor", 0.0, np.zeros(1), np.zeros(0)), toxicity.Link("toxic", -1.0, np.array([0.5]), np.array([0.1]))])


@pytest.fixture(params=["lower", "upper"])
def crowded(request, make_docs):
    docs = make_docs(ROWS)
    taken = {c.lower() for c in docs.columns}
    names = [n for n in NAMES if n not in taken]
    return docs.withColumns({(n.upper() if request.param == "upper" else n): F.lit(f"own {n}") for n in names})


@pytest.mark.parametrize("stage", ["toxic", "equal", "near", "take"])
def test_stages_keep_all_columns_as_they_are(crowded, chain, stage):
    run = {
        "toxic": lambda d: toxicity.drop_toxic(d, chain, threshold=0.9),
        "equal": exact_dedup.drop_equal,
        "near": simhash.drop_near,
        "take": mixing.take,
    }[stage]
    found = run(crowded)
    assert found.columns == crowded.columns
    rows = found.collect()
    own = [c for c in crowded.columns if c not in ("doc_id", "text", "source")]
    assert rows and all(r[c] == f"own {c.lower()}" for r in rows for c in own)


def test_operators_run_beside_any_column(crowded, chain):
    plain = crowded.select("doc_id", "text", "source")
    assert sorted(map(str, mixing.mix(crowded).select("doc_id", "size", "target", "copies", "taken").collect())) == sorted(
        map(str, mixing.mix(plain).select("doc_id", "size", "target", "copies", "taken").collect())
    )
    assert len(set(c.lower() for c in mixing.mix(crowded).columns)) == len(mixing.mix(crowded).columns)
    scored = toxicity.score(crowded, chain)
    assert len(set(c.lower() for c in scored.columns)) == len(scored.columns) and scored.count() == len(ROWS)
    for operator in (exact_dedup.equal_texts, simhash.near_copies, line_dedup.drop_shared_lines, runs.periodic_runs, syncmers.edited_neighbours):
        assert operator(crowded).count() == len(ROWS)
    model = secrets.Model((0.0,) * len(secrets.ALPHABET) ** 2)
    assert secrets.find_secrets(crowded, model).count() == len(ROWS)

"""What Python workers hold, while a task runs and after it; an executor's memory is shared by all that live on."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from bookflow.llm import bpe, repeats, scan, substrings


class Tasks:
    """Stands for a table; gives the function that its tasks would run."""

    def mapInArrow(self, run, schema):
        return run


def block(n=300):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "epsilon"], k=600)) for _ in range(n)]
    return pa.RecordBatch.from_pydict({"text": texts, "_d": list(range(n)), "_t": [0] * n})


def test_first_round_holds_arrays_of_a_part():
    batch, run = block(), repeats.first_round(Tasks(), substrings.rule())
    tracemalloc.start()
    try:
        sum(x.num_rows for x in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert batch.nbytes > 1 << 20 and peak < 40 << 20


def test_parts_give_the_rows_of_the_block(monkeypatch):
    batch = block(60)
    for rule in (substrings.rule(), repeats.Rule(True, 50, (10, 50), False)):
        made = []
        for part in (1 << 30, 5000):
            monkeypatch.setattr(repeats, "PART", part)
            made.append(pa.Table.from_batches(repeats.first_round(Tasks(), rule)(iter([batch]))))
        assert made[0].num_rows and made[0].equals(made[1])


def test_caches_go_with_the_next_operator():
    bpe._made["one"] = "a vocabulary"
    try:
        assert len(list(scan.blocks(iter([block(3)]), own=bpe._made))) == 1 and bpe._made
        list(scan.blocks(iter([block(3)])))
        assert not bpe._made
    finally:
        bpe._made.clear()


def test_powers_go_with_the_task():
    values = np.arange(1 << 16, dtype=np.uint64)
    kept = scan.Ranges(values)
    before = kept.hash(np.array([5]), np.array([900]))
    scan.give_back()
    assert sum(x.nbytes for x in scan._powers) < 100
    assert scan.Ranges(values).hash(np.array([5]), np.array([900])) == before == kept.hash(np.array([5]), np.array([900]))


def test_cut_needs_one_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "abc " * 90), (2, "xyz " + "abc " * 60)], "doc_id long, text string")
    tree = docs.sparkSession._jvm.PythonSQLUtils.explainString(substrings.cut(docs)._jdf.queryExecution(), "simple")
    names = [x.lstrip(" :+-*").split(" ")[0] for x in tree.splitlines()]
    at = [k for k, x in enumerate(names) if x == "MapInArrow"]
    assert at and not any(k + 1 in at or names[k + 1] == "Project" and k + 2 in at for k in at)

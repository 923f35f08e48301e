"""What is shuffled, and what the driver holds, stays near what is needed."""

from __future__ import annotations

import tracemalloc

import numpy as np

from tallyforge.llm import licenses, quality


def shuffled(df) -> tuple[list, int]:
    """The rows of a frame, and how many records its shuffles wrote."""
    rows, total, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(plan.plan())
        if kind == "ShuffleExchangeExec":
            total += plan.metrics().apply("shuffleRecordsWritten").value()
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return rows, total


def test_windows_do_not_shuffle_their_cells(frame):
    """Notices one after the other in one paragraph, one of them with a bigram too many: as many windows, and about a record per bigram
    of a template."""
    notice = licenses.GNU_NOTICE.format("GNU General Public License", "3")
    mit = next(text for name, text in licenses.NOTICES if name == "MIT")
    words = sum(len(t.split()) for t in (notice, notice, mit))
    rows, moved = shuffled(licenses.windows(frame([(1, f"see {notice} and {notice} so {mit} free of charge to any person"), (2, "no license")])))
    assert [r.license for r in rows].count("GPL-3.0") == 2 and [r.license for r in rows].count("MIT") == 1
    assert words < moved < 40 * words


def test_rows_of_no_group_are_not_shuffled(spark):
    """Where no side is small enough to be broadcast, only rows that share a group move."""
    import corpus_pipeline as pipeline

    text = lambda i: " ".join(f"w{i}x{k}" for k in range(20))
    docs = spark.createDataFrame([(i, text(i % 390), "en", "a", 9) for i in range(400)], "doc_id bigint, text string, lang string, source string, n_chars int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, moved = shuffled(pipeline.keep_one_of_group(spark, docs.repartition(3).localCheckpoint(), ""))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r.doc_id for r in rows) == list(range(390)) and moved < 200


def test_memory_of_the_fit():
    """Besides the slots, eight bytes for each of them and what does not grow with their number."""
    rng = np.random.default_rng(1)
    first = np.concatenate([[0], np.cumsum(rng.integers(900, 1100, 2500))]).astype(np.int64)
    slots = rng.integers(0, 50_000, first[-1]).astype(np.int32)
    target = rng.random(2500)
    tracemalloc.start()
    quality.fit_scorer(slots, first, target, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(slots) + (1 << 25)

"""Review decisions as a stream come to the end state of the batch form, in whatever order they arrive."""

import datetime
import random

import pytest

from tessera.operators import lifecycle
from tessera.streaming import reviews

DECISIONS = "id long, fact_id long, action string, observed string, subject string, relation string, object string, at timestamp"


@pytest.mark.parametrize("seed", [1, 2])
def test_the_stream_ends_as_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    facts = spark.createDataFrame([(i, rng.choice(["candidate", "needs_review", "confirmed", "accepted", "superseded"]), f"s{i}", "r", "o") for i in range(12)], "id long, status string, subject string, relation string, object string")
    statuses = [None, None, "candidate", "needs_review", "confirmed", "superseded"]
    decisions = []
    for i in range(150):
        action = rng.choice(["toggle", "accept", "reject", "amend", "toggle", "accept"])
        new = rng.choice([None, f"n{i}"]) if action == "amend" else None
        decisions.append((i, rng.randrange(14), action if rng.random() > 0.1 else "reject", rng.choice(statuses), None, None, new, start + datetime.timedelta(seconds=i)))
    # Out of order by up to 40 places, in six files; then one far ahead, on no fact, that moves the watermark.
    shuffled = [d for _, d in sorted((i + rng.uniform(0, 40), d) for i, d in enumerate(decisions))]
    folder = tmp_path / "in"
    for k in range(6):
        spark.createDataFrame(shuffled[k * 25 : (k + 1) * 25], DECISIONS).coalesce(1).write.mode("append").parquet(str(folder))
    far = [(999, 0, "none", None, None, None, None, start + datetime.timedelta(days=1))]
    stream = lambda: spark.readStream.schema(DECISIONS).option("maxFilesPerTrigger", 1).parquet(str(folder))
    # Run until all is read, then let the watermark pass, from the same checkpoint.
    run = lambda: reviews.review_stream(stream(), facts, "1 minute").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    run()
    spark.createDataFrame(far, DECISIONS).coalesce(1).write.mode("append").parquet(str(folder))
    run()
    changes = spark.read.schema(reviews.CHANGES).parquet(str(tmp_path / "out"))
    got = sorted(map(tuple, reviews.end_state(facts, changes).collect()))
    batch = lifecycle.review(facts, spark.createDataFrame(decisions, DECISIONS).drop("at"))
    assert got == sorted(map(tuple, batch.select("id", "status", "subject", "relation", "object").collect()))
    log = sorted(tuple(r) for r in lifecycle.review_log(batch).select("fact_id", "decision", "action", "before", "after").collect())
    assert sorted(tuple(r) for r in changes.select("fact_id", "decision", "action", "before", "after").collect()) == log and len(log) > 10

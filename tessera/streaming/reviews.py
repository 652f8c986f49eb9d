"""Review decisions as a stream: each fact's decisions apply in order, whatever order they arrive in.

A decision waits in its fact's state until the watermark has passed it, so one that arrives late, but within the
allowance, still takes its place. A decision whose observed status no longer holds when its turn comes does nothing,
as in lifecycle.review, of which this is the streaming form.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lifecycle import CONTENT
from ..schema import ENGINE, REVIEW

CHANGES = "fact_id long, decision long, action string, before string, after string, status string, subject string, relation string, object string, step long"
#: What a fact is now, the decisions that wait, as JSON (people decide, so they are few), and how many changed it.
STATE = "status string, subject string, relation string, object string, waiting string, step long"


def decide(fact: dict, d: dict) -> dict | None:
    """The fact after one decision, or None where it changes nothing."""
    if fact["status"] == "superseded" or (d["observed"] is not None and d["observed"] != fact["status"]):
        return None
    if d["action"] == "amend":
        after = {**fact, **{c: d[c] for c in CONTENT if d[c] is not None}}
    elif d["action"] == "reject":
        after = {**fact, "status": "superseded"}
    elif d["action"] == "toggle" and fact["status"] in ENGINE:
        after = {**fact, "status": "needs_review"}
    elif d["action"] in ("toggle", "accept") and fact["status"] in REVIEW:
        after = {**fact, "status": "confirmed"}
    else:
        return None
    return None if after == fact else after


def _plain(x):
    return None if x is None or x is pd.NA or x is pd.NaT or x != x else x


def _turn(key, batches, state: GroupState):
    """CHANGES that follow once the watermark has passed the decisions of one fact."""
    held = dict(zip(("status", *CONTENT, "waiting", "step"), state.get, strict=True)) if state.exists else None
    for rows in batches:
        for r in rows.to_dict("records"):
            if held is None:
                held = {"status": r["fact_status"], **{c: r["fact_" + c] for c in CONTENT}, "waiting": "[]", "step": 0}
            waiting = json.loads(held["waiting"])
            waiting.append({"id": int(r["id"]), "at": int(r["at_ms"]), "action": r["action"], "observed": _plain(r["observed"]), **{c: _plain(r[c]) for c in CONTENT}})
            held["waiting"] = json.dumps(waiting)
    if held is None:
        return
    now = state.getCurrentWatermarkMs()
    waiting = sorted(json.loads(held["waiting"]), key=lambda d: (d["at"], d["id"]))
    fact, out, step = {c: held[c] for c in ("status", *CONTENT)}, [], held["step"]
    said = lambda f: " | ".join(f[c] for c in CONTENT)
    for d in [w for w in waiting if w["at"] < now]:
        if after := decide(fact, d):
            told = said if d["action"] == "amend" else lambda f: f["status"]
            step += 1
            out.append((key[0], d["id"], d["action"], told(fact), told(after), *(after[c] for c in ("status", *CONTENT)), step))
            fact = after
    left = [w for w in waiting if w["at"] >= now]
    state.update((*(fact[c] for c in ("status", *CONTENT)), json.dumps(left), step))
    if left:
        state.setTimeoutTimestamp(max(left[0]["at"], now) + 1)
    if out:
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])


def review_stream(decisions: DataFrame, facts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """CHANGES, in append mode: what each decision that takes effect did, and the fact after it.

    decisions: a stream of id, fact_id, action, observed, subject, relation, object (for amend; null keeps the old)
    and at; facts: id, status, subject, relation, object as they stood before. A decision on a fact that facts does
    not hold has no effect. What comes more than late after the newest is dropped, and counted by Spark as such.
    """
    base = facts.select(F.col("id").alias("fact_id"), F.col("status").alias("fact_status"), *[F.col(c).alias("fact_" + c) for c in CONTENT])
    rows = decisions.withWatermark("at", late).join(base, "fact_id").withColumn("at_ms", F.unix_millis("at"))
    return rows.groupBy("fact_id").applyInPandasWithState(_turn, CHANGES, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def end_state(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """id, status, subject, relation, object of all facts after the changes (a table): each fact's last step counts."""
    last = changes.groupBy("fact_id").agg(F.max_by(F.struct("status", *CONTENT), "step").alias("c"))
    at = facts.join(last, F.col("id") == F.col("fact_id"), "left")
    return at.select("id", *[F.when(F.col("c").isNotNull(), F.col(f"c.{x}")).otherwise(F.col(x)).alias(x) for x in ("status", *CONTENT)])

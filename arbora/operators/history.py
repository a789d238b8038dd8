"""Edit histories: logs of edits, undos and redos of documents, and the state after any of their steps.

A log is (doc, seq, op, entity, value): op is edit, undo or redo. An edit goes on top of its document's stack and forgets what was undone; an undo takes the
top off, a redo puts back what the last undo took; both do nothing where there is nothing to take. With a limit the oldest edit of a longer stack
becomes permanent and can no longer be undone.

The level of a step is the height of the stack after it. A redo always puts back the edit that last reached its level, so no stack is kept: after a step of
level h the edits in force are, for every level up to h, the last edit that reached it. Levels are counted in order of seq by one pass over each
document's log (whole numbers only; a document's log is one task's), all the rest are groupings.

Ops in other letters, or null, do nothing, like rows with a null seq. Rows of one document that share a seq are taken in order of op, entity and value. Null
documents are a document. An edit with a null entity counts as a step of its own that sets nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 200


def heights(op: np.ndarray, limit: int) -> np.ndarray:
    """The stack's height after every op (1 edit, 2 undo, 3 redo, 0 nothing), permanent edits counted in."""
    out, height, base, undone = np.zeros(len(op), np.int64), 0, 0, 0
    for i, o in enumerate(op.tolist()):
        if o == 1:
            height, undone = height + 1, 0
            base = max(base, height - limit)
        elif o == 2 and height > base:
            height, undone = height - 1, undone + 1
        elif o == 3 and undone:
            height, undone = height + 1, undone - 1
            base = max(base, height - limit)
        out[i] = height
    return out


def with_levels(log: DataFrame, limit: int = LIMIT) -> DataFrame:
    """log with level after every step; rows without a seq are left out."""
    kind = F.when(F.col("op") == "edit", 1).when(F.col("op") == "undo", 2).when(F.col("op") == "redo", 3).otherwise(0)
    rows = log.where("seq is not null").withColumn("_kind", F.coalesce(kind, F.lit(0)))
    form = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_kind") + ", level long"

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("seq", "ascending"), ("_kind", "ascending"), ("entity", "ascending"), ("value", "ascending")])
        return t.drop_columns(["_kind"]).append_column("level", pa.array(heights(t["_kind"].to_numpy(), limit)))

    return rows.groupBy("doc").applyInArrow(run, form)


def in_force(levels: DataFrame, upto: int | None = None) -> DataFrame:
    """(doc, level, seq, entity, value): the edits that hold after each document's steps up to a seq (all, if none is given)."""
    seen = levels if upto is None else levels.where(F.col("seq") <= upto)
    # of one seq the last step is the highest number by the order in which levels were counted: edits, undos, redos
    rank = F.struct("seq", F.when(F.col("op") == "edit", 1).when(F.col("op") == "undo", 2).when(F.col("op") == "redo", 3).otherwise(0), "entity", "value")
    top = seen.groupBy("doc").agg(F.max_by("level", rank).alias("height"))
    last = seen.where("op = 'edit'").groupBy("doc", "level").agg(F.max_by(F.struct("seq", "entity", "value"), rank).alias("e"))
    return last.join(top, last["doc"].eqNullSafe(top["doc"])).where("level <= height").select(last["doc"], "level", "e.*")


def state(levels: DataFrame, upto: int | None = None) -> DataFrame:
    """(doc, entity, value, seq): what every entity is set to by the edits in force, and the edit that set it."""
    return in_force(levels, upto).where("entity is not null").groupBy("doc", "entity").agg(F.max_by(F.struct("value", "seq"), "level").alias("e")).select("doc", "entity", "e.*")


def summary(levels: DataFrame) -> DataFrame:
    """(doc, n_edits, n_undos, n_redos, height, deepest): counts of a document's steps, its stack's height at the end and at its highest."""
    count = lambda o: F.count_if(F.col("op") == o)
    return levels.groupBy("doc").agg(count("edit").alias("n_edits"), count("undo").alias("n_undos"), count("redo").alias("n_redos"), F.max_by("level", "seq").alias("height"), F.max("level").alias("deepest"))

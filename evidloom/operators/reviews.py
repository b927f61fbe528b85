"""A log of decisions folded, in order, through a table of legal moves.

Rows are dealt by ranges of key and order, so that a task reads them in order and keeps one state; a key
of very many rows is several ranges. Where a range begins inside a key, its first state is not known
yet: for the rows of that key the task keeps the state that follows from each possible one. What the
ranges begin with then follows from their ends, of which there is a row a range, and is looked up.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from evidloom.tables import stored


@dataclass(frozen=True)
class Machine:
    """``moves`` gives the state that a decision leads to from a state; decisions that are not there are refused."""

    start: str
    moves: dict[tuple[str, str], str]
    states: list[str] = field(init=False)
    decisions: list[str] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "states", sorted({self.start, *self.moves.values(), *(s for s, _ in self.moves)}))
        object.__setattr__(self, "decisions", sorted({d for _, d in self.moves}))

    def table(self) -> list[list[int]]:
        """The number of the next state, by numbers of state and decision; a refused one leaves the state as it is."""
        return [[self.states.index(self.moves.get((s, d), s)) for d in self.decisions] for s in self.states]


#: Fixed: the decisions on a mapping, and the status that each results in.
MAPPING_STATUS = {
    "approved": "approved",
    "rejected": "rejected",
    "merged": "merged",
    "needs_review": "needs_review",
    "deferred": "deferred",
    "disagreement": "needs_review",
    "resolved": "approved",
}
#: A merged mapping stays so; only one in review can be resolved or disputed.
MAPPING = Machine(
    "pending",
    {(s, d): to for s in ("pending", "approved", "rejected", "needs_review", "deferred") for d, to in MAPPING_STATUS.items() if d not in ("resolved", "disagreement") or s == "needs_review"}
    | {(s, "disagreement"): "needs_review" for s in ("approved", "rejected")},
)


def _steps(machine: Machine, names: list[str], types: list[pa.DataType], key: str):
    table, first, many = machine.table(), machine.states.index(machine.start), len(machine.states)

    def run(batches):
        number = TaskContext.get().partitionId()
        key_at_start = current = None
        begun, alone, now = False, True, tuple(range(many))
        for batch in batches:
            out = []
            for k, s in zip(batch.column(key).to_pylist(), batch.column("_symbol").to_pylist(), strict=True):
                if not begun:
                    begun, key_at_start, current = True, k, k
                elif k != current:
                    alone, current, now = False, k, (first,)
                out.append(now)
                if s >= 0:
                    now = tuple(table[x][s] for x in now)
            columns = [batch.column(n) for n in batch.schema.names]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.int32())), pa.array([number] * n, pa.int32()), pa.array([False] * n), pa.nulls(n, types[0]), pa.nulls(n, types[0]), pa.nulls(n, pa.bool_())], names)
        if begun:
            blank = [pa.nulls(1, t) for t in types[1:]]
            yield pa.RecordBatch.from_arrays([*blank, pa.array([now], pa.list_(pa.int32())), pa.array([number], pa.int32()), pa.array([True]), pa.array([key_at_start], types[0]), pa.array([current], types[0]), pa.array([alone])], names)

    return run


def reviewed(events: DataFrame, key: str, order: list[str], decision: Column, machine: Machine, guards: list[tuple[str, str]] = ()) -> DataFrame:
    """``events`` with previous, decision, status, accepted and reason: each decision as it found and left its key, in the order given.

    ``guards`` are (reason, condition) that a row must meet whatever its state; the first that it does not is its reason. A decision
    that the machine does not know, or that is not allowed from the state, is refused and leaves the state. Null keys are one key.
    ``order`` must tell a key's rows apart, or rows that are equal in it may change places.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = events.sparkSession
    guard = F.lit(None).cast("string")
    for reason, passes in reversed(list(guards)):
        guard = F.when(~F.coalesce(F.expr(passes), F.lit(False)), reason).otherwise(guard)
    rows = events.select(*events.columns, F.lower(F.trim(decision)).alias("_decision"), guard.alias("_guard"))
    rows = rows.withColumn("_symbol", F.when(F.col("_guard").isNull(), F.coalesce(F.array_position(F.array(*[F.lit(d) for d in machine.decisions]), F.col("_decision")).cast("int") - 1, F.lit(-1))).otherwise(-1))
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    kind = dealt.schema[key].dataType.simpleString()
    types = [to_arrow_type(dealt.schema[key].dataType), *[to_arrow_type(f.dataType) for f in dealt.schema.fields]]
    names = [*dealt.columns, "_before", "_range", "_end", "_first", "_last", "_alone"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields) + f", _before array<int>, _range int, _end boolean, _first {kind}, _last {kind}, _alone boolean"
    steps, _ = stored(dealt.mapInArrow(_steps(machine, names, types, key), schema), "reviews")
    # A row a range: with what state each begins.
    starts, state, last = [], machine.states.index(machine.start), object()
    for r in steps.where("_end").orderBy("_range").select("_range", "_first", "_last", "_alone", "_before").collect():
        begin = state if r["_first"] == last else machine.states.index(machine.start)
        starts.append((r["_range"], begin))
        state, last = r["_before"][begin if r["_alone"] else 0], r["_last"]
    begins = spark.createDataFrame(starts, "_range int, _begin int")
    at = F.when(F.size("_before") == 1, F.element_at("_before", 1)).otherwise(F.element_at("_before", F.col("_begin") + 1))
    states = F.array(*[F.lit(s) for s in machine.states])
    found = steps.where("NOT _end").join(F.broadcast(begins), "_range").withColumn("previous", F.element_at(states, at + 1))
    to = F.lit(None).cast("string")
    for (s, d), status in machine.moves.items():
        to = F.when((F.col("previous") == s) & (F.col("_decision") == d), status).otherwise(to)
    found = found.withColumn("_to", F.when(F.col("_symbol") >= 0, to))
    why = F.coalesce("_guard", F.when(F.col("_symbol") < 0, F.concat(F.lit("unsupported decision "), F.coalesce("_decision", F.lit("null")))), F.when(F.col("_to").isNull(), F.concat("_decision", F.lit(" is not allowed from "), "previous")))
    return found.select(*events.columns, "previous", F.col("_decision").alias("decision"), F.coalesce("_to", "previous").alias("status"), F.col("_to").isNotNull().alias("accepted"), why.alias("reason"))


def final_states(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, status, decided, refused): the last state of each key, and how many of its decisions were taken and refused."""
    return log.groupBy(key).agg(F.max_by("status", F.struct(*order)).alias("status"), F.count_if("accepted").alias("decided"), F.count_if(~F.col("accepted")).alias("refused"))

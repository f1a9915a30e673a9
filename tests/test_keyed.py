"""Keyed state of decisions: what it asks of the state store, and how it orders votes."""

from collections import Counter

from pyspark.sql import Row

from vouchspark.streaming import keyed as K


class Store:
    """Stands for the state of one approval; counts what would be asked of the JVM."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), Counter()

    def getValueState(self, name, schema):
        return self

    def getListState(self, name, schema):
        return self

    def get(self):
        self.calls["get"] += 1
        return self.value

    def update(self, value):
        self.calls["update"] += 1
        self.value = value

    def clear(self):
        self.calls["clear"] += 1
        self.value = None

    def registerTimer(self, at):
        self.calls["register"] += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls["delete"] += 1
        self.timers.remove(at)


def vote(number, by, decision="accept", batch=0, at="t1", required=2, arrived=1000):
    return Row(approval_id=7, decided_by=by, decision=decision, decided_at=at, decision_id=number, approvers_required=required, batch=batch, arrived_ms=arrived + batch)


def run(store, *votes):
    processor = K.Votes(10)
    processor.init(store)
    return list(processor.handleInputRows((7,), iter(votes), None))


def test_an_approval_asks_its_state_a_few_times():
    """Three calls for a new approval, four where a timer gives way, one once it is settled."""
    store = Store()
    assert run(store, vote(1, "a")) == [] and store.calls.total() == 3 and store.timers == {1010}
    store.calls.clear()
    (found,) = run(store, vote(2, "a", batch=1), vote(3, "b", batch=1))
    assert found == Row(approval_id=7, status="approved", decided_at="t1", decided_by="b", decision_id=3)
    assert store.calls.total() == 4 and store.timers == {1011}
    store.calls.clear()
    assert run(store, vote(4, "c", "reject", batch=2)) == [] and store.calls == {"get": 1} and store.timers == {1011}
    processor = K.Votes(10)
    processor.init(store)
    assert list(processor.handleExpiredTimer((7,), None, None)) == [] and store.value is None


def test_votes_without_a_time_come_last():
    (found,) = run(Store(), vote(1, "a", "reject", at=None), vote(None, "c", required=1), vote(2, "b", required=1))
    assert (found.status, found.decision_id) == ("approved", 2)
    assert run(Store(), vote(1, "a", required=None), vote(2, "b", required=None)) == []


def test_stream_settles_over_batches(spark, tmp_path):
    """Stopped and started between the batches, which need each other's state."""
    proposals = spark.createDataFrame([(1, 2), (2, 1), (3, 2)], "approval_id long, approvers_required int")
    batches = [[(1, 1, "accept", "a", "t1"), (2, 2, "reject", "a", "t1")], [(3, 1, "accept", "a", "t2"), (4, 1, "accept", "b", "t3"), (5, 2, "accept", "b", "t2"), (6, 3, "accept", "a", "t2")]]
    schema = "decision_id long, approval_id long, decision string, decided_by string, decided_at string"
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/input")
        K.stream_votes(spark.readStream.schema(schema).parquet(f"{tmp_path}/input"), proposals, str(tmp_path)).awaitTermination()
        K.keyed_status(K.votes_stream(spark, str(tmp_path)), str(tmp_path)).awaitTermination()
    found = K.settled_status(spark, str(tmp_path), proposals).select("approval_id", "status", "decided_at", "decided_by")
    assert sorted(tuple(r) for r in found.collect()) == [(1, "approved", "t3", "b"), (2, "rejected", "t1", "a"), (3, "pending", None, None)]

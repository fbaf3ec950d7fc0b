"""Several changes of one target, taken in order."""

import datetime as dt

from pyspark.sql import functions as F

from gistmill.operators import folds

DAY = lambda n: dt.datetime(2024, 1, n)
NOW = lambda: F.lit("2024-02-01").cast("timestamp")
ROWS = "id string, kind string, text string, status string, review_status string, revision long, document_date timestamp, superseded_by string, valid_until timestamp"
OPS = "nth long, op string, id string, new_id string, text string, kind string, change string, said timestamp, valid_until timestamp, expected_revision long, reason string"


def memories(spark, *ids, until=None):
    return spark.createDataFrame([(i, "fact", f"text of {i}", "active", "confirmed", 1, DAY(10), None, until) for i in ids], ROWS)


def op(nth, kind, target, text=None, change=None, said=None, expected=None, reason=None):
    return (nth, kind, target, f"new{nth}", text, None, change, said, None, expected, reason)


def run(spark, rows, *ops):
    ops = spark.createDataFrame(list(ops), OPS).repartition(3)
    folded = folds.operations(rows, ops, NOW())
    table = {r.id: r for r in folds.next_rows(folded, ops, NOW()).collect()}
    return table, {r.nth: r.outcome for r in folds.outcomes(folded, ops).collect()}, folds.new_revisions(folded)


def test_the_second_op_meets_what_the_first_has_left(spark):
    table, out, revisions = run(
        spark, memories(spark, "a", "b", "c"),
        op(1, "UPDATE", "a", "first", said=DAY(12)), op(2, "UPDATE", "a", "second"), op(3, "DELETE", "a"), op(4, "UPDATE", "a", "too late"), op(5, "DELETE", "a"),
        op(6, "UPDATE", "b", "newer", "supersede", DAY(11)), op(7, "UPDATE", "b", "after"), op(8, "DELETE", "x"), op(9, "ADD", None, "plain"),
        op(10, "UPDATE", "c", "refused", reason="evidence_invalid"), op(11, "DELETE", "c", expected=2), op(12, "UPDATE", "c", "mine", expected=1), op(13, "UPDATE", "c", "also mine", expected=1),
    )
    assert out == {1: "updated", 2: "updated", 3: "deleted", 4: "skipped", 5: "skipped", 6: "superseded", 7: "skipped", 8: "skipped", 9: "added", 10: "evidence_invalid", 11: "conflict", 12: "updated", 13: "conflict"}
    assert (table["a"].status, table["a"].text, table["a"].revision, table["a"].document_date) == ("archived", "second", 4, DAY(12))
    assert (table["b"].status, table["b"].superseded_by, table["b"].valid_until, table["new6"].text, table["new6"].status) == ("superseded", "new6", DAY(11), "newer", "active")
    assert (table["c"].text, table["c"].revision, table["c"].review_status) == ("mine", 2, "pending") and len(table) == 5
    assert sorted((r.memory_id, r.revision, r.status) for r in revisions.collect()) == [("a", 2, "active"), ("a", 3, "active"), ("a", 4, "archived"), ("b", 2, "superseded"), ("c", 2, "active")]


def test_a_replay_of_older_windows_becomes_history(spark):
    """What was said before its target is the target's history; an update moves the day from which later ones count."""
    table, out, _ = run(
        spark, memories(spark, "a", until=DAY(9)), op(1, "UPDATE", "a", "older", "supersede", DAY(8)), op(2, "UPDATE", "a", "said later", said=DAY(20)), op(3, "UPDATE", "a", "now also older", "supersede", DAY(15)),
        op(4, "UPDATE", "a", "undated", "supersede"),
    )
    assert set(out.values()) == {"superseded", "updated"}
    assert [(table[x].status, table[x].superseded_by, table[x].revision, table[x].valid_until) for x in ("new1", "new3")] == [("superseded", "a", 2, DAY(10)), ("superseded", "a", 2, DAY(20))]
    assert (table["a"].status, table["a"].superseded_by, table["a"].valid_until, table["a"].text) == ("superseded", "new4", DAY(9), "said later")
    assert table["new4"].document_date == dt.datetime(2024, 2, 1)


def test_many_ops_on_one_memory(spark):
    ops = [op(k, "UPDATE", "a", f"t{k}") for k in range(3000)] + [op(5000, "DELETE", "a")] + [op(6000 + k, "UPDATE", "a", "x") for k in range(3000)]
    table, out, _ = run(spark, memories(spark, "a"), *ops)
    assert (table["a"].revision, table["a"].text, table["a"].status) == (3002, "t2999", "archived") and sum(x == "skipped" for x in out.values()) == 3000
    empty, none, _ = run(spark, memories(spark, "a").limit(0), op(1, "DELETE", "a"))
    assert empty == {} and none == {1: "skipped"}


def test_of_two_changes_that_name_one_revision_the_first_wins(spark):
    rows = memories(spark, "a", "b").select("id", "kind", "text", "revision")
    changes = spark.createDataFrame([("a", 1, 1, "one", None), ("a", 2, 1, "two", None), ("a", 3, 2, "three", "t"), ("a", 4, 0, "old", None), ("a", 5, None, "none", None), ("z", 1, 1, "x", None)], "id string, nth int, expected_revision long, kind string, text string")
    got = {r.id: r for r in folds.versions(rows, changes, "kind", sticky=["text"]).collect()}
    assert (got["a"].kind, got["a"].text, got["a"].revision, got["a"].conflicts) == ("three", "t", 3, 3)
    assert (got["b"].kind, got["b"].revision, got["b"].conflicts) == ("fact", 1, 0) and set(got) == {"a", "b"}


def test_status_changes_in_order(spark):
    rows = spark.createDataFrame([("a", "active", DAY(5), 3), ("b", "superseded", DAY(1), 2)], "id string, status string, valid_until timestamp, revision long")
    revisions = spark.createDataFrame([("a", 1, "active", None), ("b", 1, "active", DAY(7)), ("b", 2, "superseded", DAY(1))], "memory_id string, revision long, status string, valid_until timestamp")
    changes = spark.createDataFrame(
        [("a", 1, "superseded", 3, None), ("a", 2, "archived", 3, "stale"), ("a", 3, "active", 4, None), ("b", 1, "active", None, "x"), ("b", 2, "archived", None, " old ")],
        "id string, nth int, to_status string, expected_revision long, reason string",
    )
    got = {r.id: r for r in folds.status_changes(rows, changes, revisions, 500).collect()}
    assert (got["a"].status, got["a"].valid_until, got["a"].revision, got["a"].conflicts, got["a"].restored) == ("active", DAY(5), 5, 1, True)
    assert (got["b"].status, got["b"].valid_until, got["b"].revision, got["b"].forget_reason, got["b"].restored) == ("archived", DAY(7), 4, "old", True)

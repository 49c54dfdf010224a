import os
import sys
import time

import pytest
from pyspark import cloudpickle
from runlens.operators.verifiers import Checked, verifier

# The worker that reads the table function does not find the test's module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = [(f"i{k}", kind) for k, kind in enumerate(["good", "half", "skip", "raise", "hang", "die", "wild", "odd", None, "good"] * 3)]
WANT = {
    "good": ("ok", 1.0, True), "half": ("ok", 0.5, False), "skip": ("skipped", 1.0, False), "raise": ("error", 0.0, False),
    "hang": ("timeout", 0.0, False), "die": ("error", 0.0, False), "wild": ("error", 0.0, False),
    "odd": ("error", 0.0, False), None: ("ok", 0.25, False),
}


def check(row):
    kind = row["kind"]
    if kind == "raise":
        raise KeyError("no such thing")
    if kind == "hang":
        time.sleep(30)
    if kind == "die":
        os._exit(3)
    if kind == "wild":
        return 7
    if kind == "odd":
        return Checked(1.0, "unheard of")
    if kind == "skip":
        return Checked(1.0, "skipped", {"message": "nothing to check"})
    return {"good": 1, "half": 0.5}.get(kind, 0.25)


def test_a_bad_row_spoils_no_other(spark):
    rows = spark.createDataFrame(ROWS, "instance_id string, kind string").repartition(2)
    begin = time.time()
    got = verifier("unit", check, timeout=0.4)(rows.asTable()).collect()
    assert time.time() - begin < 25
    kinds = dict(ROWS)
    assert sorted(r["instance_id"] for r in got) == sorted(kinds)
    for r in got:
        assert (r["status"], r["score"], r["passed"]) == WANT[kinds[r["instance_id"]]], kinds[r["instance_id"]]
        details = {"raise": "KeyError", "die": "ProcessDied", "wild": "ValueError", "odd": "ValueError"}
        assert r["details"].get("error_type") == details.get(kinds[r["instance_id"]])
        assert (r["status"] == "timeout") == ("timeout" in r["details"])
    assert next(r for r in got if kinds[r["instance_id"]] == "die")["details"]["error"].endswith("code 3")


def test_from_sql_and_by_key(spark):
    rows = spark.createDataFrame([(k, "good") for k in range(6)], "n long, kind string")
    rows.createOrReplaceTempView("patches_to_check")
    spark.udtf.register("unit_check", verifier("unit", check, key="n", pass_threshold=0.5, partition_by=("n",)))
    got = spark.sql("select n, passed from unit_check(table(patches_to_check)) where n > 2 order by n").collect()
    assert [tuple(r) for r in got] == [(3, True), (4, True), (5, True)]
    assert spark.sql("select * from unit_check(table(select * from patches_to_check where n < 0))").collect() == []
    with pytest.raises(Exception, match="needs a table with the column n"):
        spark.sql("select * from unit_check(table(select 1 as m))").collect()
    with pytest.raises(ValueError):
        verifier("unit", check, pass_threshold=2.0)

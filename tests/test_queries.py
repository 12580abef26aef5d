import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronofold import queries_io  # noqa: F401  registers its queries
from chronofold.functions import jsonpath as J
from chronofold.operators import fold
from chronofold.operators.fold import fold_input, ordered_fold
from chronofold.queries import ARRIVAL, MIX, QUERIES, REPLACE, SQL, envelopes, projector
from chronofold.sinks.store import SnapshotStore, dead_letters
from tests.oracle import compare

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    compare(QUERIES[name](spark, D), SQL[name], D)


@pytest.mark.parametrize("name", ["dead_endpoint", "detach_delete", "incident_index"])
def test_node_and_edge_of_one_arrival(spark, tmp_path, name):
    """Ids 1,000,003 apart share an arrival: a node's delete there neither stops nor takes the edge, whichever id is smaller."""
    far = 1_000_003
    rows = [(1, 5, "signup"), (2, 6, "signup"), (10, 5, "error"), (10 + far, 5, "purchase"), (11, 6, "purchase"), (11 + far, 6, "error"), (12, 6, "purchase"), (12 + 2 * far, 5, "purchase")]
    spark.createDataFrame([(i, u, t, 1.0, "{}") for i, u, t in rows], "event_id long, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    compare(QUERIES[name](spark, str(tmp_path)), SQL[name], str(tmp_path))


@pytest.mark.parametrize("name", ["decide_log", "facet_entity_absent", "skip_reason_counts", "two_adapters_of_a_kind"])
def test_events_of_one_arrival_go_by_id(spark, tmp_path, name):
    """The SQL leaves the order of equal arrivals open; the queries give what it gives with the smaller id first."""
    far = 1_000_003
    rows = [(1, 5, "signup"), (10, 5, "error"), (10 + far, 5, "purchase"), (12, 5, "view"), (12 + far, 5, "view"), (13, 6, "error"), (13 + far, 6, "signup"), (14 + far, 6, "click"), (14, 6, "click"), (20, 5, "signup"), (20 + far, 5, "error")]
    spark.createDataFrame([(i, u, t, 1.0, "{}") for i, u, t in rows], "event_id long, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    open_, closed = f"PARTITION BY user_id ORDER BY {ARRIVAL})", f"PARTITION BY user_id ORDER BY {ARRIVAL}, event_id)"
    assert open_ in SQL[name]
    compare(QUERIES[name](spark, str(tmp_path)), SQL[name].replace(open_, closed), str(tmp_path))


def test_payload_values_are_taken_once(spark):
    """A row's payload is parsed without lambdas, each of its values is taken from it once, and keys are sorted by a hash."""
    plan = QUERIES["composite_key_rows"](spark, D)._jdf.queryExecution().executedPlan().toString()
    at = plan.find("lambdafunction")
    assert at < 0, plan[max(0, at - 400) : at + 200]
    assert plan.count("variant_get(parsed") == 3 and plan.count("Sort [_groupingexpression") == 2


def test_strict_json_of_odd_texts(spark):
    texts = ['{"a":1}', ' \t\r\n{"a":1} ', '{"a":1}}', '{"a":1},{"b":2}', '{"a":1},7', "[1]", '"x"', "7", "null", "", " ", "{", '{"a":1} x', '{"a":{"b":[1]}}', "{}", None, " {}", '{"a":1]']
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    shown = lambda df, c: {r.i: r.t for r in df.select("i", F.to_json(c).alias("t")).collect()}
    both = rows.select("i", "x", J.strict_json(F.col("x")).alias("v"), J.parsed_payload(F.col("x")).alias("o"))
    assert shown(J.with_strict_json(rows, F.col("x"), "v"), "v") == shown(both, "v")
    objects = shown(J.with_strict_json(rows, F.col("x"), "v", objects=True), "v")
    assert objects == shown(both, "o") and [i for i, t in objects.items() if t] == [0, 1, 13, 14]


def test_dead_letters_of_a_closed_form_run_no_fold(spark):
    """Failures of a target that only replaces come before the fold: looking for them sorts no entity."""
    p = projector(spark, REPLACE, failure_policy="continue_on_error")
    e = envelopes(spark, D)
    assert "Window [" not in dead_letters(e, p.apply(e).outcomes)._jdf.queryExecution().executedPlan().toString()


def test_outcomes_and_states_have_folds_of_their_own(spark):
    """A fold for outcomes builds no states; a route is cut without lambdas."""
    out = projector(spark, MIX).apply(envelopes(spark, D, scrambled=True))
    assert {r.row_type for r in ordered_fold(fold_input(projector(spark, MIX).projected(envelopes(spark, D))), only="outcome").select("row_type").distinct().collect()} == {"outcome"}
    assert out.state.count() == out.outcomes.select("entity_key").distinct().count() > 0
    plan = QUERIES["fold_failure_stops"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan


def test_fold_reads_columns_without_arrow_scalars():
    """What the fold takes from a batch are the values of to_pylist, of every type and with nulls, whole and sliced; only numbers with nulls go that slow way."""
    big = -(1 << 63)
    columns = [pa.array(x, t) for t, x in ((pa.string(), ["a", None, "", "ü"]), (pa.string(), ["1", "2", "3", "4"]), (pa.int64(), [big, 0, 7, (1 << 63) - 1]), (pa.int64(), [big, None, 7, (1 << 53) + 1]),
                                           (pa.int32(), [1, 2, 3, 4]), (pa.bool_(), [True, False, True, True]), (pa.bool_(), [True, None, False, None]), (pa.string(), [None] * 4), (pa.large_string(), ["a", None, "b", ""]))]
    for c in columns:
        for x in (c, c.slice(1, 2), c.slice(0, 0)):
            got, want = fold._values(x), x.to_pylist()
            assert got == want and [type(v) for v in got] == [type(v) for v in want]


def test_commit_steps_throw_and_start_nothing_by_row(spark, tmp_path):
    """A payload's check follows no path that leads nowhere (each throws), and a new store's state is no rows of Python."""
    plan = projector(spark, MIX).projected(envelopes(spark, D))._jdf.queryExecution().executedPlan().toString()
    assert "variant_get(whole_" not in plan
    state = SnapshotStore(spark, str(tmp_path / "s")).state()
    assert state.count() == 0 and "RDD" not in state._jdf.queryExecution().optimizedPlan().toString()
    kept = SnapshotStore(spark, str(tmp_path / "t"), 2)
    projector(spark, MIX).commit(envelopes(spark, D), kept, 0)
    assert state.dtypes == kept.state().dtypes

"""Properties on generated inputs."""

from collections import Counter
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starloom.functions.sketch import bucket_count
from starloom.operators import balance as ba
from starloom.operators.changes import HOUR_MICROS, unprocessed_sessions
from starloom.plans import model as m
from starloom.plans.sqltext import dimension_sql
from test_operators import EVENTS, LOG

few = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
T0 = datetime(2024, 1, 1)
hour = st.integers(0, 12)


@given(st.floats(0.002, 0.3))
def test_bucket_counts_meet_the_error(error):
    n = bucket_count(error)
    assert n & (n - 1) == 0 and 1.04 / n**0.5 <= error * 1.0000001 < 1.04 / (n / 2) ** 0.5 * 1.0000001


@few
@given(
    st.lists(st.tuples(st.sampled_from("abcd"), hour, st.integers(0, 3), st.sampled_from(["x", "y", None]), hour), max_size=25),
    st.lists(st.tuples(st.integers(0, 5), st.integers(0, 1), hour, hour, hour, st.sampled_from(["started", "committed", "COMMITTED", "failed"])), max_size=20),
)
def test_pending_sessions(spark, deliveries, lines):
    """Against the definition, delivery by delivery. Newest deliveries at one instant: an unread content makes a case."""
    at = lambda h: T0 + timedelta(hours=h)
    # a run has one window and shard, and its lines differ in time
    runs = {r: (r % 2, min(a, b), max(a, b)) for r, _, a, b, _, _ in lines}
    log = {(r, logged): status for r, _, _, _, logged, status in lines}
    rows = [(r, runs[r][0], at(runs[r][1]), at(runs[r][2]), at(logged), status) for (r, logged), status in log.items()]
    held = [runs[r] for r in runs if log[r, max(x for q, x in log if q == r)].lower() == "committed"]
    events = [(s, at(c), p, city, at(arrived)) for s, c, p, city, arrived in deliveries]
    got = {r["session_id"]: (r["publisher_id"], r["created_at_minute_id"])
           for r in unprocessed_sessions(spark.createDataFrame(events, EVENTS), spark.createDataFrame(rows, LOG), 2).collect()}

    def was_read(d):
        return any(d[2] % 2 == shard and at(lo) <= d[4] < at(hi) for shard, lo, hi in held)

    for s in {d[0] for d in events}:
        own = [d for d in events if d[0] == s]
        top = max(d[4] for d in own)
        cases = [d for d in own if d[4] == top and not any(was_read(e) and e[:4] == d[:4] for e in own)]
        assert (s in got) == bool(cases)
        if cases:
            assert got[s] in {(d[2], int((d[1] - datetime(1970, 1, 1)).total_seconds() // 60)) for d in cases}
    assert set(got) <= {d[0] for d in events} and HOUR_MICROS == 3600 * 10**6


@few
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 3000), min_size=1, max_size=40), st.integers(1, 12))
def test_placements_are_balanced(spark, counts, tasks):
    loads = spark.createDataFrame(list(counts.items()), "k int, n_rows bigint")
    plan = ba.plan_placement(loads, "k", tasks)
    total = sum(counts.values())
    assert sum(plan.planned) == total and len(plan.bins) == tasks * ba.BINS_PER_TASK
    # largest first onto the least loaded: the fullest task exceeds the even share by one item at most,
    # which is a shard (at most a quarter of the share) or a bin of light keys
    light = Counter()
    for k, h in loads.select("k", F.pmod(F.xxhash64("k"), F.lit(len(plan.bins)))).collect():
        if k not in plan.shards:
            light[h] += counts[k]
    item = max([-(-total // tasks) * ba.HEAVY_SHARE + 1, *light.values()])
    assert max(plan.planned) <= total / tasks + item


@given(st.text(alphabet="ab'\\", max_size=6))
def test_defaults_in_sql_text_are_quoted(value):
    table = m.Table("t", (m.Column("at", "timestamp", False), m.Column("c", "text")))
    fact = m.Fact("f", "t", (m.DimTime("at"), m.DimVal("c", "d")))
    env = m.Env((table,), (fact,), m.Settings(), (("text", "'" + value.replace("'", "''") + "'"),))
    text = dimension_sql(env, fact, "d", m.Mode.FULL)
    quoted = value.replace("\\", "\\\\").replace("'", "\\'")
    assert f"cast('{quoted}' as string)" in text

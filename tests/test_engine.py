import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from metricspark.engine import Batch, Engine
from metricspark.lang import nodes as N
from metricspark.lang.checker import compile_source
from metricspark.sources.schemas import Refused
from metricspark.sources.store import FolderStore, MemoryStore
from metricspark.streaming import changes as stream

SOURCE = """
# Somebody at work.
fact worker:
    name name
    name as text
    zone as text
    target as number

# A piece of work.
fact task:
    ref as text
    worker_id as text
    state as text
    size as number
    begun as moment
    done as moment

# A team of workers.
fact team:
    name name
    name as text
    many members:
        worker as text

group task.of from worker_id
group task.of_month from (worker_id, begun by month in worker.zone)
group task.of_team from worker_id through team.members.worker
filter task.open where state == "open"
filter task.large where size is set
measure task.length = done - begun

# Open tasks.
figure worker.open:
    display "{worker} has {value} open"
    depends:
        mine = task.of:{worker} & task.open
    calculate:
        count(mine)
    band:
        when value > worker.target then "over"
        otherwise "ok"

# Sizes of open tasks.
figure worker.size:
    display "size"
    unit effort
    depends:
        mine = task.of:{worker} & task.open
    calculate:
        sum(task.size over mine)

# Size of a task.
figure worker.each:
    display "each"
    unit effort
    calculate:
        worker.size / worker.open

# Tasks begun each month.
figure worker.months bucketed:
    display "months"
    depends:
        mine = task.of_month:{worker}
    calculate:
        count(mine)

# Their lengths.
figure worker.lengths bucketed:
    display "lengths"
    depends:
        mine = task.of_month:{worker} & task.large
    calculate:
        list(task.length over mine)

# The size in force.
figure worker.in_force bucketed:
    display "in force"
    unit count
    depends:
        mine = task.of_month:{worker}
    calculate:
        latest(task.size over mine) carried forward

# Months of tasks.
reading worker.pace(range):
    display "pace"
    depends:
        v = worker.months in range
    calculate:
        sum(v)
        series(v)
        delta(v)

# A row for each task.
projection task.page:
    sort by size descending
    field:
        ref = ref as text
        size = size as number
        begun = begun as date
    value:
        big in count =
            when size > 3 then 1
            otherwise 0
    flag big-task when big == 1:
        label "{ref} is {size}"
        severity attention

# All tasks.
summarise task.all over task.page:
    count tasks
    count big_tasks where big == 1
    total sizes in effort = size

# A worker's page.
bundle worker.page:
    open = figure worker.open
    pace = reading worker.pace over 3, 1-2
    tasks = projection task.page
    sums = summarise task.all
"""
AT = dt.datetime(2026, 8, 24, 12)
LIB = compile_source(SOURCE)
SMALL = N.Library(facts={k: LIB.facts[k] for k in ("worker", "task")}, groups={"task.of": LIB.groups["task.of"]}, filters={"task.open": LIB.filters["task.open"]}, figures={"worker.open": LIB.figures["worker.open"]})
CARDS = compile_source(SOURCE + """
# A row for each worker.
projection worker.card:
    field:
        name = name as text
    read:
        open = worker.open

# All workers.
summarise worker.all over worker.card:
    count workers
""")
WORKERS = {"w1": {"name": "Ann", "zone": "Europe/London", "target": 1}, "w2": {"name": "Bo", "zone": "Pacific/Auckland"}, "w3": {"name": "Cy", "zone": "nowhere"}}


def task(worker, state="open", size=None, begun="2026-06-25T14:00:00Z", done=None):
    return {k: v for k, v in {"ref": f"r-{worker}", "worker_id": worker, "state": state, "size": size, "begun": begun, "done": done}.items() if v is not None}


def values(engine, name):
    df = engine.store.get("values", name)
    keys = [c for c in ("subject", "tail") if c in df.columns]
    return {tuple(r[k] for k in keys): r["value"] for r in df.collect()}


@pytest.fixture()
def engine(spark):
    e = Engine(spark, LIB)
    e.apply(Batch(writes={"worker": WORKERS, "task": {"t1": task("w1", size=2), "t2": task("w1", "done", 5, done="2026-06-26T14:00:00Z"), "t3": task("w2", size=0, begun="2026-06-30T13:00:00Z")}}), AT)
    return e


def test_a_full_pass(engine):
    assert values(engine, "worker.open") == {("w1",): 1.0, ("w2",): 1.0, ("w3",): 0.0}
    assert values(engine, "worker.each")[("w3",)] is None  # nothing over nothing
    assert values(engine, "worker.months") == {("w1", "2026-06"): 2.0, ("w2", "2026-07"): 1.0}  # its own calendar; w3 has none
    assert values(engine, "worker.lengths") == {("w1", "2026-06"): [86400.0]}
    assert values(engine, "worker.in_force")[("w1", "2026-08")] == 5.0 and ("w1", "2026-09") not in values(engine, "worker.in_force")
    assert values(engine, "worker.in_force")[("w2", "2026-08")] == 0.0


def test_a_warm_pass_tells_what_moved(engine):
    heard = []
    stop = engine.subscribe(heard.append, ["worker.page"])
    out = engine.apply(Batch(writes={"task": {"t4": task("w2", size=1)}}), AT)
    assert not out.full and [tuple(r) for r in out.changes["worker.open"].collect()] == [("w2", "moved", 1.0, 2.0)]
    assert {"worker.open", "worker.each", "worker.pace", "worker.page"} <= set(out.impacted) and len(heard) == 1
    stop()
    out = engine.apply(Batch(writes={"task": {"t4": task("w2", size=1)}}), AT)  # the same again
    assert all(c.isEmpty() for c in out.changes.values()) and len(heard) == 1


def test_warm_is_full(spark):
    rng = random.Random(11)
    warm = Engine(spark, LIB)
    warm.apply(Batch(writes={"worker": WORKERS, "task": {}}), AT)
    state = {}
    for _ in range(3):
        batch = {f"t{rng.randrange(12)}": task(rng.choice(["w1", "w2", "w3", "gone"]), rng.choice(["open", "done"]), rng.choice([None, 0, 1, 4]), f"2026-0{rng.randint(4, 8)}-0{rng.randint(1, 9)}T23:30:00Z", rng.choice([None, "2026-08-20T00:00:00Z"])) for _ in range(5)}
        state |= batch
        assert not warm.apply(Batch(writes={"task": batch}), AT).full
    full = Engine(spark, LIB)
    full.apply(Batch(writes={"worker": WORKERS, "task": state}), AT)
    for name in LIB.figures:
        assert values(warm, name) == values(full, name), name


def test_deletes_and_calendars_escalate(engine):
    out = engine.apply(Batch(deletes={"worker": ["w1"]}), AT)
    assert out.full
    gone = {r["subject"]: r for r in out.changes["worker.open"].collect()}
    assert gone["w1"]["kind"] == "removed" and gone["w1"]["before"] == 1.0 and ("w1",) not in values(engine, "worker.open")
    assert engine.apply(Batch(writes={"worker": {"w3": {"name": "Cy", "zone": "UTC"}}}), AT).full


def test_stale_stamps_do_not_land(engine):
    day = lambda d: dt.datetime(2026, 1, d)
    write = lambda size, d: engine.apply(Batch(writes={"task": {"t9": task("w3", size=size)}}, stamps={"task": {"t9": day(d)}} if d else {}), AT)
    write(1, 5)
    write(2, 4)
    assert values(engine, "worker.size")[("w3",)] == 1.0
    write(3, 5)
    assert values(engine, "worker.size")[("w3",)] == 3.0
    write(4, None)
    assert values(engine, "worker.size")[("w3",)] == 4.0


@pytest.mark.parametrize("body", [{"what": 1}, {"size": "3"}, {"size": True}, {"size": float("nan")}, {"begun": "2026"}, {"state": 7}, {"ref": "a\0b"}])
def test_batches_are_refused_whole(engine, body):
    with pytest.raises(Refused, match="task 'bad'"):
        engine.apply(Batch(writes={"task": {"fine": task("w1"), "bad": body}}), AT)
    assert engine.store.get("facts", "task").count() == 3


def test_null_and_empty_fields_are_unsaid(engine):
    engine.apply(Batch(writes={"task": {"t8": {"nothing": None, "worker_id": "", "state": "open"}}}), AT)
    assert sum(values(engine, "worker.open").values()) == 2.0


def test_deferred_loads_make_the_next_pass_full(engine):
    out = engine.apply(Batch(writes={"task": {"t7": task("w3")}}, defer=True), AT)
    assert not out.changes and values(engine, "worker.open")[("w3",)] == 0.0
    assert engine.apply(Batch(writes={"task": {"t6": task("w3")}}), AT).full and values(engine, "worker.open")[("w3",)] == 2.0
    with pytest.raises(ValueError):
        engine.apply(Batch(full=True, defer=True), AT)


def test_answers(engine, spark):
    got = engine.answer("worker.open", at=AT)
    assert got.state == "ok" and [(r["label"], r["value"], r["level"]) for r in got.rows.collect()] == [("Ann", 1.0, "ok"), ("Bo", 1.0, "unknown"), ("Cy", 0.0, "unknown")]
    pace = {(r["subject"], r["window"]): r for r in engine.answer("worker.pace", ["3", "1-2"], AT).rows.collect()}
    assert pace["w1", "3"]["series"] == [2.0, None, None] and pace["w1", "3"]["delta"] == [None, None, None] and pace["w1", "3"]["total"] == 2.0
    assert pace["w2", "1-2"]["series"] == [1.0, None] and "w3" not in {k for k, _ in pace}
    page = engine.answer("worker.page", at=AT)
    assert [r["id"] for r in page["tasks"].rows.collect()] == ["t2", "t1", "t3"]
    assert page["sums"].rows.first().asDict() == {"tasks": 3.0, "big_tasks": 1.0, "sizes": 7.0, "flags": []}
    assert engine.flags("task.page", page["tasks"].rows)[0]["label"] == "r-w1 is 5"
    assert Engine(spark, LIB).answer("worker.open", at=AT).state == "never-computed"
    other = Engine(spark, compile_source(SOURCE.replace('state == "open"', 'state == "new"')), engine.store)
    assert other.answer("worker.open", at=AT).state == "behind-deploy"
    empty = Engine(spark, LIB)
    empty.apply(Batch(writes={"worker": WORKERS}), AT)
    assert empty.answer("worker.open", at=AT).state == "nothing-collected"


def test_evidence_and_working(engine):
    rows = engine.evidence("worker.open", "w1", at=AT).collect()
    assert [(r["member"], r["held"]) for r in rows] == [("t1", True)]
    assert [r["member"] for r in engine.evidence("worker.lengths", "w1", "2026-06", AT).collect()] == ["t2"]
    assert {r["member"] for r in engine.evidence("worker.each", "w1", at=AT).collect()} == {"worker.size:w1", "worker.open:w1"}
    assert [r["member"] for r in engine.evidence("worker.in_force", "w1", "2026-08", AT).collect()] == ["t2"]  # the anchor's record
    w = engine.working("worker.size", "w1", AT)
    assert w["agrees"] and w["value"] == {("w1",): 2.0} and w["steps"] == [{"set": "mine", "members": 1}]


def test_a_folder_keeps_whole_states(spark, tmp_path):
    store = FolderStore(spark, str(tmp_path))
    Engine(spark, LIB, store).apply(Batch(writes={"worker": WORKERS, "task": {"t1": task("w1", size=2)}}), AT)
    again = Engine(spark, LIB, FolderStore(spark, str(tmp_path)))
    assert values(again, "worker.open")[("w1",)] == 1.0
    assert not again.apply(Batch(writes={"task": {"t2": task("w1")}}), AT).full
    assert values(Engine(spark, LIB, FolderStore(spark, str(tmp_path))), "worker.open")[("w1",)] == 2.0
    again.store.put("values", "worker.open", spark.createDataFrame([("x", 9.0)], "subject string, value double"))  # not committed
    assert values(Engine(spark, LIB, FolderStore(spark, str(tmp_path))), "worker.open")[("w1",)] == 2.0
    assert FolderStore(spark, str(tmp_path)).vacuum() > 0
    assert values(Engine(spark, LIB, FolderStore(spark, str(tmp_path))), "worker.open")[("w1",)] == 2.0
    other = FolderStore(spark, str(tmp_path), tenant="other")
    assert other.get("values", "worker.open") is None
    assert FolderStore(spark, str(tmp_path)).delete_tenant()
    assert FolderStore(spark, str(tmp_path)).get("values", "worker.open") is None


def test_a_stream_of_changes(spark, tmp_path):
    import json

    engine = Engine(spark, LIB)
    engine.apply(Batch(writes={"worker": WORKERS}), AT)
    rows = [("task", "t1", None, json.dumps(task("w1", size=1))), ("task", "t2", None, json.dumps(task("w2"))), ("task", "t2", None, None)]
    schema = "kind string, key string, source_stamp timestamp, body string"
    spark.createDataFrame(rows[:2], schema).write.json(str(tmp_path / "in"))
    changes = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    stream.run(engine, changes, str(tmp_path / "ckpt"), clock=lambda: AT).awaitTermination()
    assert values(engine, "worker.open") == {("w1",): 1.0, ("w2",): 1.0, ("w3",): 0.0}
    spark.createDataFrame(rows[2:], schema).write.mode("append").json(str(tmp_path / "in"))
    stream.run(engine, changes, str(tmp_path / "ckpt"), clock=lambda: AT).awaitTermination()
    assert values(engine, "worker.open")[("w2",)] == 0.0


def test_jobs_of_a_pass_do_not_grow_with_the_roster(spark):
    def jobs(n):
        e = Engine(spark, LIB)
        e.apply(Batch(writes={"worker": {f"w{i}": {"name": f"n{i}", "zone": "UTC"} for i in range(n)}, "task": {f"t{i}": task(f"w{i}", size=1) for i in range(n)}}), AT)
        spark.sparkContext.setJobGroup(f"pass{n}", "")
        e.apply(Batch(writes={"task": {"t0": task("w0", size=2)}}), AT)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"pass{n}"))

    few, many = jobs(4), jobs(40)
    assert abs(few - many) <= 0.2 * few


def test_union_with_everybodys_members(spark):
    lib = compile_source(SOURCE.replace("mine = task.of:{worker} & task.open\n    calculate:\n        count(mine)", "mine = task.of:{worker} | task.open\n    calculate:\n        count(mine)"))
    e = Engine(spark, lib)
    e.apply(Batch(writes={"worker": WORKERS, "task": {"t1": task("w1"), "t2": task("w2", "done")}}), AT)
    assert values(e, "worker.open") == {("w1",): 1.0, ("w2",): 2.0, ("w3",): 1.0}
    e.apply(Batch(writes={"task": {"t3": task("w1")}}), AT)
    assert values(e, "worker.open") == {("w1",): 2.0, ("w2",): 3.0, ("w3",): 2.0}
    assert F is not None


def test_import_debt_outlives_the_engine(spark, tmp_path):
    """A deferred record of a worker is counted after a restart, though the next batch is about another worker."""
    first = Engine(spark, LIB, FolderStore(spark, str(tmp_path)))
    first.apply(Batch(writes={"worker": WORKERS, "task": {"t1": task("w1")}}), AT)
    first.apply(Batch(writes={"task": {"t2": task("w2")}}, defer=True), AT)
    again = Engine(spark, LIB, FolderStore(spark, str(tmp_path)))
    assert again.debt and again.apply(Batch(writes={"task": {"t3": task("w1")}}), AT).full
    assert values(again, "worker.open") == {("w1",): 2.0, ("w2",): 1.0, ("w3",): 0.0}
    assert not Engine(spark, LIB, FolderStore(spark, str(tmp_path))).debt


def test_a_warm_pass_writes_what_changed(spark, tmp_path):
    """One changed record writes as many bytes on a table of many records as on one of few."""

    def size(folder):
        return sum(p.stat().st_size for p in folder.rglob("*.parquet"))

    def written(n):
        folder = tmp_path / str(n)
        e = Engine(spark, SMALL, FolderStore(spark, str(folder)))
        e.apply(Batch(writes={"worker": {f"w{i}": {"name": f"n{i}"} for i in range(n)}, "task": {f"t{i}": task(f"w{i}", size=i) for i in range(n)}}), AT)
        before = size(folder)
        assert not e.apply(Batch(writes={"task": {"t1": task("w2", size=1)}}), AT).full
        got = values(e, "worker.open")
        assert got[("w1",)] == 0.0 and got[("w2",)] == 2.0
        return size(folder) - before

    assert written(20_000) < 1.2 * written(200)


def test_layers_are_merged_and_say_the_same(spark):
    """Many changes of one table: as a plain dictionary does."""
    rng, store, want = random.Random(3), MemoryStore(spark), {f"k{i}": 0 for i in range(200)}
    store.put("facts", "x", spark.createDataFrame(list(want.items()), "key string, v long"))
    for n in range(1, 20):
        keys = [f"k{rng.randrange(220)}" for _ in range(4)]
        rows = {k: n for k in keys[:3]}
        for k in keys:
            want.pop(k, None)
        want |= rows
        store.change("facts", "x", spark.createDataFrame(list(rows.items()), "key string, v long"), spark.createDataFrame([(k,) for k in keys], "key string"), "key")
        assert len(store.tables["facts/x"]["changes"]) < 8
    assert {r["key"]: r["v"] for r in store.get("facts", "x").collect()} == want


def test_one_new_definition_heals_alone(engine, spark):
    """A changed filter rebuilds itself and what reads it; the rest is not looked at, and removed names are forgotten."""
    lib = compile_source(SOURCE.replace('state == "open"', 'state == "done"'))
    other = Engine(spark, lib, engine.store)
    assert other.answer("worker.open", at=AT).state == "behind-deploy"
    assert other.answer("worker.page", at=AT)["tasks"].state in ("ok", "behind-deploy")
    stale = other.stale()
    assert "worker.open" in stale and stale != {*lib.figures, *lib.groups, *lib.filters}
    out = other.apply(Batch(), AT)
    assert not out.full and values(other, "worker.open") == {("w1",): 1.0, ("w2",): 0.0, ("w3",): 0.0}
    assert set(out.changes) <= {n for n in lib.figures if n in stale or lib.figures[n].carried}
    fresh = Engine(spark, lib)
    fresh.apply(Batch(writes={"worker": WORKERS, "task": {"t1": task("w1", size=2), "t2": task("w1", "done", 5, done="2026-06-26T14:00:00Z"), "t3": task("w2", size=0, begun="2026-06-30T13:00:00Z")}}), AT)
    for name in lib.figures:
        assert values(other, name) == values(fresh, name), name
    smaller = Engine(spark, SMALL, engine.store)
    smaller.apply(Batch(), AT)
    assert set(engine.store.names("values")) == set(SMALL.figures)


def test_prose_moves_no_value_but_what_is_served(engine, spark):
    lib = compile_source(SOURCE.replace("{worker} has {value} open", "{worker} holds {value} open"))
    out = Engine(spark, lib, engine.store).apply(Batch(), AT)
    assert not out.full and "worker.open" in out.impacted and "worker.size" not in out.impacted


def test_pages_say_whether_they_are_built(engine, spark):
    """never-computed, behind-deploy, nothing-collected and ok of a page and of the summary over it."""
    assert engine.answer("task.page", at=AT).state == "ok" and engine.answer("task.all", at=AT).state == "ok"
    none = Engine(spark, LIB)
    assert none.answer("task.page", at=AT).state == "nothing-collected" and none.answer("task.page", at=AT).rows is None
    landed = Engine(spark, CARDS)
    landed.apply(Batch(writes={"worker": WORKERS, "task": {"t1": task("w1")}}, defer=True), AT)
    assert landed.answer("worker.card", at=AT).state == "never-computed" and landed.answer("worker.all", at=AT).rows is None
    landed.apply(Batch(), AT)
    assert landed.answer("worker.all", at=AT).rows.first()["workers"] == 3.0
    assert {r["id"]: r["row_name"] for r in landed.answer("worker.card", at=AT).rows.collect()} == {"w1": "Ann", "w2": "Bo", "w3": "Cy"}
    other = Engine(spark, N.Library(**{**vars(CARDS), "figures": {**CARDS.figures, "worker.open": CARDS.figures["worker.size"]}}), landed.store)
    assert other.answer("worker.card", at=AT).state == "behind-deploy" and other.answer("worker.all", at=AT).state == "behind-deploy"
    assert {r["row_name"] for r in engine.answer("task.page", at=AT).rows.collect()} <= {"t1", "t2", "t3", "r-w1", "r-w2"}


def test_frames_and_streams_pass_the_gate(engine, spark):
    with pytest.raises(Refused, match="what isn't declared"):
        engine.apply(Batch(writes={"task": spark.createDataFrame([("t9", 1.0)], "key string, what double")}), AT)
    with pytest.raises(Refused, match="size is no double"):
        engine.apply(Batch(writes={"task": spark.createDataFrame([("t9", "big")], "key string, size string")}), AT)
    engine.apply(Batch(writes={"task": spark.createDataFrame([("t9", "w3", "open", 3)], "key string, worker_id string, state string, size int")}), AT)
    assert values(engine, "worker.size")[("w3",)] == 3.0
    for body in ('{"size": "big"}', '{"what": 1}', "no json"):
        with pytest.raises(Refused):
            stream.apply_changes(engine, spark.createDataFrame([("task", "t9", None, body)], "kind string, key string, source_stamp timestamp, body string"), AT)
    assert values(engine, "worker.size")[("w3",)] == 3.0

import datetime as dt
import json
import threading
import urllib.request

from metricspark.lang.source import about, source_of
from metricspark import server
from metricspark.server import Doors, serve

from .test_engine import AT, LIB, SOURCE, WORKERS, task


def test_routes(spark, tmp_path, monkeypatch):
    doors = Doors(spark, str(tmp_path), lambda: AT)
    assert doors.call("GET", "/tenants/a/results/worker.open")[0] == 404
    assert doors.call("PUT", "/tenants/a/definitions", body={"source": "fact x:\n    y as text"})[0] == 422
    status, out = doors.call("PUT", "/tenants/a/definitions", body={"source": SOURCE})
    assert status == 200 and "worker.page" in out["names"]
    assert doors.call("POST", "/tenants/a/facts", body={"writes": {"task": {"bad": {"size": "x"}}}})[0] == 422
    status, out = doors.call("POST", "/tenants/a/facts", body={"writes": {"worker": WORKERS, "task": {"t1": task("w1", size=2)}}})
    assert status == 200 and out["full"]
    assert [r["value"] for r in doors.call("GET", "/tenants/a/results/worker.open")[1]["rows"]] == [1.0, 0.0, 0.0]
    pace = doors.call("GET", "/tenants/a/results/worker.pace", {"over": ["3,each:1-2"], "at": ["2026-08-20"]})[1]
    assert {r["window"] for r in pace["rows"]} == {"3", "1-1", "2-2"}
    assert doors.call("GET", "/tenants/a/results/worker.pace", {"over": ["0"]})[0] == 422
    assert set(doors.call("GET", "/tenants/a/results/worker.page")[1]) == {"open", "pace", "tasks", "sums"}
    assert [r["member"] for r in doors.call("GET", "/tenants/a/evidence/worker.open/w1")[1]["rows"]] == ["t1"]
    assert doors.call("GET", "/tenants/a/working/worker.open/w1")[1]["agrees"]
    assert "count(mine)" in doors.call("GET", "/tenants/a/about/worker.open")[1]["source"]
    assert doors.call("GET", "/tenants/a/runs")[1][0]["full"] is True
    doors.call("POST", "/tenants/a/facts", body={"writes": {"task": {"t1": task("w1", "done", size=2)}}})
    assert "worker.open w1: 1 -> 0" in doors.call("GET", "/tenants/a/runs")[1][0]["told"]
    found = {(r["index"], r["subject"]) for r in doors.engine("a").member_of("task", "t1").collect()}
    assert found == {("task.of", "w1"), ("task.of_month", "w1"), ("task.large", None)}
    assert {k["kind"]: k["records"] for k in doors.call("GET", "/tenants/a/kinds")[1]}["worker"] == 3
    page = doors.call("GET", "/tenants/a/records/worker", {"n": ["2"]})[1]
    assert [r["key"] for r in page["rows"]] == ["w1", "w2"] and page["more"]
    assert not doors.call("GET", "/tenants/a/records/worker", {"n": ["2"], "after": ["w2"]})[1]["more"]
    one = doors.call("GET", "/tenants/a/records/task/t1")[1]
    assert one["size"] == 2.0 and {r["index"] for r in one["member_of"]["rows"]} == {"task.of", "task.of_month", "task.large"}
    assert doors.call("GET", "/tenants/a/records/task/none")[0] == 404
    monkeypatch.setattr(server, "MOST_ROWS", 2)
    cut = doors.call("GET", "/tenants/a/results/worker.open")[1]
    assert len(cut["rows"]) == 2 and cut["more"]  # what is left out is said
    assert doors.call("DELETE", "/tenants/a")[0] == 200 and doors.call("GET", "/tenants/a/runs")[0] == 404


def test_over_a_socket(spark, tmp_path):
    door = serve(Doors(spark, str(tmp_path), lambda: dt.datetime(2026, 1, 1)))
    threading.Thread(target=door.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{door.server_port}/health") as r:
        assert json.load(r) == {"ok": True, "tenants": []}
    door.shutdown()


def test_what_a_name_says_of_itself():
    assert about(LIB, "worker.open") | {"line": 0} == {"is": "figure", "name": "worker.open", "prose": "Open tasks.", "display": "{worker} has {value} open", "label": "", "unit": None, "line": 0}
    text = source_of(SOURCE, "worker.size")
    assert text.startswith("# Sizes of open tasks.\nfigure worker.size:") and text.endswith("sum(task.size over mine)")
    assert source_of(SOURCE, "task.open") == 'filter task.open where state == "open"'

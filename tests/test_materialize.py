"""Generations, the registry, planning and the job, with a clock of our own."""

from datetime import UTC, datetime, timedelta

import pytest

from queryloom.materialize.builder import Materializer, index_names
from queryloom.materialize.job import Admin, RefreshJob
from queryloom.materialize.manifest import Manifests, from_dict, generation_pattern
from queryloom.materialize.planner import Planner, State
from queryloom.materialize.registry import Registry, Resolver
from queryloom.queries import f, fn, items, op
from queryloom.service import QueryService
from queryloom.sources.catalog import StaticCatalog
from queryloom.sources.store import Store
from queryloom.sources.tables import Frames, Sources


class Clock:
    def __init__(self):
        self.at = datetime(2024, 1, 1, 1, 0, tzinfo=UTC)

    def __call__(self):
        self.at += timedelta(seconds=1)
        return self.at


def manifest(i, table="src", **more):
    return {"id": i, "targetSchema": "rep", "target": {"logicalTable": i, "keepGenerations": 2}, "query": {"table": table, "fields": items(k=f("k", table))}, "columns": [{"name": "key", "type": "bigint"}], **more}


@pytest.fixture
def world(spark, tmp_path):
    clock = Clock()
    store, registry = Store(spark, str(tmp_path / "s")), Registry(tmp_path / "registry.json", lambda: int(clock.at.timestamp()))
    frames = Frames({"src": spark.createDataFrame([(1,), (2,), (None,)], "k int")})
    service = QueryService(spark, StaticCatalog(), Sources(Resolver(registry, store), frames), store)
    return clock, service, registry, Materializer(service, registry, clock)


def test_build_publish_retire(world):
    clock, service, registry, m = world
    spec = from_dict(manifest("course"))
    other = from_dict(manifest("course_rows"))
    assert m.build(other).ok
    for _ in range(4):
        r = m.build(spec)
        assert r.ok and r.row_count == 3
    names = [n for n in service.store.names() if generation_pattern(spec).fullmatch(n)]
    assert len(names) == 2 and r.physical_table in names and registry.current("course", "rep")["physical_table"] == r.physical_table
    assert registry.current("course_rows")["physical_table"] in service.store.names()
    assert sum(g["is_current"] for g in registry.generations("course")) == 1
    assert sorted(map(str, service.sources.table("course").collect())) == ["Row(key=1)", "Row(key=2)", "Row(key=None)"]
    assert [x["status"] for x in registry.runs("course")] == ["success"] * 4


def test_failed_builds_leave_nothing(world):
    _, service, registry, m = world
    bad = from_dict(manifest("x", columns=[{"name": "key", "type": "bigint", "nullable": False}]))
    r = m.build(bad)
    assert not r.ok and "cannot be null" in r.message and service.store.names() == [] and registry.current("x") is None
    assert registry.runs("x")[0]["status"] == "failed"
    assert not m.build(from_dict({"id": "y"})).ok
    assert "not implemented" in m.refresh(from_dict(manifest("z", refresh={"mode": "incremental"}))).message


def test_raw_select_and_chain(world):
    _, service, _, m = world
    raw = from_dict(manifest("r", query={"type": "raw_select", "sql": "SELECT key + 1 FROM {{table:rep.course}} WHERE key IS NOT NULL"}))
    assert "not published" in m.build(raw).message
    m.build(from_dict(manifest("course")))
    assert m.build(raw).row_count == 2
    assert sorted(r[0] for r in service.sources.table("r").collect()) == [2, 3]
    assert not m.build(from_dict(manifest("q", query={"type": "raw_select", "sql": "DROP TABLE x"}))).ok


def test_index_names():
    m = from_dict(manifest("a b", indexes=[{"columns": ["key"]}, {"fields": ["key"], "unique": True, "name": "u"}]))
    assert index_names(m) == {"idx_a_b_key": {"columns": ["key"], "unique": False}, "u": {"columns": ["key"], "unique": True}}
    assert list(index_names(from_dict(manifest("m", indexes={"named": ["key"]})))) == ["named"]


def test_variants_and_conditions():
    where = op("=", f("k"), 1)
    specs = [manifest("v", variantPriority=1, priority=5), manifest("v", variantPriority=2, conditions={"requiresTables": ["extra"]}, priority=7), manifest("off", enabled=False), manifest("w", conditionalWhere=[{"requiresTables": ["extra"], "where": where, "dependsOn": ["v"]}])]
    assert [(m.id, m.priority) for m in Manifests(specs).all()] == [("v", 5), ("w", 100)]
    found = Manifests(specs, lambda t: t == "extra")
    assert found.get("v").priority == 7 and found.get("w").query["where"] == where and found.get("w").depends_on == ("v",)
    t = found.table("w")
    assert t.domain == "rep" and "materialized" in t.tags


def test_planning(world):
    clock, _, registry, m = world
    ms = Manifests([manifest("m10", dependsOn=["m2"]), manifest("m2", dependsOn=["m1"], refresh={"schedule": {"policy": "manual"}}), manifest("m1", refresh={"schedule": {"policy": "daily_after", "time": "02:00"}}), manifest("m3", priority=1, refresh={"schedule": {"policy": "always"}})])
    state = State()
    p = Planner(ms, registry, state, clock)
    assert [x.id for x in p.plan()] == ["m3", "m1", "m2", "m10"]  # missing dependencies come along
    for i in ("m1", "m2"):
        m.build(ms.get(i))
    assert [x.id for x in p.plan()] == ["m3", "m10"]
    p.attempt(ms.get("m10"))
    p.result(ms.get("m10"), m.build(ms.get("m10")))
    assert [x.id for x in p.plan()] == ["m3"]
    clock.at += timedelta(seconds=301)
    assert [x.id for x in p.plan()] == ["m3", "m10"]
    clock.at = datetime(2024, 1, 1, 2, 0, tzinfo=UTC)
    assert [x.id for x in p.plan()] == ["m3", "m1", "m10"]
    assert [x.id for x in p.plan(only=["m10"], force=True)] == ["m1", "m2", "m10"]
    loop = Planner(Manifests([manifest("a", dependsOn=["b"]), manifest("b", dependsOn=["a"])]), registry, state, clock)
    with pytest.raises(RuntimeError, match="Circular materialization dependency detected at manifest: a"):
        loop.plan()


def test_job_and_admin(world, tmp_path):
    clock, _, registry, m = world
    p = Planner(Manifests([manifest("a"), manifest("b", table="nowhere")]), registry, State(tmp_path / "state.json"), clock)
    job = RefreshJob(p, m, {"keep_runs": 1, "force": True})
    assert job.run().startswith("2 manifests, 1 refreshed, 1 failed; cleanup") and job.settings["force"] is False
    assert State(tmp_path / "state.json").get(p.key("a", "last_status")) == "success"
    assert "cleanup" not in job.run()
    admin = Admin(job)
    assert admin.overview()["manifests"] == 2 and admin.overview()["current"] == 1 and admin.overview()["failed"] >= 1
    g = admin.grid("manifests", search="NOWHERE")
    assert g["total"] in (0, 1) and admin.grid("manifests", sort="id", direction="DESC")["rows"][0]["id"] == "b"
    assert admin.grid("runs", size=1000)["size"] == 250 and admin.grid("runs", filters={"status": "succ"})["total"] >= 1
    assert admin.act("refresh_manifest", "a").ok and admin.act("refresh_all").startswith("2 manifests")
    assert RefreshJob(p, m, {"active": False}).run() == "Materialization refresh is not active."
    run = registry.start({"manifest_id": "a"})
    registry.start({"manifest_id": "a"})
    assert next(r for r in registry.runs("a") if r["id"] == run)["message"].startswith("Superseded")
    assert registry.clean(lambda t: False, 1)["runs"] > 0

"""The refresh job that a scheduler calls, and what an administration page shows."""

from __future__ import annotations

from typing import Any

from queryloom.materialize.builder import Materializer
from queryloom.materialize.planner import Planner, natural

PERIOD, KEEP_RUNS = 86_400, 100


class RefreshJob:
    """Settings: active, priority, mode (refresh, full, incremental), manifests (all, csv or list), force, cleanup_seconds, keep_runs."""

    def __init__(self, planner: Planner, materializer: Materializer, settings: dict[str, Any] | None = None) -> None:
        self.planner, self.materializer, self.settings = planner, materializer, dict(settings or {})

    @property
    def active(self) -> bool:
        return bool(self.settings.get("active", True))

    @property
    def priority(self) -> int:
        return int(self.settings.get("priority", 1))

    def _only(self) -> list[str] | None:
        given = self.settings.get("manifests", "all")
        names = [x.strip() for x in given.split(",")] if isinstance(given, str) else [str(x) for x in given or ()]
        names = [x for x in names if x]
        return None if not names or names == ["all"] else names

    def maintain(self) -> str | None:
        """At most once a period: forget what is gone."""
        state, now = self.planner.state, int(self.planner.clock().timestamp())
        period = int(self.settings.get("cleanup_seconds", PERIOD))
        last = state.get("materialization.last_cleanup_at")
        if last is not None and now - int(last) < period:
            return None
        names = set(self.materializer.store.names())
        n = self.materializer.registry.clean(lambda t: t in names, int(self.settings.get("keep_runs", KEEP_RUNS)))
        state.set("materialization.last_cleanup_at", now)
        return f"cleanup: {n['generations']} generations, {n['runs']} runs removed"

    def run(self) -> str:
        if not self.active:
            return "Materialization refresh is not active."
        notes = [x for x in (self.maintain(),) if x]
        force = bool(self.settings.get("force", False))
        todo = self.planner.plan(self._only(), force)
        ok = failed = 0
        for m in todo:
            self.planner.attempt(m)
            mode = self.settings.get("mode", "refresh")
            r = {"full": self.materializer.build, "incremental": self.materializer.incremental}.get(mode, self.materializer.refresh)(m)
            self.planner.result(m, r)
            ok, failed = ok + r.ok, failed + (not r.ok)
            notes.append(f"{m.id}: {'ok' if r.ok else 'failed'}, {r.message}")
        if force:
            self.settings["force"] = False
        self.planner.state.flush()
        return "; ".join([f"{len(todo)} manifests, {ok} refreshed, {failed} failed", *notes])


class Admin:
    """Grids over manifests, generations, runs and tables, with counters and actions."""

    def __init__(self, job: RefreshJob) -> None:
        self.job, self.planner, self.materializer = job, job.planner, job.materializer
        self.registry = job.materializer.registry

    def rows(self, what: str) -> list[dict[str, Any]]:
        p = self.planner
        if what == "manifests":
            out = []
            for m in p.manifests.all():
                g = self.registry.current(m.logical_table, m.target_schema)
                out.append({"id": m.id, "enabled": m.enabled, "priority": m.priority, "logical_table": m.logical_table, "target_schema": m.target_schema, "policy": m.schedule.get("policy", "interval"), "due": p.due(m), "current": g["physical_table"] if g else None, "row_count": g["row_count"] if g else None, **{k: p.state.get(p.key(m.id, k)) for k in ("last_status", "last_message", "last_success_at")}})
            return out
        if what == "registry":
            return self.registry.generations()
        if what == "runs":
            return self.registry.runs()
        if what == "tables":
            current = {g["physical_table"] for g in self.registry.generations() if g["is_current"]}
            return [{"id": n, "current": n in current} for n in self.materializer.store.names()]
        raise ValueError(f"Unknown grid: {what}")

    def grid(self, what: str, search: str = "", filters: dict[str, str] | None = None, sort: str | None = None, direction: str = "ASC", page: int = 1, size: int = 50) -> dict[str, Any]:
        rows = self.rows(what)
        text = lambda v: "" if v is None else str(v)
        if search:
            rows = [r for r in rows if any(search.lower() in text(v).lower() for v in r.values())]
        for column, part in (filters or {}).items():
            if part:
                rows = [r for r in rows if part.lower() in text(r.get(column)).lower()]
        if sort:

            def order(r: dict[str, Any]) -> tuple:
                v = r.get(sort)
                return (0, [], 0.0) if v is None else (1, [], float(v)) if isinstance(v, (bool, int, float)) else (2, natural(str(v)), 0.0)

            rows = sorted(rows, key=lambda r: natural(text(r.get("id"))))
            rows = sorted(rows, key=order, reverse=direction.upper() == "DESC")
        size = min(max(int(size), 1), 250)
        page = max(int(page), 1)
        return {"total": len(rows), "page": page, "size": size, "rows": rows[(page - 1) * size : page * size]}

    def overview(self) -> dict[str, int]:
        ms, runs = self.rows("manifests"), self.registry.runs()
        return {
            "manifests": len(ms),
            "enabled": sum(m["enabled"] for m in ms),
            "due": sum(m["due"] for m in ms),
            "current": sum(m["current"] is not None for m in ms),
            "tables": len(self.materializer.store.names()),
            "runs": len(runs),
            "failed": sum(r["status"] == "failed" for r in runs),
            "running": sum(r["status"] == "running" for r in runs),
        }

    def act(self, mode: str, manifest: str | None = None) -> Any:
        if mode == "refresh_manifest":
            m = self.planner.manifests.get(manifest or "")
            if m is None:
                raise ValueError(f"Unknown manifest: {manifest}")
            self.planner.attempt(m)
            r = self.materializer.refresh(m)
            self.planner.result(m, r)
            self.planner.state.flush()
            return r
        if mode in ("refresh_due", "refresh_all"):
            self.job.settings["force"] = mode == "refresh_all"
            return self.job.run()
        if mode == "page":
            return {"overview": self.overview(), "grid": self.grid("manifests")}
        return self.grid(mode.removeprefix("grid_") or "manifests")

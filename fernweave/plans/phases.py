"""Ingests in phases: each step moves a source to the next status, and a run goes on from where the last stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from ..errors import ConfigurationError, IngestionError

# The statuses of structured documents and of drawings, in order.
STRUCTURED = ("analyzed", "synthesized", "completed")
DRAWING = ("rendered", "extracted", "linked", "completed")


def route(suffix: str, source_type: str | None, drawings: bool = True) -> str:
    """structured, drawing or plain; a PDF marked as a drawing goes there first."""
    s = suffix.lower().lstrip(".")
    if drawings and (s == "dxf" or s == "pdf" and source_type == "drawing"):
        return "drawing"
    return "structured" if s in ("xml", "l5x") else "plain"


def remaining(status: str | None, phases: tuple[str, ...]) -> tuple[str, ...]:
    if status is None:
        return phases
    if status not in phases:
        raise ConfigurationError(f"unknown status {status!r}")
    return phases[phases.index(status) + 1 :]


def resume(status: str | None, phases: tuple[str, ...], steps: dict[str, Callable[[], None]], commit: Callable[[str], None]) -> str:
    """Runs the steps that are left; the status is committed after each, so that a failure repeats only its own."""
    for phase in remaining(status, phases):
        try:
            steps[phase]()
        except Exception as e:
            raise IngestionError(f"phase {phase}: {e}") from e
        commit(phase)
    return phases[-1]


class MethodNamespace:
    """Methods by their names, in the order given; a name that comes twice raises."""

    def __init__(self, methods: list):
        self._methods = {}
        for m in methods:
            if m.name in self._methods:
                raise ConfigurationError(f"two methods are named {m.name!r}")
            self._methods[m.name] = m

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in self._methods:
            raise AttributeError(f"no method {name!r}; there are {', '.join(self._methods) or 'none'}")
        return self._methods[name]

    def __contains__(self, name: str) -> bool:
        return name in self._methods

    def __iter__(self) -> Iterator:
        return iter(self._methods.values())

    def __len__(self) -> int:
        return len(self._methods)


def dispatched(methods, progress: Callable[[int, int], None] | None = None, **what) -> list[str]:
    """Calls ``ingest(**what)`` of each method. Those that don't say ``required = False`` come first, and all are tried;
    any failure among them raises. What fails of the others is noted: "name:warn:...". ``progress`` hears (done, all)
    after the first kind, and at the end. One after another: each is Spark jobs that fill the cluster themselves."""
    needed = [m for m in methods if getattr(m, "required", True)]
    others = [m for m in methods if not getattr(m, "required", True)]
    total, failed, notes = len(needed) + len(others), [], []
    for m in needed:
        try:
            m.ingest(**what)
        except Exception as e:
            failed.append(e)
    if failed:
        raise IngestionError("required ingestion method failed: " + "; ".join(map(str, failed))) from failed[0]
    if needed and progress:
        progress(len(needed), total)
    for m in others:
        try:
            m.ingest(**what)
        except Exception as e:
            notes.append(f"{m.name}:warn:method_failed({str(e)[:80]})")
    if progress:
        progress(total, total)
    return notes

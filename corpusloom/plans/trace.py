"""Timing of the stages of a pipeline on the driver."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field


@dataclass
class Trace:
    """Named spans with their milliseconds and notes, handed to a sink when the work is over."""

    notes: dict = field(default_factory=dict)
    spans: list[dict] = field(default_factory=list)

    @contextmanager
    def span(self, name: str, **notes) -> Iterator[dict]:
        began = time.perf_counter()
        try:
            yield notes
        finally:
            self.spans.append({"name": name, "duration_ms": 1000 * (time.perf_counter() - began), **notes})

    @property
    def total_ms(self) -> float:
        return sum(s["duration_ms"] for s in self.spans)

    def as_dict(self) -> dict:
        return {"notes": self.notes, "spans": self.spans, "total_ms": self.total_ms}

    def send(self, sink: Callable[[dict], None] | None, fail_open: bool = True) -> None:
        """Give the trace to a sink; its failure does not fail the work unless asked."""
        if sink is None:
            return
        try:
            sink(self.as_dict())
        except Exception:
            if not fail_open:
                raise


def telemetry_sink(tracer) -> Callable[[dict], None]:
    """A sink that writes spans as events of one span of an OpenTelemetry tracer."""

    def sink(trace: dict) -> None:
        with tracer.start_as_current_span("search") as span:
            for s in trace["spans"]:
                span.add_event(s["name"], {k: v for k, v in s.items() if isinstance(v, (str, int, float, bool))})

    return sink

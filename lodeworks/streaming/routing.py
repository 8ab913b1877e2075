"""Ordered fallback over providers: one joint state of all breakers of a route, replayed in time order.

Each request goes down its route's list of providers. A closed breaker lets it call; an open one is passed over; after
the recovery time it is half open and lets one call try. A call that fails counts against its provider and the request
goes on to the next; the first that succeeds ends it. So a provider is called only where those before it have failed,
and the breakers of a route can't be replayed one by one. Rows stream through in order of route and time; what is held
is the breakers of one route, two numbers for each provider.

Defined cases: calls end before the next request of their route begins; requests of one time go by ``seq``; a route of
one request, or without providers, works alike (none selected, no reasons); a provider without an outcome has failed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Breakers:
    """The breakers of one route: failures in a row, and when the last opening one came."""

    def __init__(self, threshold: int, recovery: float):
        self.threshold, self.recovery = threshold, recovery
        self.failures: dict[str, int] = {}
        self.opened: dict[str, float] = {}

    def allows(self, provider: str, t: float) -> bool:
        return self.failures.get(provider, 0) < self.threshold or t - self.opened[provider] >= self.recovery

    def tell(self, provider: str, t: float, ok: bool) -> None:
        half_open = self.failures.get(provider, 0) >= self.threshold
        if ok:
            self.failures.pop(provider, None)
            return
        self.failures[provider] = max(self.failures.get(provider, 0) + 1, self.threshold if half_open else 0)
        if self.failures[provider] >= self.threshold:
            self.opened[provider] = t

    def route(self, providers: list[str], outcomes: list[bool | None], t: float) -> tuple[str | None, list[str], int]:
        """The provider that answers, why those before it did not, and the calls made."""
        reasons, calls = [], 0
        for i, provider in enumerate(providers):
            if not self.allows(provider, t):
                reasons.append(f"{provider}:circuit_open")
                continue
            calls += 1
            ok = i < len(outcomes) and bool(outcomes[i])
            self.tell(provider, t, ok)
            if ok:
                return provider, reasons, calls
            reasons.append(f"{provider}:error")
        return None, reasons, calls


def ordered_fallback(requests: DataFrame, threshold: int = 3, recovery: float = 30.0) -> DataFrame:
    """``route, seq, selected, reasons, calls`` of ``requests(route, seq, t, providers, outcomes)``.

    ``outcomes`` says for each provider whether a call would succeed, ``t`` is in seconds.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        route, breakers = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if breakers is None or r.route != route:
                    route, breakers = r.route, Breakers(threshold, recovery)
                selected, reasons, calls = breakers.route([] if r.providers is None else list(r.providers), [] if r.outcomes is None else list(r.outcomes), r.t)
                out.append((r.route, r.seq, selected, ";".join(reasons), calls))
            yield pd.DataFrame(out, columns=["route", "seq", "selected", "reasons", "calls"])

    ordered = requests.select(F.col("route").cast("string").alias("route"), F.col("seq").cast("long").alias("seq"), F.col("t").cast("double").alias("t"), "providers", "outcomes").repartition("route").sortWithinPartitions("route", "t", "seq")
    return ordered.mapInPandas(run, "route string, seq long, selected string, reasons string, calls int")

"""All registered queries."""

from __future__ import annotations

from pulseline.plans import basics, patterns, places, reports, streams, timing

QUERIES = {
    **basics.QUERIES,
    **timing.QUERIES,
    **patterns.QUERIES,
    **places.QUERIES,
    **reports.QUERIES,
    **streams.QUERIES,
}

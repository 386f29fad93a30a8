"""All registered queries with their comparison SQL."""

from dispatchlake.queries import (
    flows,
    history_and_docs,
    ids_and_intake,
    joins_and_metrics,
    streams_and_sinks,
)

ALL = {
    **joins_and_metrics.QUERIES,
    **ids_and_intake.QUERIES,
    **history_and_docs.QUERIES,
    **flows.QUERIES,
    **streams_and_sinks.QUERIES,
}

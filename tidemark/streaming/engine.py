"""The whole stream: log records to output, ledger and dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest
from ..schema import Settings
from . import exact, sink


def start(envelopes: DataFrame, root: str, checkpoint: str, settings: Settings | None = None, available_now: bool = False) -> StreamingQuery:
    """Runs a stream of log envelopes (``sources.streams``) into the tables
    below ``root`` (``sink.read_table``).

    Broken records are dead letters; valid ones are classified and attributed in
    order of arrival in their log partition; output rows are checked before they
    are written.  ``sink.archive_ledger`` moves old ledger rows to the history, on
    whatever trigger runs it.
    """
    s = settings or Settings()
    records = exact.attribution_records(ingest.records(ingest.parse(envelopes, s.strict_fields)), s)
    return sink.start(exact.guarded(records, s), root, checkpoint, available_now, s)

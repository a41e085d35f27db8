"""Coverage counts over a stream of reads. An extension: the batch operators serve files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.coverage import spans, valid_fragments, window_counts
from ..params import Params


def streaming_counts(reads: DataFrame, contigs: DataFrame, p: Params = Params()) -> DataFrame:
    """(sample, chr_idx, win, n) so far; windows of contigs are finite, so the state is bounded by the genome."""
    return window_counts(spans(valid_fragments(reads, p), contigs, p))


def start_counts(reads: DataFrame, contigs: DataFrame, table: str, checkpoint: str, p: Params = Params()) -> StreamingQuery:
    """Keeps the counts in a memory table of this name."""
    counts = streaming_counts(reads, contigs, p)
    return counts.writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).start()

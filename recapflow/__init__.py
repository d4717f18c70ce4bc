"""recapflow: transcripts to memory, summaries and timelines as Spark DataFrame jobs."""

from recapflow.params import Params

__all__ = ["Params"]

"""Incremental runs of the evaluation pipeline with Structured Streaming.

The reference pipeline has no streaming operator; this package only runs
the same batch pipeline (PIPE1 + the EV14 response cache) over texts that
arrive as new files, one micro-batch at a time.
"""

from .incremental import start_incremental_evaluation

__all__ = ["start_incremental_evaluation"]

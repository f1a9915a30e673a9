"""Evidence verification analytics as Spark jobs.

Tables of documents become versioned evidence and chunks, tables of claims are
matched against them, verdicts are guarded, and everything recorded about a run is
analysed as DataFrames.  Functions take and return DataFrames and stay lazy unless
their docstring names the one action they run.
"""

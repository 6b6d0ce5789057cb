"""gavel: governed tabular analytics as Spark DataFrame / SQL / Streaming jobs.

Profiling, data-quality flags, cleaning and encoding, quality gating, model
training and ranking, attributions, group-fairness audits and run-event
governance views, each expressed as declarative Spark plans.
"""

__version__ = "0.1.0"

"""martlens — retail order analytics expressed as Spark DataFrame / SQL / ML jobs.

Layers:
  sources/    table scans, fixture views over the driver tables, CSV/Parquet edges
  functions/  Column builders (dates, hashing, money, text, statistics)
  operators/  DataFrame-in / DataFrame-out operators (cleaning, joins, aggregates,
              distributed rank / quantile kernels, RFM, cohorts, churn, text, experiment)
  plans/      named queries over the driver tables and their SQL oracles
  streaming/  (the reference has no streaming operator; see README)
"""

__version__ = "0.1.0"

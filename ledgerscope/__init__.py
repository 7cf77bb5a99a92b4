"""ledgerscope: transaction-risk features, splits, metrics and scoring as Spark jobs.

Every operator is a function ``DataFrame -> DataFrame`` (usable with
``df.transform``); fit operators return small keyed DataFrames and apply
operators join them back.  Nothing is collected to the driver except scalars
(counts, a handful of bucket boundaries, a convergence error).
"""

__version__ = "0.1.0"

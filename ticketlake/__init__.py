"""ticketlake: support-ticket analytics as PySpark DataFrame jobs.

Layers, bottom up:

* ``schemas``    declared types and the fixed values of the domain
* ``functions``  Column -> Column expressions (text, labels, urgency, topic)
* ``operators``  DataFrame -> DataFrame building blocks (dedup, sampling, ...)
* ``sources``    readers and writers (ticket CSVs, Parquet, JSON results)
* ``plans``      whole jobs: prepare, score, decide, evaluate, profile
* ``registry``   the named queries and their SQL counterparts
"""

__version__ = "0.1.0"

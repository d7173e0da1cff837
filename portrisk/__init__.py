"""portrisk: port-logistics delay-risk analytics on Spark.

Subpackages: ``functions`` (Column -> Column), ``sources`` (readers, writers,
HTML extraction), ``operators`` (DataFrame -> DataFrame), ``streaming``
(Structured Streaming twins of the batch operators) and ``plans`` (the hourly
cycle and the query catalog over the driver tables).
"""

__version__ = "0.1.0"

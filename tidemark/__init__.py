"""tidemark: change-data-capture and clickstream lakehouse jobs on PySpark.

Raw change envelopes and click events go through Structured Streaming into
append-only bronze tables with dead-letter routing; silver builds keep the
latest version per key and sessionize clicks; gold builds compute daily
business marts. Every operator is a function ``f(DataFrame, ...) -> DataFrame``
that leaves planning to Catalyst and AQE.
"""

__all__ = ["session", "schemas"]

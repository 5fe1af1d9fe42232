"""piste: resort-operations analytics on Spark.

Layers (all DataFrame -> DataFrame, lazily composed so Catalyst sees one plan):

* ``piste.sources``    typed readers, sinks, and adapters that bind the driver tables
                       to the resort raw schema.
* ``piste.functions``  column-level helpers (surrogate keys, dialect-exact date math).
* ``piste.operators``  staging models, dimensions, facts, incremental upsert, SCD-2,
                       data-quality checks, forecasting features, monitoring, text jobs.
* ``piste.plans``      the semantic layer (views, metrics, drill-across) and named
                       business queries.
* ``piste.streaming``  Structured Streaming versions of the incremental fact loads.
"""

__version__ = "0.1.0"

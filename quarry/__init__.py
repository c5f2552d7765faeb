"""quarry: web pages and documents to a searchable, question-ready corpus, as Spark jobs.

Layout
------
functions/   Column -> Column expressions (text, html, urls, vectors)
sources/     readers and writers (parquet tables, JSON page records, caches, stores)
operators/   DataFrame -> DataFrame operators (chunking, dedup, ids, embedding,
             search, rerank, links, dialog, cache, audit)
plans/       end-to-end jobs and the query catalog used by ``__spark_entry__``
streaming/   Structured Streaming jobs (incremental ingest, query cache)
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so Python workers run the
    Arrow-batched steps without the package being installed on executors."""
    import sys

    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: workers must import the package
        pass


_ship_by_value()

"""tillroll: retail invoice analytics expressed as Spark DataFrame jobs.

Layout
------
``sources``    readers for the input tables, the invoice-line view, file sinks
``functions``  column-expression helpers (money, calendar, tolerance, text)
``operators``  cleaning, marts, KPIs, rankings, analyses, checks, run and
               evidence jobs — each a function ``DataFrame -> DataFrame``
``plans``      the query catalogue (Spark side) and its DuckDB oracle SQL
"""

__version__ = "0.1.0"

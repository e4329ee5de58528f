"""Building blocks for batch data pipelines on Spark.

``sources``    datasets described by a spec, and literal fixture tables
``functions``  ``Column -> Column`` helpers: text, versions, nested and JSON values
``operators``  joins, lookups, state tables, roll-ups, routing and checks on tables
``plans``      ready-made pipelines, written as ``DataFrame -> DataFrame`` steps
``catalog``    the queries run over the sample tables, each with its SQL twin

Every operator takes and returns DataFrames of the caller's session.
"""

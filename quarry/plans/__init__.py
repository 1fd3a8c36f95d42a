"""Query catalog: every build key bound to the driver tables.

Each plan module registers ``key -> (spark_builder, oracle_sql)`` through
``quarry.plans.registry.register``; importing ``quarry.plans.catalog``
loads them all.
"""

"""Flow analytics on Spark: discrete-time models of services, queues, routers and constraints as DataFrame plans.

A series set is a wide DataFrame keyed (scenario_id, bin) with one DOUBLE column per series, or long rows
(scenario_id, series_id, bin, value). Operators take DataFrames and give DataFrames; nothing is collected.
"""

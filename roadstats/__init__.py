"""roadstats — road-fatality analytics as Spark DataFrame jobs.

Every operator is a function from DataFrame(s) to a DataFrame; parameters
(thresholds, grid sizes, year bounds) are arguments.  Sub-packages:

* ``sources``   — scans of the driver tables, stand-in entities, CSV/JSON inputs
* ``functions`` — column expressions (normalisation, exact rounding, projections)
                  and the fixed constant dimensions
* ``operators`` — table-level jobs (subtypes, city stats, ranks, spatial join,
                  hotspots, data quality, keyed loads, serving projections)
* ``plans``     — end-to-end pipelines, sinks and the query registry
* ``streaming`` — incremental (availableNow) loading
"""

__version__ = "0.1.0"

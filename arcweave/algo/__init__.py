"""Graph algorithms as supersteps of joins and aggregations.

Edges come as ``src, dst`` (and ``weight``), parallel ones as rows; vertices as
``id``. Every superstep is written to the shared folder before the next one
starts from it, so plans stay short and lost executors cost one step. Only
single numbers (counts, sums) reach the driver.
"""

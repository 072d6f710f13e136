"""arcweave: a property-graph analytics engine on PySpark DataFrames.

Graphs are catalogs of vertex and edge DataFrames; a Cypher/GQL subset is
compiled to DataFrame plans, graph algorithms are join/aggregate supersteps,
and a set of data-quality operators works on the raw feeds around a graph.
"""

__version__ = "0.1.0"

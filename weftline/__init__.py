"""weftline: edge-block graph loading and analytics on Spark DataFrames.

Subpackages: ``sources`` (compressed graph data source, property files), ``operators``
(ranges, offsets, degrees, blocks, components, checksums), ``sinks`` (text and binary
writers), ``streaming`` (asynchronous block delivery), ``functions`` (unsigned and block
arithmetic), ``plans`` (the Graph handle and registered queries).
"""

"""PySpark-native analytics over the tables behind AI applications.

Embeddings, versioned prompt registries, agent checkpoints, document
extraction, a line-based table text format and governance logs.  Every
operator takes and returns DataFrames (or Columns).
"""

"""Ptychographic phase retrieval and training-data preparation as Spark jobs."""

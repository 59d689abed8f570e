"""Spark-native engine for teaching documents: ingest, chunking, retrieval, outlines, layout and retention."""

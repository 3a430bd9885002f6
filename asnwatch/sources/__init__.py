"""Readers and writers of feed messages, reference data, anomaly history and monitor samples."""

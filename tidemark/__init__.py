"""Versioned JSON documents as DataFrames: snapshots, filters, diffs, schemas and transactions on Spark."""

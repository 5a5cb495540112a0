"""Readers: archives, delimited files, Parquet layouts, JSON documents and file manifests."""

"""Corpus operators for a training-data pipeline: extraction, filtering, dedup,
decontamination, mixing, formatting and sharding.  Nothing else in the library
imports this subpackage."""

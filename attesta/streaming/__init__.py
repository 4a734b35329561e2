"""Structured Streaming forms of the log and ledger analytics; an extension, the batch forms are the model."""

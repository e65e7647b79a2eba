"""Spark-native analytics for finding suspicious bank accounts in transaction data.

``sources``    schemas, loaders, sinks, and bindings of the driver's tables to the banking model
``functions``  column helpers that keep the null rules of the reference
``operators``  quality, profiles, features, patterns, time series, statistics, graph, models, text
``plans``      the query catalogue, each query beside the SQL that checks it
``streaming``  Structured Streaming twins of the running aggregates
``llm``        training-data operators; nothing else imports it
"""

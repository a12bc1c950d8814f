"""Spark-native analytics over account-based ledger data, plus training-data operators in ``lodeweave.llm``."""

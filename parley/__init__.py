"""Conversation-study analytics on Spark DataFrames."""

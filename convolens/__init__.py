"""Conversation analytics as Spark DataFrame operators."""

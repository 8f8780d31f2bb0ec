"""Conversation-dataset analytics as Spark jobs."""

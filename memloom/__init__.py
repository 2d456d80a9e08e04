"""Conversation memory and retrieval analytics, declared as Spark plans."""

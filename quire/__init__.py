"""Quire: document processing over libraries of books and pages, as Spark DataFrame operations."""

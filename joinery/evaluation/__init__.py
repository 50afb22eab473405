"""Evaluation analytics on tables of run samples."""

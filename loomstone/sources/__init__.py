"""Readers and writers of the tables that operators take and give."""

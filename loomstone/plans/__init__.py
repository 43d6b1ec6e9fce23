"""Registered queries over the supplied tables, each with the SQL that checks it where SQL can say it."""

"""Registered queries: each builds one result from the tables of a directory."""

"""Readers and writers for the tables and files the operators work on."""

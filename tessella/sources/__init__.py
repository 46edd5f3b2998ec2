"""Readers of source files, documents and directories."""

"""Readers of catalogs, papers, attachments, concept files and settings."""

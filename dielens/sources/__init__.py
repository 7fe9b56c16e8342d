"""Readers and writers for canonical tables, vendor files and deliveries."""

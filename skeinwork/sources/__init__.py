"""Readers of feeds, listings, pages and configuration."""

"""Adapter from the test tables to service-desk data, queries and oracle SQL."""

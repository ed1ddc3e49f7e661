"""Whole queries: table adapters, composed plans and their oracle SQL."""

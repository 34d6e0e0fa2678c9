"""Readers, and the well tables derived from the analytic test schema."""

"""Registered queries and the fixtures that they run on."""

"""Relational operators over event-to-object relations."""

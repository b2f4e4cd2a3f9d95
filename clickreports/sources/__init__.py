"""Event table in; tables and JSON bundle out."""

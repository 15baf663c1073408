"""Queries by name: thin plans over the operators, with the SQL that checks them."""

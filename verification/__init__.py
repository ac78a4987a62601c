"""Queries over the supplied tables and the independent SQL that checks them."""

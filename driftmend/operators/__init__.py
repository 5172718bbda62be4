"""Relational operators: classification, repair, gates, digests, inventories, ledgers."""

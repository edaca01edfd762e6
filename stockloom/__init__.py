"""Inventory analytics and document reconciliation as Spark plans."""

"""Listings, the ledger, tag metadata, and the tables a run writes."""

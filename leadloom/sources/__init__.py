"""Sources that yield candidate, listing and page tables."""

"""Part of the claimweave library."""

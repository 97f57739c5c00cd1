"""Reading: CSV folders, typed CSV loads, SQL text and the raw layer."""

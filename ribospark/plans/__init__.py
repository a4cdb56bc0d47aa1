"""Named queries for the driver, with their SQL."""

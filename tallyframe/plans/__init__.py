"""The operators bound to the driver's tables, each with a plain-SQL twin."""

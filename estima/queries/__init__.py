"""One query per operator over the driver's tables, with SQL where SQL can express it."""

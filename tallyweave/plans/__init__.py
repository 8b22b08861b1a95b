"""Named queries over the report tables, with their SQL where SQL can say them."""
